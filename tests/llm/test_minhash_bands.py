"""Bands of fingerprints: members, chunks, comparison within a group, and the query's classes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marketglass.llm import common, minhash


def test_members_and_groups_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(b), int(t)) for b, t in zip(rng.zipf(1.4, 3000) % 400, rng.integers(-(1 << 60), 1 << 60, 3000))})
    df = spark.createDataFrame(rows, "band long, t long")
    by: dict[int, list[int]] = {}
    for b, t in rows:
        by.setdefault(b, []).append(t)
    members = minhash._members(df, 7)
    got = sorted((r.band, r.t, r.chunk) for r in members.collect())
    assert got == sorted((b, t, k // 7) for b, ts in by.items() if len(ts) > 1 for k, t in enumerate(ts))
    met: dict[int, set[int]] = {}
    for r in minhash._groups(members).collect():
        met.setdefault(r.key, set()).add(r.t)
    assert max(map(len, met.values())) <= 14
    pairs = {p for ts in met.values() for p in itertools.combinations(sorted(ts), 2)}
    assert pairs == {p for ts in by.values() for p in itertools.combinations(sorted(ts), 2)}


def near(fp, share, rng):
    out = fp.copy()
    at = rng.random(len(fp)) < share
    out[at] = rng.integers(0, 256, at.sum())
    return out


@pytest.mark.parametrize("partners", [1, 3, 100])
def test_every_doubtful_pair_is_named_in_the_end(partners):
    rng = np.random.default_rng(partners)
    seeds = rng.integers(0, 256, (4, 128)).astype(np.uint8)
    fp = np.array([near(seeds[k % 4], s, rng) for k, s in enumerate(rng.choice([0.0, 0.02, 0.15, 0.3], 40))])
    like = np.array([[minhash._alike(a, b) for b in fp] for a in fp])
    name, judged, asked = np.arange(40), {}, set()
    for _ in range(200):
        sure, doubtful, more = minhash.compare_group(fp, name, judged, 0.65, 0.95, partners)
        assert all(like[i, j] >= 0.95 for i, j in sure) and all(0.65 <= like[i, j] < 0.95 for i, j in doubtful)
        assert not asked & set(doubtful) and len(sure) < 40 and len(doubtful) <= 40 * partners
        for i, j in sure:
            name = np.where(name == name[j], name[i], name)
        asked |= set(doubtful)
        for i, j in doubtful:
            judged.setdefault(i, []).append(j)
        if not more:
            break
    assert not more
    for i, j in itertools.combinations(range(40), 2):
        if like[i, j] >= 0.95:
            assert name[i] == name[j]
        elif like[i, j] >= 0.65:
            assert name[i] == name[j] or (i, j) in asked


def test_query_gives_classes(spark, folder):
    """The classes hold all pairs of brute force over the whole table but those a band may miss, and no others."""
    got = {r.doc_id: r for r in __spark_entry__.queries()["op5_document_fingerprints"](spark, folder).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in texts.items()}
    linked = [(i, j) for i, j in itertools.combinations(sorted(texts), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(linked) > 10
    assert sum(got[i].class_id == got[j].class_id for i, j in linked) >= 0.99 * len(linked)
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in linked:
        x, y = sorted((root(i), root(j)))
        up[y] = x
    assert all(root(i) == root(r.class_id) for i, r in got.items())
    assert all((r.links > 0) <= (sum(x.class_id == r.class_id for x in got.values()) > 1) for r in got.values())


@pytest.mark.parametrize("sieve", [minhash.SIEVE, 64])
def test_only_what_is_made_of_texts_in_doubt_is_exchanged(spark, monkeypatch, sieve):
    monkeypatch.setattr(minhash, "SIEVE", sieve)
    words = [" ".join(f"w{n}x{k}" for k in range(40)) for n in range(300)]
    words += [words[0] + " more", words[7] + " again", None]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    t = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    pairs = spark.createDataFrame([(t[0], t[300]), (t[7], t[301]), (t[7], t[9]), (t[302], t[5])], "a long, b long")
    plans, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    got = {(r.a, r.b): r.similarity for r in minhash._verified(pairs, docs).collect()}
    assert got == {(t[0], t[300]): 36 / 37, (t[7], t[301]): 36 / 37, (t[7], t[9]): 0, (t[302], t[5]): 0}
    met = [p for p in plans if "LeftSemi" in p]
    assert met and all(p.index("LeftSemi") < p.index("MapInArrow") for p in met)


def test_only_rows_of_texts_in_classes_are_exchanged(spark, monkeypatch):
    """Rows outside classes get theirs where they are read; a sieve that lets others through gives the same."""
    rows = common.materialize(spark.range(400).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id") % 390).alias("text_hash"), F.repeat(F.lit("x"), 500).alias("wide")))
    classes = common.materialize(rows.filter("doc_id < 10").select("text_hash", (F.col("doc_id") % 5).alias("class_id"), F.lit(3).cast("long").alias("links")))
    expected = {n: (n % 390 % 5, 3) if n % 390 < 10 else (n, 0) for n in range(400)}
    for sieve in (minhash.SIEVE, 64):
        monkeypatch.setattr(minhash, "SIEVE", sieve)
        found = minhash._in_class(rows, classes)
        assert {r.doc_id: (r.class_id, r.links) for r in found.collect()} == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan[plan.index("Join LeftOuter") :].split("Relation")[0]


def test_sets_of_texts_pass_one_exchange_for_both_sides_of_pairs(spark, monkeypatch):
    words = [" ".join(f"w{n}x{k}" for k in range(40)) for n in range(30)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    t = [r.t for r in docs.select(F.xxhash64("text").alias("t")).collect()]
    pairs = spark.createDataFrame([(t[n], t[n + 1]) for n in range(29)], "a long, b long")
    plans, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan()) or write(df, *a))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = minhash._verified(pairs, docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(got) == 29 and all(r.similarity == 0 for r in got)
    met = [p for p in map(str, (p.toString() for p in plans)) if "similarity" in p]
    assert len(met) == 1 and met[0].count("MapInArrow") == 1 and "ReusedExchange" in met[0]
