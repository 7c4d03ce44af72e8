"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from marketglass.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, buckets=10_000):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), Counter(zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def plain(docs, target):
    rows = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, w, f in rows:
        n = sum(f.values())
        total = sum(c * math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b, c in f.items())
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = total // n if n else 0
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), w])
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(may[: len(may) * 25 // 100])}
    return sorted(((r[0], r[1], r[2], r[3], drawn.get(id(r))) for r in out), key=str)


def texts():
    rng = random.Random(3)
    names = ["Été", "a", "B2", "x" * 47, "y" * 48, "z" * 49, "ß", " ", "of", "the", "d\x00e", "wort", "İ", "\U0001f600"]
    return [(k, rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choices(names, k=rng.randrange(60)))) for k in range(300)]


@pytest.mark.parametrize("parts", ["4", "70"])
def test_equals_plain_loops(spark, monkeypatch, parts):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 50)
    monkeypatch.setattr(resampling, "HELD", 60)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = [*texts(), (900, None), (901, ""), (None, "the of " * 30), (902, "q" * 200_000), (903, "a b " * 70_000), (904, "the of " * 30)]
        target = [None, "", "the of the of été", "wort b2 a"]
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, bucket int")
        got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ties_repeats_and_empty_tables(spark):
    rows = [(5, "a b c d " * 10)] * 40 + [(6, "a b c d " * 10)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(df, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12))
    assert len({(r.doc_id, r.score) for r in got}) == 2
    assert resampling.resample(df.limit(0), none).count() == 0


def test_whole_table_equals_plain_loops(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = resampling.op11_importance_resampling(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, target)
