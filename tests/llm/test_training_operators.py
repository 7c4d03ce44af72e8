"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marketglass.llm import crf, language_id, minhash, mixing, packing, pii, quality, simhash, token_counts, tokenizer, toxicity, va_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, score string, _hash long"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, "x", "y", 0),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "y", 0),
    (None, "alpha beta gamma delta epsilon zeta", "en", "b", 35, "x", "y", 0),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, "x", "y", 0),
    (5, "  \t\n ", "de", "b", 5, "x", "y", 0),
    (6, "wort " * 9000, "de", "c", 45000, "x", "y", 0),
    (7, "jo.81@mail7.example.com called +1 (319) 555-5132 from 10.0.0.7 about 4111 1111 1111 1111", "en", None, 80, "x", "y", 0),
    (8, "<|endoftext|> été ☃ \U0001f600  two  spaces", "fr", "c", 30, "x", "y", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer.default_path())


def test_token_counts(spark, docs, real, empty, library):
    for df in (docs, real):
        want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in df.select("doc_id", "text").collect())
        got = token_counts.token_counts(df).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(empty).count() == 0


def test_token_ids_equal_the_library_on_odd_texts(library):
    bpe = tokenizer.load(tokenizer.default_path())
    rng = random.Random(4)
    letters = "abé ñ\n\t'sT.,!?09<|>   İß中"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in bpe.ids_all(texts)] == want
    assert bpe.count_all(texts) == [len(x) for x in want]


def check_packing(pieces, texts, library):
    tokens = {}
    for i, t in texts:
        tokens.setdefault(str(i), []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    by = {}
    for r in pieces:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in tokens[str(r.doc_id)])
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in pieces) == sum(len(x) for v in tokens.values() for x in v)
    return len(by)


def test_packing(docs, real, empty, library):
    check_packing(packing.pack(docs).collect(), docs.select("doc_id", "text").collect(), library)
    texts = real.select("doc_id", "text").collect()
    pieces = packing.pack(real).collect()
    n = check_packing(pieces, texts, library)
    assert n <= -(-sum(r.length for r in pieces) // 2048) + 1
    for r in pieces:
        assert r.piece == 0 or r.length == 2048
    assert packing.pack(empty).count() == 0


def test_packing_agrees_with_itself(real):
    a = packing.pack(real).select("doc_id", "piece", "sequence_id").filter("sequence_id < 0")
    b = packing.pack(real.repartition(3)).select("doc_id", "piece", "sequence_id").filter("sequence_id < 0")
    assert sorted(a.collect()) == sorted(b.collect())


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300).tolist()
    a, b = (packing.best_fit(rng.permutation(300).tolist(), [], sizes, 100) for _ in range(2))
    child = packing.crossover(a, b, sizes, 100, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(300))
    assert all(sum(sizes[i] for i in x) <= 100 for x in child.bins)


def test_the_genetic_algorithm_beats_best_fit():
    """Sequences that three documents fill exactly; best fit, longest first, misses most of them."""
    rng = np.random.default_rng(5)
    sizes = [x for _ in range(60) for a, b in [(int(rng.integers(500, 900)), int(rng.integers(400, 600)))] for x in (a, b, 2048 - a - b)]
    plain = packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], sizes, 2048)
    best = packing.evolve(sizes, 2048, 1, 6, 200)
    assert sorted(i for b in best.bins for i in b) == list(range(len(sizes))) and min(best.free) >= 0
    assert 60 <= len(best.bins) < len(plain.bins)


def test_loose_sequences_of_all_shards_are_packed_together(spark):
    rng = random.Random(8)
    rows = [(i, 0, 0, rng.randrange(50, 900), i) for i in range(3000)] + [(None, 0, 0, 700, 9)] * 500
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(pieces, shard_items=250, generations=10, epochs=2).collect()
    assert sorted((r.doc_id or -1, r.length) for r in out) == sorted((r[0] or -1, r[3]) for r in rows)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    apart = packing.pack_pieces(pieces, shard_items=250, generations=10, epochs=2, loose=1.0).select("sequence_id").distinct().count()
    assert -(-sum(r[3] for r in rows) // 2048) <= len(by) < apart


def test_very_common_variants_are_divided_without_losing_links(spark, monkeypatch):
    """Fingerprints that agree in two blocks share a variant; groups above the bound go the second way."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ rng.getrandbits(22) for _ in range(400)} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(100)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "HOT", 20)
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    names = {i: i for i in fps}

    def find(x):
        while names[x] != x:
            x = names[x]
        return x

    for r in links:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        names[find(a)] = find(b)
    got = {x: find(x) for x in fps}
    want = {i: i for i in fps}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                want[root(x)] = root(y)
    assert len(set(got.values())) == len({root(x) for x in fps})
    assert all((got[x] == got[y]) == (root(x) == root(y)) for x in fps[::7] for y in fps)


def test_simhash_fingerprint():
    from xxhash import xxh64_intdigest

    for text in ("", " \x0b", "One two", "A b c d", "a b c d e a b c d e", "É x y z É"):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        h = [xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) == want


def brute_components(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_ball_hashing_finds_every_component(spark):
    rng = random.Random(1)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.choice((1, 3, 4, 4, 5))):
                x ^= 1 << b
            fps.append(x)
    from marketglass.llm.components import components

    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    label = [got.get(x, x) for x in signed]
    want = brute_components(fps)
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_simhash_tables(docs, real, empty):
    rows = real.select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_components([simhash.fingerprint(r.text or "") for r in rows])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(real).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[i].doc_id for i in want]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    # 1, its repeated row and the row without id are one group; null, empty and white texts another.
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7, 8]
    assert simhash.near_duplicates(empty).count() == simhash.representatives(empty).count() == 0


def test_chains_become_one_component(spark):
    from marketglass.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_minhash(docs, real, empty):
    rows = sorted(real.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in minhash.with_next(real).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = (set(minhash.shingles(x).tolist()) for x in (t, e))
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i].near_edited - exact) < 0.2
    assert minhash.with_next(docs).count() == len(ROWS)
    assert minhash.with_next(empty).count() == 0
    one = docs.filter("doc_id = 6")
    assert minhash.with_next(one).first().near_next == 1.0


@pytest.mark.parametrize("chunk, partners", [(minhash.CHUNK, minhash.PARTNERS), (3, 1)])
def test_minhash_finds_the_classes_of_brute_force(spark, chunk, partners):
    """Chains, groups of near copies, two leaders that a third text joins: recall of linked pairs, and no false link. Bands
    compared whole, and in chunks with several rounds of verification."""
    rng = random.Random(11)
    texts = []
    for g in range(30):
        words = [f"g{g}w{rng.randrange(900)}" for _ in range(150)]
        for _ in range(8):
            texts.append(" ".join(words))
            if rng.random() < 0.5:
                words = words[: 150 - rng.randrange(1, 12)] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))]
            else:
                words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
    texts += [texts[0], "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, chunk=chunk, partners=partners).collect()}
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append((i, j))
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert len(pairs) > 100
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert all(root(i) == root(c) for i, c in got.items())


def test_fingerprint_columns(docs, real):
    got = {}
    for r in minhash.with_next(real).collect():
        assert len(r.fingerprint) > 100 and 0 <= r.near_next <= 1
        got[r.doc_id] = r
    rows = sorted(real.select("doc_id", "text").collect())
    same = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        a, b = (set(minhash.shingles(x or "").tolist()) for x in (t, n))
        assert abs(got[i].near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert len({r.fingerprint for r in got.values()}) > 0.5 * len(got)


def test_minhash_near_duplicates(spark, empty):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:198], "x", "y"]
    df = spark.createDataFrame([(3, " ".join(words)), (1, " ".join(near)), (7, " ".join(words)), (9, "another text of its own"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in minhash.near_duplicates(df).collect()}
    assert got == {3: (1, 1), 1: (1, 1), 7: (1, 1), 9: (9, 0), None: (None, 0)}
    assert minhash.near_duplicates(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (150, 16)).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(150, None), (151, [None] * 16), (152, [float("nan")] * 16), (153, [float("inf")] * 16), (154, [1.0] * 3), (None, [0.1] * 16), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in va_search.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect())
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in good:
        if q % 50 == 0:
            c = sorted((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(c)]
    assert got == sorted(want)
    assert va_search.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 50)")
    assert va_search.top_k(few, few).count() == 2


def test_approximations_spare_exact_reads():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 2, (3000, 16)))
    cell, width = va_search.cells(x)
    assert width.min() > 1 and (cell * width[:, None] <= x).all() and (x <= cell * width[:, None] + width[:, None] - 1).all()
    up, low = va_search.bounds(x[:5], cell.astype(float), width)
    exact = x[:5] @ x.T
    assert (low <= exact).all() and (exact <= up).all()
    q = va_search.Queries(np.arange(5) + 10_000, x[:5], 5)
    for at in range(0, 3000, 500):
        q.scan(np.arange(at, at + 500), cell[at : at + 500], width[at : at + 500])
    left = q.rows()
    assert 5 * 5 <= len(left[0]) < 5 * 200
    for k in range(5):
        best = np.lexsort((np.arange(3000), -exact[k]))[:5]
        assert set(best) <= set(left[1][left[0] == 10_000 + k])


def test_top_k_with_large_components_ties_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(60)] + [(300, [1e17, -3.0, 2.0, 0.0]), (350, [1e-3, 1e17, 0.0, 1.0]), (301, [1e300, 1e300, 0.0, 0.0]), (302, [0.0] * 4), (400, [0.0] * 4), (119, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "a.id")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in va_search.top_k(df, df.filter("`a.id` % 50 = 0"), 5, id_column="a.id").collect())
    want = []
    for q, a in rows:
        if q % 50 == 0:
            scores = [(sum(int(256 * x // 1) * int(256 * y // 1) for x, y in zip(a, b)), i) for i, b in rows if i != q]
            c = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for s, i in scores)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(c)]
    assert got == sorted(want)


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 0.5 and group[0].target <= 3 * group[0].source_size
        assert sum(r.size for r in group) == group[0].source_size
    assert sum(g[0].target for g in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert mixing.mix(empty.select("doc_id", "source", mixing.word_count("text").alias("size"))).count() == 0


def test_word_count(docs):
    for t, n in docs.select("text", mixing.word_count("text")).collect():
        assert n == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_curriculum(real, docs, empty):
    sized = real.select("doc_id", "source", mixing.word_count("text").alias("size"), "text")
    taken = {r.doc_id: r.taken for r in mixing.mix(sized.drop("text")).collect()}
    out = mixing.curriculum(real)
    assert out.columns == real.columns
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert got == {i: n for i, n in taken.items() if n}
    assert mixing.curriculum(docs).columns == docs.columns
    assert mixing.curriculum(empty).count() == 0


@pytest.mark.parametrize("slope", mixing.SLOPES)
def test_position_inverts_the_schedule(spark, slope):
    from pyspark.sql import functions as F

    df = spark.range(11).select((F.col("id") / 10.0).alias("u")).withColumn("t", mixing.position(F.col("u") * 7, F.lit(7.0), F.lit(slope)))
    for u, t in df.collect():
        assert t + slope * (t * t - t) == pytest.approx(u, abs=1e-12)


def test_base_spans():
    texts = [r[1] or "" for r in ROWS] + ["a@b.c_x@d.ef", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256", "4111-1111 1111 1111 2", "+1 (5) 5555555 +12345678-", "a@b.c%d@e.f@g.h", "9" * 5000]
    for t in texts:
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(pii.digits_of(m[0])) <= 15]
        assert pii.base_spans(t) == want


def test_pii(docs, empty):
    model = pii.Model()
    for text, spans in pii.labelled_rows():
        base = pii.base_spans(text)
        found = sorted(base + model.added([text], [base])[0])
        assert found == sorted(s for s in spans if s[0] != "card" or pii.luhn(pii.digits_of(text[s[1] : s[2]])))
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert (got[7].n_email, got[7].n_ip, got[7].n_card, got[7].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert red[7].text == "[EMAIL] called [PHONE] from [IP] about [CARD]" and red[2].text is None and red[8].text == ROWS[8][1]
    assert pii.find(empty, model).count() == pii.redact(empty, model).count() == 0


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, t = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    lengths = np.array([5, 3, 1])
    best = crf.viterbi(scores, lengths, t)
    for k, n in enumerate(lengths):
        want = max(product(range(3), repeat=int(n)), key=lambda p: sum(scores[k, i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])))
        assert tuple(best[k, :n]) == want


def test_forward_backward_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    n = 301
    e, t = rng.random((n, 3)) + 0.01, rng.random((3, 3))
    t /= t.sum(axis=1, keepdims=True)
    begins = np.zeros(n, bool)
    begins[[0, 5, 120, 128, 250]] = True
    want = []
    for a, b in zip(np.flatnonzero(begins), [*np.flatnonzero(begins)[1:], n]):
        alpha, beta = [e[a] / 3], [np.ones(3)]
        for k in range(a + 1, b):
            x = alpha[-1] @ t * e[k]
            alpha.append(x / x.sum())
        for k in range(b - 1, a, -1):
            x = t @ (e[k] * beta[-1])
            beta.append(x / x.sum())
        p = np.array(alpha) * np.array(beta[::-1])
        want.append(p / p.sum(axis=1, keepdims=True))
    assert np.allclose(crf.forward_backward(e, t, begins), np.concatenate(want))


def held_out(folder, column, n, rest):
    import duckdb

    rows = duckdb.sql(f"select doc_id, coalesce(text, ''), {column} from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) order by 1").fetchall()
    split = [[], []]
    for i, t, y in rows:
        split[zlib.crc32(str(i).encode()) % n == rest].append((t, y))
    return split


def auc(s, y):
    pos, neg = np.array(s)[np.array(y) == 1], np.array(s)[np.array(y) == 0]
    return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2).item()


def test_quality_on_held_out_labels(docs, empty):
    train, test = held_out("/root/testdata/sf0.1", "quality", 5, 0)
    bad, good = [r for r in train if r[1] == 0], [r for r in train if r[1] == 1][:800]
    m = quality.Model([t for t, _ in bad + good], np.array([y for _, y in bad + good]))
    from marketglass.llm import common

    s = m.scores([t for t, _ in test], common.table_of(m, quality.RANK))
    assert auc(s, [y for _, y in test]) > 0.9
    kept = [x >= quality.THRESHOLD for x, (_, y) in zip(s, test) if y == 1]
    assert np.mean(kept) > 0.97
    out = quality.classify(docs, m, "source", "text").collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(empty, quality.Model([], np.array([]))).count() == 0


def test_toxicity_on_held_out_labels(docs, empty):
    train, test = held_out("/root/testdata/sf0.1", "toxic", 4, 2)
    bad, good = [r for r in train if r[1] == 1 and len(r[0]) < 8000], [r for r in train if r[1] == 0 and len(r[0]) < 8000][:800]
    m = toxicity.Model([t for t, _ in bad + good], np.array([y for _, y in bad + good]), 0.1)
    from marketglass.llm import common

    table = common.table_of(m, 1)
    assert auc(m.scores([t for t, _ in test], table), [y for _, y in test]) > 0.88
    plain, gapped, clean = m.scores(["such an idiot", "such an i-d-i*o.t", "such a thing"], table)
    assert plain > 0.3 and gapped > 0.3 and clean < 0.1
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, m).collect())
    assert toxicity.score(empty, toxicity.Model([], np.array([]))).count() == 0


def test_language_id(spark, docs, empty):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and len(r.text or "") < 6000][:400]
    m = language_id.Model([r.text for r in train], [r.lang for r in train])
    from marketglass.llm import common

    got, _ = m.predict([r.text or "" for r in test], common.table_of(m, len(m.languages) + 1))
    assert np.mean([a == r.lang for a, r in zip(got, test)]) > 0.95
    out = {r.doc_id: r for r in language_id.identify(docs, m).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[5].lang_pred == "und" and out[2].score == 0
    assert out[6].lang_pred in m.languages
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


def test_code_switched_words_get_their_own_language():
    m = language_id.Model(["the house and the garden of the king " * 20, "le jardin et la maison de la reine " * 20], ["en", "fr"])
    labels = [k for _, k, _ in m.word_labels("the garden of the king et la maison de la reine")]
    assert labels[:4] == ["en"] * 4 and labels[-4:] == ["fr"] * 4
