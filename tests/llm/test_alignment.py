"""Alignment of two tokenizers against plain loops over whole texts with the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from marketglass.llm import alignment, tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())


def plain(docs, libraries):
    a_lib, b_lib = libraries
    back = {c: b for b, c in tokenizer.byte_letters().items()}
    found = []
    for _, text in docs:
        if not text:
            found.append(None)
            continue
        e, b = a_lib.encode(" " + text, add_special_tokens=False), b_lib.encode(text)
        a_bytes = [bytes(back[c] for c in t) for t in e.tokens]
        names = [b_lib.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(s[3:5], 16)]) if b_lib.is_byte(i) else s.replace("▁", " ").encode() for i, s in zip(b, names)]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append(None)
            continue
        spans = []
        for ids, parts in ((e.ids, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((at, at + len(p), i))
                at += len(p)
            spans.append(own)
        cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        links, groups, low = [], [], 0
        i = j = 0
        for cut in cuts:
            i0, j0 = i, j
            while i < len(spans[0]) and spans[0][i][1] <= cut:
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= cut:
                j += 1
            groups.append(",".join(str(s[2]) for s in spans[0][i0:i]) + "|" + ",".join(str(s[2]) for s in spans[1][j0:j]))
            links += [(x[2], y[2]) for x in spans[0][i0:i] for y in spans[1][j0:j] if x[0] < y[1] and y[0] < x[1]]
        found.append((len(e.ids), len(b), groups, links))
    counts = Counter(p for f in found if f for p in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), f in zip(docs, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            out.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str), counts, best


def odd(n):
    rng = random.Random(11)
    bits = ["the", "Tokenization", "été", "naïve", "▁", "<|endoftext|>", "<s>", "<0x0A>", "don't", "123456", "\U0001f600", "你好", "x" * 40, "...", "\x00", "é", "ſt", "İ", " ", "ﬁ"]
    gaps = [" ", " ", " ", " ", "\n", "  ", "\t", "\n\n", " \n", "", "\r\n", "   "]
    return [(k, "".join(x for _ in range(rng.randrange(1, 12)) for x in (rng.choice(bits), rng.choice(gaps))).rstrip(" " if k % 2 else "")) for k in range(n)]


def test_equals_plain_loops(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 40)
    docs = [*odd(400), (900, None), (901, ""), (None, "the the"), (902, "the cat sat on the mat"), (902, "the cat sat on the mat"), (903, " lead"), (904, " "), (905, "\n"), (906, "a" * 20_000), (907, "word " * 20_000), (908, "ab\n" * 500 + "ab")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, block string, n_a int")
    figures, pairs = alignment.align(df)
    want, counts, best = plain(docs, libraries)
    assert figures.columns == COLUMNS
    assert sorted(map(tuple, figures.collect()), key=str) == want
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, best[p[1]]) for p, n in counts.items()}
    assert alignment.align(df.limit(0))[0].count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(df)[0].collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_of_equal_hash_stay_apart(monkeypatch):
    pair = alignment.Pair(tokenizer.default_path(), alignment.piece_path())
    units, good = pair.of_words(["one", "two", "\nthree", "Tokenization"])
    names, at, n = pair.groups(units)
    want = [names[i] for i in at]
    calls = []
    real = alignment._mixed
    monkeypatch.setattr(alignment, "_mixed", lambda x: calls.append(1) or (np.zeros_like(x) if len(calls) % 2 else real(x)))
    names, at, m = pair.groups(units)
    assert good.all() and [names[i] for i in at] == want and list(m) == list(n)


def test_whole_table_equals_plain_loops(spark, folder, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op13_tokenizer_alignment(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, libraries)[0]
