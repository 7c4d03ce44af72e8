"""Classifiers and fields against plain loops: the string kernel, neighbours' votes, forward-backward over whole texts."""

import itertools
import random

import numpy as np
import pytest

from marketglass.llm import common, crf, language_id, packing, quality, simhash, toxicity


def test_the_kernel_is_a_sum_over_gapped_subsequences():
    """The product of two words' features is the explicit sum over triples of places within six, divided by both norms."""

    def explicit(x, y):
        def found(word):
            s = "^" + word + "$"
            out = {}
            for i, j, k in itertools.combinations(range(len(s)), 3):
                if j - i <= 4 and k - j <= 4 and k - i <= 5:
                    # Either end counts as the same character.
                    key = (s[i] + s[j] + s[k]).replace("$", "^")
                    out.setdefault(key, []).append(toxicity.DECAY ** (k - i - 2))
            return out

        a, b = found(x), found(y)
        norm = lambda f: sum(w * w for ws in f.values() for w in ws) ** 0.5
        return sum(sum(a[key]) * sum(b[key]) for key in a.keys() & b.keys()) / (norm(a) * norm(b))

    words = ["idiot", "idxiot", "iiddiioott", "stupid", "studio", "moron", "pathetic", "patetic", "losers"]
    used = toxicity.used_features(words)
    f = toxicity.features(words, used).astype(float)
    for (i, x), (j, y) in itertools.combinations(enumerate(words), 2):
        assert f[i] @ f[j] == pytest.approx(explicit(x, y), rel=1e-4), (x, y)
    assert explicit("idiot", "idxiot") > 2 * explicit("idiot", "stupid")


def test_folded_weights_equal_the_features():
    rng = np.random.default_rng(0)
    m = toxicity.Model([], np.array([]))
    words = ["idiot", "wonderful", "a" * 22, "xyz"]
    used = toxicity.used_features(words)
    m.weights[used] = rng.normal(size=len(used)).astype(np.float32)
    want = toxicity.features(words, used) @ m.weights[used]
    assert np.allclose(m.of_words(words)[:, 0], want + m.bias, atol=1e-4)


def test_votes_equal_a_plain_loop_over_neighbours():
    rng = random.Random(2)
    pools = (["good", "clear", "prose", "with", "sense", "and", "order"], ["x7#", "click", "!!", "9-9", "free$", "zzz"])
    texts = [" ".join(rng.choice(pools[k % 2]) for _ in range(rng.randrange(3, 30))) for k in range(80)]
    labels = np.array([1 - k % 2 for k in range(80)])
    m = quality.Model(texts, labels)
    asked = [*(" ".join(rng.choice(pools[0] + pools[1]) for _ in range(12)) for _ in range(20)), "", texts[0], texts[0]]
    got = m.scores(asked, common.TypeTable(m.of_words, quality.RANK))
    for text, score in zip(asked, got):
        x = sum((m.of_words([w])[0].astype(float) for w in text.split()), np.zeros(quality.RANK))
        if not text:
            assert score == m.prior
            continue
        cosine = [float(x @ v / np.linalg.norm(x)) for v in m.labelled]
        best = sorted(range(80), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        bar = cosine[best[-1]]
        if sum(abs(c - bar) < 1e-5 for c in cosine) > 1:
            # Equally near neighbours at the bar: any of them may vote.
            assert 0 <= score <= 1
            continue
        votes = [max(cosine[k], 0) ** quality.POWER for k in best]
        assert score == pytest.approx(sum(v for v, k in zip(votes, best) if labels[k]) / sum(votes), abs=1e-3)
    assert got[-1] == got[-2]


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(6)
    words = {"en": "the and house water with over there".split(), "de": "und das haus wasser mit über dort".split(), "es": "el y la casa agua con allí".split()}
    texts = [(" ".join(rng.choice(words[k]) for _ in range(30)), k) for k in words for _ in range(12)]
    return words, language_id.Model([t for t, _ in texts], [k for _, k in texts], steps=60)


def plain_posterior(e, t):
    alpha, beta = [e[0] / len(t)], [np.ones(len(t))]
    for k in range(1, len(e)):
        x = alpha[-1] @ t * e[k]
        alpha.append(x / x.sum())
    for k in range(len(e) - 1, 0, -1):
        x = t @ (e[k] * beta[-1])
        beta.append(x / x.sum())
    p = np.array(alpha) * np.array(beta[::-1])
    return p / p.sum(axis=1, keepdims=True)


def test_predictions_equal_a_plain_chain_at_any_block_size(languages, monkeypatch):
    """A text longer than a block gets the labels of one chain over all of it."""
    words, m = languages
    rng = random.Random(7)
    every = sum(words.values(), []) + ["42", "--"]
    texts = [" ".join(rng.choice(every) for _ in range(n)) for n in (1, 5, 63, 64, 65, 700, 1500)] + ["", "42 --"]
    table = common.TypeTable(m.of_words, len(m.languages) + 1)
    want = []
    for text in texts:
        v = m.of_words(text.split()) if text else np.zeros((0, 4))
        if not len(v) or not v[:, -1].sum():
            want.append(("und", 0.0))
            continue
        p = plain_posterior(v[:, :-1].astype(np.float32).astype(float), m.transition)
        mean = (p * v[:, -1:]).sum(axis=0) / v[:, -1].sum()
        want.append((m.languages[mean.argmax()], mean.max()))
    for size in (1 << 17, 128):
        monkeypatch.setattr(common, "GROUP_WORDS", size)
        names, score = m.predict(texts, table)
        assert names == [n for n, _ in want]
        assert np.allclose(score, [s for _, s in want], atol=1e-5)


def test_pair_marginals_of_training_are_exact():
    """The gradient of the transitions agrees with differences of the chain's log-likelihood."""
    rng = np.random.default_rng(3)
    y, begins = np.array([0, 1, 1, 2, 0, 2]), np.array([True, False, False, True, False, False])
    field = crf.Field(8, 3, rate=0.0)
    field.weights[:] = rng.normal(size=field.weights.shape)
    field.logits[:] = rng.normal(size=(3, 3))
    at, starts = rng.integers(0, 8, 12), np.arange(0, 12, 2)
    e = field.factors(at, starts)

    def likelihood(logits):
        t, total = np.exp(logits), 0.0
        for a, b in ((0, 3), (3, 6)):
            paths = {}
            for path in itertools.product(range(3), repeat=b - a):
                paths[path] = np.prod([e[a + k, path[k]] for k in range(b - a)]) * np.prod([t[path[k - 1], path[k]] for k in range(1, b - a)])
            total += np.log(paths[tuple(y[a:b])] / sum(paths.values()))
        return total

    seen = field._seen_t.copy()
    field.update(at, starts, y, begins, 1)
    got = np.sqrt(field._seen_t - seen)
    for i, j in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[i, j] = 1e-5
        slope = (likelihood(field.logits + step) - likelihood(field.logits - step)) / 2e-5
        assert got[i, j] == pytest.approx(abs(slope), abs=1e-4)


def test_long_texts_of_many_words(languages):
    words, m = languages
    rng = random.Random(1)
    text = " ".join(rng.choice(words["de"]) for _ in range(300_000))
    names, score = m.predict([text, "the house"], common.TypeTable(m.of_words, 4))
    assert names[0] == "de" and 0.5 < score[0] <= 1 and names[1] == "en"


def test_fingerprints_are_shown_as_sixteen_hex_digits(spark, tmp_path):
    texts = [(1, "a b c d e f"), (2, None), (3, "Alpha beta"), (4, "alpha  BETA")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_near_dedup(spark, str(tmp_path)).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: format(simhash.fingerprint(t or ""), "016x") for i, t in texts}
    assert got[2][0] == "0" * 16 and got[3][0] == got[4][0] and got[4][1] == 3


@pytest.mark.parametrize("kind", ["lognormal", "some fit", "few fit"])
def test_packing_is_never_worse_than_best_fit_over_all_pieces(spark, kind):
    """Several shards, so that loose sequences of all must come together."""
    rng = np.random.default_rng(5)
    n = 4000
    sizes = {"lognormal": np.clip(rng.lognormal(6.2, 0.8, n), 1, 2047).astype(int), "some fit": rng.integers(200, 1001, n), "few fit": rng.integers(600, 1001, n)}[kind].tolist()
    df = spark.createDataFrame([(k, 0, 0, x, 0) for k, x in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(df, shard_items=1000).select("doc_id", "sequence_id", "offset", "length").collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(x for _, x in rows[:k]) for k in range(len(rows))] and sum(x for _, x in rows) <= 2048
    plain = packing.best_fit(sorted(range(n), key=lambda i: -sizes[i]), [], sizes, 2048)
    assert len(by) <= len(plain.bins)
