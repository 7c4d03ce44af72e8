"""Toxicity looks at every character and at every sentence of a text."""

import random

import numpy as np

from marketglass.llm import common, toxicity


def test_runs_of_single_characters_are_read_whole():
    run = "youreallyareanawfulandquiteuselessidiot"
    spaced = toxicity.words_of(" ".join(run))
    assert spaced == toxicity.words_of(run) and len(spaced) > 1
    assert spaced[0].startswith("you") and spaced[-1].endswith("idiot")
    assert toxicity.words_of("such an i - d - i - o - t here") == ["such", "idiot", "here"]
    assert toxicity.words_of("a b then c") == ["then"]


def ordinary(rng, n=60):
    words = "we will find out where you and they sleep tonight when the old house is near water then come back with more good bread for all".split()
    return [rng.choice(words) for _ in range(n)]


def texts_with(rng, part, n):
    out = []
    for _ in range(n):
        w = ordinary(rng)
        if part:
            w.insert(rng.randrange(len(w)), f". {part}.")
        out.append(" ".join(w))
    return out


def caught(model, texts):
    return np.mean(np.array(model.scores(texts, common.TypeTable(model.of_words, 1))) >= 0.3)


def test_threats_of_ordinary_words_are_found():
    rng = random.Random(3)
    threat = "tonight we come where you sleep"
    texts = texts_with(rng, threat, 120) + texts_with(rng, "", 240)
    m = toxicity.Model(texts, np.array([1] * 120 + [0] * 240))
    assert caught(m, texts_with(rng, threat, 60)) > 0.9
    assert caught(m, texts_with(rng, "", 60)) < 0.1


def test_an_insult_that_a_clean_text_quotes_is_found():
    rng = random.Random(4)
    texts = texts_with(rng, "what a moron", 120) + texts_with(rng, "moron", 3) + texts_with(rng, "", 237)
    m = toxicity.Model(texts, np.array([1] * 120 + [0] * 240))
    assert caught(m, texts_with(rng, "so a moron", 60)) > 0.9
    assert caught(m, texts_with(rng, "", 60)) < 0.1
