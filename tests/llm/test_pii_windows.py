"""Windows of the field: every written-out form is seen, words stay whole, and decoding equals that of whole texts."""

from marketglass.llm import pii


def test_windows_decode_like_whole_texts():
    class Whole(pii.Model):
        def windows(self, text):
            return [(0, len(text))] if text else []

    m = pii.Model()
    whole = Whole.__new__(Whole)
    whole.__dict__.update(m.__dict__)
    forms = ["max punkt at web punkt de", "jo at mail\ndot org", "maria\nat post point org", "lee at web punto es", "kim (at) example (dot) net", "jo at mail dot org", "call 319-555-5132 now"]
    pad = "worte ohne zeichen und ohne zahlen stehen hier in langer reihe " * 5
    texts = [f"{pad}schreib an {f} bitte {pad}" for f in forms]
    got = m.added(texts, [[] for _ in texts])
    assert got == whole.added(texts, [[] for _ in texts])
    # The field itself finds these; what it misses in whole texts it misses here too.
    assert [texts[k][a:b] for k in (1, 4, 5, 6) for _, a, b in got[k]] == ["jo at mail\ndot org", "kim (at) example (dot) net", "jo at mail dot org", "319-555-5132"]
    near = ["schreib an max punkt at web punkt de bitte", "mail maria at post point org soon", "lee at web punto es"]
    assert m.added(near, [[]] * 3) == whole.added(near, [[]] * 3)


def test_windows_end_at_white_space():
    m = pii.Model.__new__(pii.Model)
    text = "wordswordswords " * 20 + "9 " + "wordswordswords " * 20
    for a, b in m.windows(text):
        assert (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace())
    assert m.windows("x" * 200 + "9" + "x" * 200) == [(0, 401)]
    assert m.windows("a" * 100) == []


def test_long_runs_are_seen_whole():
    """Spans far longer than the reach of a cue, in long texts."""
    m = pii.Model()
    pad = "worte ohne zeichen und ohne zahlen stehen hier in langer reihe " * 40
    names = " dot ".join(["maria", "lopez", "gonzalez", "fernandez"] * 8)
    address = f"{names} at post dot org"
    digits = "4 1 1 1 - " * 3 + "1 1 1 1"
    text = f"{pad}write to {address} soon {pad} pay with {digits} now {pad}"
    spread = m.windows(text)
    for part in (address, digits):
        a = text.index(part)
        assert len(part) > 30 and any(low <= a and a + len(part) <= high for low, high in spread)
    assert address in [text[a:b] for _, a, b in m.added([text], [[]])[0]]


def test_every_rule_span_and_cue_is_in_a_window():
    import random

    rng = random.Random(1)
    m = pii.Model.__new__(pii.Model)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "at", " ", " ", ".", "@", "dot", "7", "12", "-", "(", ")", "+", "\n", "x" * 60, "Punkt"]) for _ in range(rng.randrange(40)))
        spread = m.windows(text)
        assert all(a < b for a, b in spread) and all(x[1] < y[0] for x, y in zip(spread, spread[1:]))
        for c in pii.CUE.finditer(text):
            assert any(a <= c.start() and c.end() <= b for a, b in spread)


def test_time_grows_with_the_text_only():
    """Texts that once took the square of their length."""
    import base64
    import random
    import time

    m = pii.Model()
    made = {
        "dots": lambda n: "at 5 " + "a." * (n // 2), "hyphens": lambda n: "at 5 " + "a-" * (n // 2), "base64": lambda n: base64.urlsafe_b64encode(random.Random(1).randbytes(n * 3 // 4)).decode(),
        "addresses": lambda n: "a at b dot " * (n // 11), "brackets": lambda n: "1" + "(" * n, "ones": lambda n: "1 " * (n // 2), "signs": lambda n: "a@" * (n // 2), "spaces": lambda n: "a" + " " * n + "at b",
    }
    for name, make in made.items():
        times = []
        for n in (75_000, 300_000):
            best = []
            for _ in range(2):
                began = time.perf_counter()
                pii._find(m, [make(n)])
                best.append(time.perf_counter() - began)
            times.append(min(best))
        assert times[1] < 8 * times[0] + 0.2 and times[1] < 15, (name, times)


def test_ranges_and_places_are_left_alone():
    m = pii.Model()
    for text in ("look at example dot com", "have a look at example dot com now", "100-2000", "see pages 100-2000 there", "from 100-2000 items"):
        assert m.added([text], [[]]) == [[]]
    for text, span in (("write to jo at mail dot org please", "jo at mail dot org"), ("call 319-555-5132 now", "319-555-5132"), ("ring 555-0134 now", "555-0134")):
        assert [text[a:b] for _, a, b in m.added([text], [[]])[0]] == [span]
