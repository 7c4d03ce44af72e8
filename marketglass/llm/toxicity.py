"""Toxicity: a support vector machine over a gapped subsequence string kernel, with Nyström landmarks.

The kernel of two words is the sum, over the subsequences of three characters (word ends count as characters)
within six places that both have, of decay to the number of places that each spans, divided by a norm for the
words' lengths. So an insult with characters put between its own still shares most of its subsequences.
The kernel of two passages (up to PASSAGE words of one sentence, overlapping) is the same over subsequences of two
and three words within four places. Words and passages are the instances of a text, which is as toxic as its worst
instance; which of a toxic training text's made it so is found by alternating between fitting and choosing the
worst ones (multiple-instance learning). Suspect is what toxic texts hold RATIO times as often as clean ones, so a
quoted insult stays one. The suspect words are also trained with a letter put in, beside clean words treated so.

A machine is linear in the Nyström features of an instance, so its sum over landmarks folds into one weight for each
subsequence, and scoring a word costs a few look-ups, once for each distinct word a task sees.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DECAY = 0.8
#: Distances from the first to the second and the second to the third character of a subsequence.
GAPS = tuple((a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 5)
FEATURES = 1 << 18
#: Characters of a word that are looked at together; longer words are looked at in windows that overlap.
LENGTH, OVERLAP = 22, 8
LANDMARKS = 320
#: Words of toxic texts, and of clean ones, on which the machine is fitted.
WORDS = 12_000
#: Bounds of the labelled sample: texts of each label, characters of a text.
PER_LABEL = 800
MAX_CHARS = 8_000
#: Words of a passage and between the starts of two; gaps of its word pairs and triples from the first word.
PASSAGE, STRIDE = 8, 4
PLACES = ((1,), (2,), (3,), (1, 2), (1, 3), (2, 3))
#: Added to a passage's squared norm, so that one or two words are no full passage.
FLOOR = 7.0
#: A suspect is this many times as frequent in toxic texts as in clean ones; for a passage, in SUPPORT texts at least.
RATIO, SUPPORT = 4, 3
#: Words that get variants with a letter put in, variants of each, and what these cost beside the plain word.
VARIED, VARIANTS, VARIED_COST = 500, 6, 0.3
TOKEN = re.compile(r"\w+|[.!?](?=\s)|\n")
JUNK = re.compile(r"[^\w]+|_+")


def windows_of(word: str) -> list[str]:
    """The word, or overlapping windows of a long one that leave none of its characters out."""
    return [word] if len(word) <= LENGTH else [word[i : i + LENGTH] for i in range(0, len(word) - OVERLAP, LENGTH - OVERLAP)]


def words_of(text: str) -> list[str]:
    """Lower-case words without the marks around and within them; runs of single characters are joined, over tokens
    of marks alone; long words and long runs are cut in windows. Words and runs of one or two characters are left out."""
    out: list[str] = []
    lone: list[str] = []
    for w in text.lower().split():
        if not w.isalnum():
            w = JUNK.sub("", w)
        if len(w) < 2:
            if w:
                lone.append(w)
            continue
        if lone:
            if len(lone) > 2:
                out += windows_of("".join(lone))
            lone = []
        if len(w) > 2:
            out += windows_of(w)
    if len(lone) > 2:
        out += windows_of("".join(lone))
    return out


def codes(words: list[str]) -> np.ndarray:
    """6-bit character codes, one row a word; 0 is beyond the end, 1 either end of the word."""
    wide = np.array(words, dtype=f"<U{LENGTH}").view("<u4").reshape(len(words), LENGTH).astype(np.int64)
    small = np.where(wide == 0, 0, np.where((wide >= 97) & (wide <= 122), wide - 95, 28 + wide % 36))
    out = np.zeros((len(words), LENGTH + 2), np.int64)
    out[:, 0] = 1
    out[:, 1:-1] = small
    lengths = (wide > 0).sum(axis=1)
    out[np.arange(len(words)), lengths + 1] = 1
    return out


def subsequences(c: np.ndarray):
    """For each pair of gaps: feature numbers, whether each is there, and its weight."""
    n = c.shape[1]
    for a, b in GAPS:
        first, second, third = c[:, : n - a - b], c[:, a : n - b], c[:, a + b :]
        yield (first << 12) | (second << 6) | third, (first > 0) & (second > 0) & (third > 0), DECAY ** (a + b - 2)


def norms(c: np.ndarray) -> np.ndarray:
    total = np.full(len(c), 1e-6)
    for _, there, weight in subsequences(c):
        total += there.sum(axis=1) * weight * weight
    return np.sqrt(total)


def used_features(words: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([number[there] for number, there, _ in subsequences(codes(words))]))


def features(words: list[str], used: np.ndarray) -> np.ndarray:
    """Rows of the features `used`; for small numbers of words."""
    c = codes(words)
    slot = np.full(FEATURES, len(used), np.int32)
    slot[used] = np.arange(len(used))
    out = np.zeros((len(words), len(used) + 1), np.float32)
    rows = np.arange(len(words))[:, None]
    for number, there, weight in subsequences(c):
        np.add.at(out, (np.broadcast_to(rows, number.shape)[there], slot[number[there]]), np.float32(weight))
    return out[:, :-1] / norms(c)[:, None].astype(np.float32)


class Numbers(dict):
    """Number of a word; 0 of a mark that ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = n = zlib.crc32(word.encode("utf-8", "replace")) | 1 if word[0].isalnum() or word[0] == "_" else 0
        return n


_numbers = Numbers()


class Passages:
    """The passages of some texts: their owners, and from low to high the places whose subsequences they hold."""

    def __init__(self, texts: list[str]):
        parts, owner = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
        for k, text in enumerate(texts):
            tokens = TOKEN.findall(text.lower())
            parts += [np.fromiter(map(_numbers.__getitem__, tokens), np.uint64, len(tokens)), np.zeros(1, np.uint64)]
            owner.append(np.full(len(tokens) + 1, k))
        self.words = np.concatenate(parts)
        ends = np.flatnonzero(self.words == 0)
        sentence = np.cumsum(self.words == 0) - 1
        first = ends[sentence] + 1
        self.end = np.append(ends, len(self.words))[sentence + 1]
        place = np.arange(len(self.words)) - first
        # A start whose words the one before it holds all is left out.
        self.low = np.flatnonzero((place >= 0) & (place % STRIDE == 0) & ((place == 0) | (self.end - np.arange(len(place)) > PASSAGE - STRIDE)))
        self.high = np.minimum(self.low + PASSAGE, self.end[self.low])
        self.owner = np.concatenate(owner)[self.low]

    def subsequences(self):
        """For each pattern: feature numbers by the place of the first word, whether each is there, and its weight."""
        n, at = len(self.words), np.arange(len(self.words))
        for gaps in PLACES:
            size = max(0, n - gaps[-1])
            h = self.words[:size] * np.uint64(0x9E3779B97F4A7C15)
            for g in gaps:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + self.words[g : g + size]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            number = (h >> np.uint64(46)).astype(np.int64)
            yield number, (self.words[:size] > 0) & (at[:size] + gaps[-1] < self.end[:size]), DECAY ** (gaps[-1] - 1)

    def sums(self, of_place: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(of_place)])
        return total[self.high] - total[self.low]

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        value, norm = np.zeros(len(self.words)), np.zeros(len(self.words))
        for number, there, weight in self.subsequences():
            value[: len(number)] += np.where(there, weights[number], 0.0) * weight
            norm[: len(number)] += there * (weight * weight)
        return self.sums(value) / np.sqrt(self.sums(norm) + FLOOR) + bias

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers (-1: none) of each place, a column a pattern, and the patterns' weights."""
        out, weights = np.full((len(self.words), len(PLACES)), -1, np.int64), []
        for k, (number, there, weight) in enumerate(self.subsequences()):
            out[: len(number), k] = np.where(there, number, -1)
            weights.append(weight)
        return out, np.array(weights, np.float32)


def passage_features(rows: list[np.ndarray], used: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of the features `used` of passages (places x patterns of numbers); for small numbers of passages."""
    slot = np.full(FEATURES, len(used), np.int32)
    slot[used] = np.arange(len(used))
    out = np.zeros((len(rows), len(used) + 1), np.float32)
    for k, r in enumerate(rows):
        there = r >= 0
        w = np.broadcast_to(weights, r.shape)[there]
        np.add.at(out[k], slot[r[there]], w / np.sqrt((w * w).sum() + FLOOR))
    return out[:, :-1]


def with_letter(word: str, rng: np.random.Generator) -> str:
    k = int(rng.integers(1, len(word)))
    return word[:k] + chr(97 + int(rng.integers(0, 26))) + word[k:]


class Machine:
    """The Nyström machine of one kind of instance, over the features of its landmarks."""

    def __init__(self, of_rows: Callable[[list], np.ndarray], marks: list, used: np.ndarray):
        self.of_rows, self.used = of_rows, used
        self.phi = of_rows(marks)
        value, vector = np.linalg.eigh((self.phi @ self.phi.T).astype(np.float64))
        self.root = vector[:, value > 1e-4] / np.sqrt(value[value > 1e-4])
        self.fold = (self.phi.T @ self.root).astype(np.float32)

    def nystroem(self, rows: list) -> np.ndarray:
        parts = [self.of_rows(rows[at : at + 256]) @ self.fold for at in range(0, len(rows), 256)]
        return np.concatenate(parts) if parts else np.zeros((0, self.fold.shape[1]), np.float32)


def fitted(kind: dict, chosen: np.ndarray, often: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """The machine's weights for these suspects, counted so often, against all harmless instances; values of all suspects."""
    if not len(chosen):
        return None, np.full(len(kind["zs"]), -3.0)
    weight = np.zeros(len(kind["zs"]))
    weight[chosen] = often
    varied = weight[kind["of"]] > 0
    cost = np.concatenate([often, weight[kind["of"]][varied] * (VARIED_COST / VARIANTS)])
    z = np.concatenate([kind["zs"][chosen], kind["zv"][varied], kind["zh"]])
    y = np.concatenate([np.ones(len(cost)), -np.ones(len(kind["zh"]))])
    w = squared_hinge(z, y, np.concatenate([cost * (len(kind["zh"]) / cost.sum()), np.ones(len(kind["zh"]))]))
    return w, kind["zs"] @ w[:-1] + w[-1]


class Model:
    """Folded weights of the two machines and their calibration."""

    def __init__(self, texts: list[str], labels: np.ndarray, share: float | None = None, seed: int = 3):
        """share: of label 1 among all labelled rows; by default that of the sample."""
        self.weights, self.bias, self.slope, self.shift = np.zeros(FEATURES, np.float32), 0.0, 1.0, -3.0
        self.passage_weights, self.passage_bias = np.zeros(FEATURES, np.float32), -3.0
        labels = np.asarray(labels)
        if not len(labels) or labels.min() == labels.max():
            self.shift = 3.0 if len(labels) and labels.min() == 1 else -3.0
            return
        rng = np.random.default_rng(seed)
        use = rng.random(len(texts)) < 0.75
        positive, negative = ([t for t, y, u in zip(texts, labels, use) if u and y == k] for k in (1, 0))
        kinds = [k for k in (self._words(positive, negative, rng), self._passages(positive, negative, rng)) if k is not None]
        if not kinds:
            return
        # At first an instance is suspect as often as toxic texts repeat it; later as often as it is a text's worst.
        # Texts of one half are judged by what the other half's taught, so that none is explained by what it alone has.
        half = rng.permutation(len(positive)) % 2
        chosen = [[(np.arange(len(k["zs"])), k["often"])] * 2 for k in kinds]
        for _ in range(4):
            values = [[fitted(k, *chosen[n][1 - h])[1] for h in (0, 1)] for n, k in enumerate(kinds)]
            picked: list[list[list[int]]] = [[[], []] for _ in kinds]
            for bag in range(len(positive)):
                h = half[bag]
                # A text's worst instance counts, and its further ones, and passages, only beyond the margin's middle.
                found = sorted((-values[n][h][i], n, i) for n, k in enumerate(kinds) for i in k["held"][bag] if k["words"] or values[n][h][i] > 0)[:3]
                for rank, (f, n, i) in enumerate(found):
                    if not rank or f < 0:
                        picked[n][h].append(i)
            chosen = [[np.unique(np.array(p, np.int64), return_counts=True) for p in part] for part in picked]
        for k, part in zip(kinds, picked):
            w, _ = fitted(k, *np.unique(np.array(part[0] + part[1], np.int64), return_counts=True))
            m = k["machine"]
            weights, bias = (0.0, -3.0) if w is None else (m.phi.T @ (m.root @ w[:-1]), float(w[-1]))
            if k["words"]:
                self.weights[m.used], self.bias = weights, bias
            else:
                self.passage_weights[m.used], self.passage_bias = weights, bias
        table = common.TypeTable(self.of_words, 1)
        keep = ~use if labels[~use].min(initial=1) != labels[~use].max(initial=0) else use
        worst = self.worst([t for t, u in zip(texts, keep) if u], table)
        seen = labels[keep].mean()
        share = seen if share is None else min(max(share, 1e-3), 1 - 1e-3)
        self.slope, self.shift = platt(worst, labels[keep], np.where(labels[keep] == 1, share / seen, (1 - share) / (1 - seen)) if 0 < seen < 1 else np.ones(len(worst)))

    @staticmethod
    def _words(positive: list[str], negative: list[str], rng: np.random.Generator) -> dict | None:
        """What the alternation needs of words: features of suspects, their variants and harmless ones; suspects of each text."""
        index: dict[str, int] = {}
        dirty_bags, clean_bags = ([np.array([index.setdefault(w, len(index)) for w in sorted(set(words_of(t)))], np.int64) for t in part] for part in (positive, negative))
        names = list(index)
        clean, dirty = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for counts, bags in ((clean, clean_bags), (dirty, dirty_bags)):
            for b in bags:
                counts[b] += 1
        more = dirty - RATIO * clean * (len(positive) / max(1, len(negative)))
        suspects, harmless = np.flatnonzero((dirty > 0) & (more >= 0)), np.flatnonzero((clean > 0) & (more < 0))
        if not len(suspects) or not len(harmless):
            return None
        harmless = rng.permutation(harmless)[:WORDS]
        suspects = suspects[np.argsort(-more[suspects], kind="stable")][:WORDS]
        marks = np.unique(np.concatenate([suspects[: LANDMARKS // 4], rng.choice(suspects, LANDMARKS // 2), rng.choice(harmless, LANDMARKS // 4)]))
        of = np.repeat(np.arange(min(VARIED, len(suspects))), VARIANTS)
        put = [with_letter(names[suspects[i]], rng)[:LENGTH] for i in of]
        marked = [names[i] for i in marks] + put[: LANDMARKS // 4]
        used = used_features(marked)
        m = Machine(lambda rows: features(rows, used), marked, used)
        harmless_put = [with_letter(names[i], rng)[:LENGTH] for i in harmless[: VARIED * VARIANTS]]
        where = {int(i): n for n, i in enumerate(suspects)}
        return {
            "words": True, "machine": m, "zs": m.nystroem([names[i] for i in suspects]), "zv": m.nystroem(put), "of": of, "zh": m.nystroem([names[i] for i in harmless] + harmless_put),
            "held": [[where[int(i)] for i in b if int(i) in where] for b in dirty_bags], "chosen": np.arange(len(suspects)), "often": np.maximum(more[suspects], 0) + 0.05,
        }

    @staticmethod
    def _passages(positive: list[str], negative: list[str], rng: np.random.Generator) -> dict | None:
        """The same of passages; there are no variants."""
        clean, dirty = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for counts, part in ((clean, negative), (dirty, positive)):
            for t in part:
                g = Passages([t]).grid()[0]
                counts[np.unique(g[g >= 0])] += 1
        more = dirty - RATIO * clean * (len(positive) / max(1, len(negative)))
        more[(dirty < SUPPORT) | (more < 0)] = 0
        suspect: list[tuple[float, int, np.ndarray]] = []
        harmless: list[np.ndarray] = []
        each = max(1, WORDS // 2 // max(1, len(negative)))
        for toxic, part in ((True, positive), (False, negative)):
            for bag, t in enumerate(part):
                p = Passages([t])
                g, weights = p.grid()
                rows = [g[a:b] for a, b in zip(p.low, p.high)]
                worth = np.array([more[r[r >= 0]].max(initial=0) for r in rows])
                best = np.argsort(-worth, kind="stable")
                if toxic:
                    suspect += [(worth[i], bag, rows[i].copy()) for i in best[: max(1, WORDS // max(1, len(positive)))] if worth[i] > 0]
                else:
                    # Those most like suspects, and others.
                    harmless += [rows[i].copy() for i in (*best[:each], *rng.permutation(best[each:])[:each])]
        if not suspect or not harmless:
            return None
        harmless = [harmless[i] for i in rng.permutation(len(harmless))[:WORDS]]
        suspect = sorted(suspect, key=lambda x: -x[0])[:WORDS]
        pick = sorted({*range(min(LANDMARKS // 4, len(suspect))), *map(int, rng.integers(0, len(suspect), LANDMARKS // 2))})
        marks = [suspect[i][2] for i in pick] + [harmless[int(i)] for i in rng.integers(0, len(harmless), LANDMARKS // 4)]
        used = np.unique(np.concatenate([r[r >= 0] for r in marks]))
        m = Machine(lambda rows: passage_features(rows, used, weights), marks, used)
        held: list[list[int]] = [[] for _ in positive]
        for n, (_, bag, _) in enumerate(suspect):
            held[bag].append(n)
        zs = m.nystroem([r for _, _, r in suspect])
        return {
            "words": False, "machine": m, "zs": zs, "zv": zs[:0], "of": np.zeros(0, np.int64), "zh": m.nystroem(harmless),
            "held": held, "chosen": np.arange(len(suspect)), "often": np.array([x[0] for x in suspect]),
        }

    def of_words(self, words: list[str]) -> np.ndarray:
        c = codes(words)
        total = np.zeros(len(words))
        for number, there, weight in subsequences(c):
            total += (self.weights[number] * there).sum(axis=1) * weight
        return (total / norms(c) + self.bias)[:, None]

    def worst(self, texts: list[str], table: common.TypeTable) -> np.ndarray:
        """Decision value of each text's worst word or passage; -3 for texts without either."""
        out = common.reduce_texts(texts, words_of, table, np.maximum, -3.0)[:, 0]
        low = 0
        while low < len(texts):
            # About a million characters together; a longer text alone.
            high, size = low + 1, len(texts[low])
            while high < len(texts) and size + len(texts[high]) <= 1 << 20:
                size += len(texts[high])
                high += 1
            p = Passages(texts[low:high])
            np.maximum.at(out, low + p.owner, p.scores(self.passage_weights, self.passage_bias))
            low = high
        return out

    def scores(self, texts: list[str], table: common.TypeTable) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts, table) + self.shift, -30, 30)))


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Weights and bias of the L2 support vector machine, by Newton's method on its active set."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)])
    w = np.zeros(x.shape[1])
    eye = np.eye(len(w)) * ridge * cost.sum() / 2
    eye[-1, -1] = 1e-6
    for _ in range(steps):
        on = y * (x @ w) < 1
        a, c = x[on], cost[on]
        new = np.linalg.solve((a.T @ (a * c[:, None].astype(a.dtype))).astype(np.float64) + eye, a.T.astype(np.float64) @ (c * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def platt(f: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic calibration of rows of that cost: slope and shift."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        r, d = cost * (p * (1 - p) + 1e-6), cost * (y - p)
        h = np.array([[(r * f * f).sum() + 0.5, (r * f).sum()], [(r * f).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * f).sum() - 0.5 * (a - 1), d.sum()])
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return max(a, 0.1), b


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """Fits on a bounded sample of rows whose crc32 of the id, mod 4, is not 2.

    Bounds: per_label texts of each label of at most max_chars characters; of these at most WORDS words and WORDS
    passages of either kind become instances.
    """
    known = common.crc_mod("doc_id", 4) != 2
    share = labels.filter(known).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return Model(*common.labelled_texts(docs, labels, "toxic", known, per_label, max_chars), share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) of every row.

    A map over the rows. Null and empty texts get the lowest decision value. Rows that repeat are scored each; a
    null doc_id stays null; further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(batch.column(1).to_pylist(), common.table_of(m, 1)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = common.map_slices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents (see score): null and empty texts get the lowest decision value, rows that repeat are
    scored each, equal texts alike."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
