"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and itself (the lexicon), hashed; the field's weights for
them and its transitions between languages are learned by gradient steps on sequences that switch between
languages, made of stretches of the labelled sample. Forward-backward gives each word of a text its language's
probability, so code-switched texts are labelled word by word; a text's language has the highest mean
probability over its words with letters.

Emissions are computed once for each distinct word a task sees. Forward-backward runs over chunks of all texts at
once: products of the chunks' transfer matrices carry the messages exactly from chunk to chunk, and from part to part
of a text that is too long to be held at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, crf

HASHED = 1 << 16
#: Bounds of the labelled sample: texts of each language, characters of a text.
PER_LANGUAGE = 250
MAX_CHARS = 6_000
#: Texts of the sample in all.
MOST = 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and where each word's begin: n-grams of 1 to 3 bytes with word ends, prefixes and suffixes
    of 3 and 4 bytes with their word end, and the word."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
    gap = raw == 32
    x = raw.astype(np.uint64)
    owner = np.cumsum(gap) - 1
    numbers, owners = [], []
    h = np.zeros(len(x), np.uint64)
    for n in range(1, min(6, len(x) + 1)):
        m = len(x) - n + 1
        h = h[:m] * np.uint64(257) + x[n - 1 :] + np.uint64(1)
        # A gram may begin or end in a space, but has none inside; from four bytes on it must, as an affix.
        keep = ~gap[:m] if n == 1 else ~np.logical_or.reduce([gap[k : k + m] for k in range(1, n - 1)]) if n > 2 else ~(gap[:m] & gap[1 : 1 + m])
        keep = keep & (owner[:m] < len(words))
        if n > 3:
            keep &= gap[:m] ^ gap[n - 1 :]
        numbers.append(((h * MULTIPLIER + np.uint64(n)) * MULTIPLIER >> np.uint64(48))[keep])
        owners.append(owner[:m][keep])
    starts = np.flatnonzero(gap)[:-1] + 1
    power = np.uint64(0x100000001B3)
    place = np.arange(len(x)) - (starts - 1)[np.minimum(owner, len(words) - 1)]
    value = (x + np.uint64(11)) * (place.astype(np.uint64) * MULTIPLIER | np.uint64(1)) * power
    lexicon = np.add.reduceat(np.where(gap, np.uint64(0), value), starts)
    numbers.append(lexicon * MULTIPLIER >> np.uint64(48))
    owners.append(np.arange(len(words)))
    number, owner = np.concatenate(numbers).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return number[order], np.searchsorted(owner[order], np.arange(len(words)))


def has_letter(words: list[str]) -> np.ndarray:
    return np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))


class Model:
    """languages, feature weights and transitions."""

    def __init__(self, texts: list[str], languages: list[str], seed: int = 1, steps: int = 240, batch: int = 96, length: int = 24):
        self.languages = sorted(set(languages))
        size = len(self.languages)
        self.weights = np.zeros((HASHED, max(size, 1)), np.float32)
        self.transition = np.ones((1, 1))
        if size < 2:
            return
        rng = np.random.default_rng(seed)
        number = {name: k for k, name in enumerate(self.languages)}
        stretches: list[list[list[str]]] = [[] for _ in self.languages]
        for text, name in zip(texts, languages):
            words = [w for w in text.split() if any(map(str.isalpha, w))]
            stretches[number[name]] += [words[i : i + 8] for i in range(0, len(words), 8)]
        pools = [k for k in range(size) if stretches[k]]
        if not pools:
            return
        field = crf.Field(HASHED, size, rate=0.4)
        for _ in range(steps):
            words: list[str] = []
            labels: list[int] = []
            begins: list[bool] = []
            for _ in range(batch):
                mark = len(words)
                while len(words) - mark < length:
                    k = pools[rng.integers(len(pools))]
                    for _ in range(1 + int(rng.random() < 0.7)):
                        part = stretches[k][rng.integers(len(stretches[k]))]
                        words += part
                        labels += [k] * len(part)
                begins += [True] + [False] * (len(words) - mark - 1)
            at, starts = features(words)
            field.update(at, starts, np.array(labels), np.array(begins), batch)
        self.weights, self.transition = field.weights, field.transition()

    def of_words(self, words: list[str]) -> np.ndarray:
        """Emission factors of each word, and whether it has a letter; a word without one says nothing."""
        at, starts = features(words)
        scores = np.add.reduceat(self.weights[at], starts, axis=0)
        e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
        letters = has_letter(words)
        e[~letters] = 1
        return np.hstack([e, letters[:, None]])

    def word_labels(self, text: str) -> list[tuple[str, str, float]]:
        """Each word with its likeliest language and that one's probability."""
        words = text.split()
        if not words or not self.languages:
            return []
        v = self.of_words(words)
        post = crf.forward_backward(v[:, :-1].astype(np.float64), self.transition, np.arange(len(words)) == 0)
        return [(w, self.languages[k], float(p)) for w, k, p in zip(words, post.argmax(axis=1), post.max(axis=1))]

    def predict(self, texts: list[str], table: common.TypeTable) -> tuple[list[str], np.ndarray]:
        size = len(self.languages)
        total = np.zeros((len(texts), size + 1))

        def held(words: list[str]) -> np.ndarray:
            rows = table.rows(words)
            return table.values[rows].astype(np.float64)

        def add(owners: np.ndarray, starts: np.ndarray, post: np.ndarray, v: np.ndarray) -> None:
            letters = v[:, -1:]
            total[owners] += np.add.reduceat(np.hstack([post * letters, letters]), starts, axis=0)

        if size:
            split = [t.split() for t in texts]
            short = [k for k, w in enumerate(split) if 0 < len(w) <= common.GROUP_WORDS]
            low = 0
            while low < len(short):
                high, n = low, 0
                while high < len(short) and n + len(split[short[high]]) <= common.GROUP_WORDS:
                    n += len(split[short[high]])
                    high += 1
                group = short[low:high]
                low = high
                v = held([w for k in group for w in split[k]])
                ends = np.cumsum([len(split[k]) for k in group])
                starts = np.concatenate([[0], ends[:-1]])
                begins = np.zeros(len(v), bool)
                begins[starts] = True
                add(np.array(group), starts, crf.forward_backward(v[:, :-1], self.transition, begins), v)
            for k, words in enumerate(split):
                if len(words) > common.GROUP_WORDS:
                    parts = [words[at : at + common.GROUP_WORDS] for at in range(0, len(words), common.GROUP_WORDS)]
                    posts = crf.carried(len(parts), lambda i: held(parts[i])[:, :-1], self.transition)
                    for part, post in zip(parts, posts):
                        add(np.array([k]), np.array([0]), post, held(part))
        said = total[:, -1] > 0
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        best = mean.argmax(axis=1) if size else np.zeros(len(texts), int)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, said)], np.where(said, mean.max(axis=1, initial=0), 0.0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, most: int = MOST) -> Model:
    """Fits on a bounded sample of each language of rows whose crc32 of the id, mod 4, is not 2.

    Bounds: per_language texts of each language, most texts in all (fewer of each where languages are very many), texts
    of at most max_chars characters. Rows with a null text or language don't enter; of rows equal in id, language and
    text one does. Only keys are shuffled; the sample's texts are fetched by a broadcast of at most `most` keys.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars) & (common.crc_mod("doc_id", 4) != 2))
    names = usable.select("lang").distinct().count()
    if not names:
        return Model([], [])
    ids = usable.select("lang", "doc_id", F.xxhash64("text").alias("_t"))
    chosen = common.bounded_sample(ids, "lang", F.xxhash64("doc_id", "_t", F.lit(11)), max(1, min(per_language, most // names)))
    rows = usable.select("lang", "text", F.xxhash64("text").alias("_t"), F.col("doc_id").alias("_id")).join(
        F.broadcast(chosen.select("lang", F.col("doc_id").alias("_id"), "_t").limit(most).distinct()), ["lang", "_id", "_t"], "left_semi"
    )
    found = rows.select("lang", "_t", "text").dropDuplicates(["lang", "_t"]).toPandas().sort_values(["lang", "_t"])
    return Model(list(found["text"]), list(found["lang"]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred (a learned language, or und) and score (its mean probability over the words) of every row.

    A map over the rows. Null texts, texts without a letter, and all texts when no language was learned are und with
    score 0. With one language learned, other texts get it with score 1. Of languages equally likely the first by name
    is taken. Rows that repeat are labelled each; a null doc_id stays null; further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        names, score = m.predict(batch.column(1).to_pylist(), common.table_of(m, max(1, len(m.languages)) + 1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_slices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents (see identify): und for null and empty texts and those without a letter; rows
    that repeat are labelled each."""
    docs = common.read(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
