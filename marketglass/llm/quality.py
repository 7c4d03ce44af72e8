"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

Terms are the shapes of words and their character trigrams. A truncated singular value decomposition of the
labelled sample's term weights gives each term a latent vector; a text's vector is the weighted sum over all its
words. Labelled vectors are broadcast (their number is a parameter), and every text is compared with all of them
by blocked cosine products. The nearest vote with a power of their similarity.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TERMS = 1 << 13
RANK = 48
NEIGHBOURS = 15
POWER = 8
#: Scores from here on are label 1.
THRESHOLD = 0.3
#: Bounds of the labelled sample: texts of each label, characters of a text.
PER_LABEL = 1500
MAX_CHARS = 20_000
#: How much a shape counts beside a trigram.
SHAPE_WEIGHT = 4.0
_SHAPES = np.arange(256, dtype=np.uint8)
for _c in range(256):
    _SHAPES[_c] = ord("x") if chr(_c).islower() or _c >= 0x80 else ord("X") if chr(_c).isupper() else ord("9") if chr(_c).isdigit() else _c
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def terms(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, their weights, and the number of the word of each, for all words; words in order."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
    gap = raw == 32
    low = _LOWER[raw].astype(np.int64)
    owner = np.cumsum(gap) - 1
    three = (low[:-2] * 961 + low[1:-1] * 31 + low[2:]) * 0x9E3779B1 >> 7
    inside = ~gap[1:-1]
    tri, tri_owner = three[inside] % (TERMS // 2), owner[1:-1][inside]
    shape = _SHAPES[raw]
    fresh = np.flatnonzero(~gap & (np.concatenate([[True], (shape[1:] != shape[:-1]) | gap[:-1]])))
    # A word's shape is the run-free sequence of its classes, hashed by position so that order counts.
    first = np.flatnonzero(gap)[:-1]
    rank = np.arange(len(fresh)) - np.searchsorted(fresh, first)[owner[fresh]]
    h = np.zeros(len(words), np.int64)
    np.add.at(h, owner[fresh], (shape[fresh].astype(np.int64) + 7) * (0x85EBCA6B * (2 * rank + 1) & 0xFFFFFFFF))
    shapes = TERMS // 2 + (h * 0x9E3779B1 >> 9) % (TERMS // 2)
    number = np.concatenate([tri, shapes])
    weight = np.concatenate([np.ones(len(tri), np.float32), np.full(len(words), SHAPE_WEIGHT, np.float32)])
    return number, weight, np.concatenate([tri_owner, np.arange(len(words))])


class Model:
    """Term vectors, and the labelled texts' vectors with their labels."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 5):
        labels = np.asarray(labels)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        self.vectors, self.labelled = np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32)
        if not texts:
            return
        a = np.zeros((len(texts), TERMS), np.float32)
        for k, text in enumerate(texts):
            words = text.split()
            for at in range(0, len(words), common.GROUP_WORDS):
                number, weight, _ = terms(words[at : at + common.GROUP_WORDS])
                a[k] += np.bincount(number, weight, TERMS)
        a /= np.maximum(1, a.sum(axis=1, keepdims=True))
        self.idf = np.log((1 + len(texts)) / (1 + (a > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        a *= self.idf
        rng = np.random.default_rng(seed)
        rank = min(RANK, max(1, len(texts)))
        y = a @ rng.standard_normal((TERMS, rank + 16)).astype(np.float32)
        for _ in range(3):
            y = a @ (a.T @ np.linalg.qr(y)[0])
        q = np.linalg.qr(y)[0]
        _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
        vectors = np.zeros((TERMS, RANK), np.float32)
        vectors[:, : min(rank, len(vt))] = vt[:rank].T
        self.vectors = vectors * self.idf[:, None]
        self.labelled = self.unit(a @ vectors)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def of_words(self, words: list[str]) -> np.ndarray:
        number, weight, owner = terms(words)
        order = np.argsort(owner, kind="stable")
        rows = self.vectors[number[order]] * weight[order][:, None]
        return np.add.reduceat(rows, np.searchsorted(owner[order], np.arange(len(words))), axis=0)

    def scores(self, texts: list[str], table: common.TypeTable) -> np.ndarray:
        """Share of the nearest labelled texts' votes for label 1; the sample's share where a text has no words."""
        x = self.unit(common.reduce_texts(texts, str.split, table, np.add, 0.0))
        if not len(self.labelled):
            return np.full(len(texts), self.prior)
        near = x @ self.labelled.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0) ** POWER
        total = weight.sum(axis=1)
        out = np.where(total > 0, (weight * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-30), self.prior)
        return np.clip(out, 0, 1).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """Fits on a bounded sample of rows whose crc32 of the id, mod 5, is not 0."""
    return Model(*common.labelled_texts(docs, labels, "quality", common.crc_mod("doc_id", 5) != 0, per_label, max_chars))


def classify(docs: DataFrame, model: Model, *keep: str, score: str = "score") -> DataFrame:
    """doc_id, the columns `keep` and the score (0 to 1, higher: label 1 likelier; in column `score`) of every row.

    A map over the rows. Null and empty texts, and any text when nothing was labelled, get the labelled sample's
    share of label 1 (0.5 without a sample). Rows that repeat are scored each; a null doc_id stays null.
    """
    names = ["doc_id", *keep]
    sent_names = names if "text" in names else [*names, "text"]
    at = sent_names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        s = m.scores([t or "" for t in batch.column(at).to_pylist()], common.table_of(m, RANK))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s)], [*names, score])

    kinds = ", ".join(f"{common.quoted(n)} {docs.schema[n].dataType.simpleString()}" for n in names)
    return common.map_slices(docs.select(*map(common.quoted, sent_names)), run, f"{kinds}, {score} double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents (see classify): null and empty texts get the sample's share of label 1, rows that
    repeat are scored each, equally near neighbours count in the order of the sample."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
