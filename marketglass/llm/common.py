"""Helpers shared by the training-data operators: shared-folder tables, bounded samples, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows handed to numpy at once; one very long text then costs no more than itself.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="marketglass-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marketglass/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """At most n rows of each value of key (never null), by the hash in `order`.

    The driver gets one count a key, which must be few (labels, languages). Keys with many rows are thinned by the
    hash where the rows are read, so no exchange and no window task receives a whole key.
    """
    scale = 1 << 20
    shares = [(k, min(1.0, (1.5 * n + 50) / c)) for k, c in df.groupBy(key).agg(F.count(F.lit(1))).collect()]
    share = F.lit(0.0)
    for k, s in shares:
        share = F.when(F.col(key) == F.lit(k), F.lit(s)).otherwise(share)
    thin = df.withColumn("_h", order).filter(F.pmod(F.col("_h"), F.lit(scale)) < share * scale)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_h"))
    return thin.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_h", "_rank")


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, usable: Column, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts on the driver, for fitting a classifier.

    Bounds: per_class rows of each label, texts of at most max_chars characters. Rows with a null text, id
    or label don't enter; of several labels of one id the largest counts; rows are ordered by a hash of the id.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("_y"))
    ids = docs.filter(usable & F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", F.xxhash64("text").alias("_t")).join(known, "doc_id")
    chosen = bounded_sample(ids.groupBy("doc_id", "_y").agg(F.min("_t").alias("_t")), "_y", F.xxhash64("doc_id", F.lit(7)), per_class)
    rows = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(chosen), "doc_id")
        .filter(F.xxhash64("text") == F.col("_t"))
        .select("doc_id", "text", "_y")
        .dropDuplicates(["doc_id"])
        .toPandas()
        .sort_values("doc_id")
    )
    return list(rows["text"]), rows["_y"].to_numpy(dtype=np.int64)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow in slices of SLICE_ROWS rows, whose columns are c0, c1 and so on: columns of any name can be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield fn(batch.slice(at, SLICE_ROWS))

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


class TypeTable:
    """Values by word, kept from batch to batch inside one Python worker.

    compute(words) gives a row of numbers for each word. At `limit` words the table starts anew, so memory is bounded.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int = 100_000):
        self.compute, self.width, self.limit = compute, width, limit
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.zeros((1024, self.width), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row numbers in self.values, one for each word."""
        if len(self.index) > self.limit:
            self.reset()
        index = self.index
        out = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            start = len(index)
            new = list(dict.fromkeys(words[i] for i in missing))
            index.update(zip(new, range(start, start + len(new))))
            if start + len(new) > len(self.values):
                grown = np.zeros((max(2 * len(self.values), start + len(new)), self.width), np.float32)
                grown[:start] = self.values[:start]
                self.values = grown
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                self.values[start + at : start + at + len(part)] = self.compute(part)
            out[missing] = [index[words[i]] for i in missing]
        return out


#: Words handled at once, so that a slice of very long texts costs no more memory than one of short ones.
GROUP_WORDS = 1 << 17


def word_groups(texts: list[str], split: Callable[[str], list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of consecutive texts, at most GROUP_WORDS at once, with the number of the text of each word."""
    words: list[str] = []
    owners: list[np.ndarray] = []
    for k, text in enumerate(texts):
        new = split(text)
        for at in range(0, len(new), GROUP_WORDS):
            part = new[at : at + GROUP_WORDS]
            if words and len(words) + len(part) > GROUP_WORDS:
                yield words, np.concatenate(owners)
                words, owners = [], []
            words.extend(part)
            owners.append(np.full(len(part), k))
    if words:
        yield words, np.concatenate(owners)


def reduce_texts(texts: list[str], split: Callable[[str], list[str]], table: TypeTable, how: np.ufunc, empty: float) -> np.ndarray:
    """For each text, the values of its words reduced by `how` (np.add or np.maximum); `empty` for texts without words."""
    out = np.full((len(texts), table.width), empty, np.float64)
    for words, owners in word_groups(texts, split):
        rows = table.rows(words)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        at = owners[starts]
        part = how.reduceat(table.values[rows], starts, axis=0)
        out[at] = how(out[at], part) if how is np.maximum else out[at] + part
    return out


_kept: list = [None, None]


def kept(key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from batch to batch: one thing at a time, so workers that pass from one operator to
    the next hold the caches of one only. A new key lets the earlier thing go before the new one is built."""
    if _kept[0] is not key and (_kept[0] is None or type(_kept[0]) is not type(key) or _kept[0] != key):
        _kept[:] = [None, None]
        pa.default_memory_pool().release_unused()
        _kept[:] = [key, build()]
    return _kept[1]


def table_of(model: Any, width: int) -> TypeTable:
    """The table of word values of the model that this Python worker uses now."""
    return kept(model, lambda: TypeTable(model.of_words, width))


def spread_copies(groups: DataFrame, n: str, copy: str) -> DataFrame:
    """A row for each of a group's n copies, numbered from 0 in column `copy`; n goes.

    Copies are numbered in blocks, so no row holds an array of all of them.
    """
    block = 4096
    low = groups.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(block).cast("long"))))
    return low.withColumn(copy, F.explode(F.sequence(F.col(copy), F.least(F.col(copy) + (block - 1), F.col(n) - 1)))).drop(n)


def quoted(name: str) -> str:
    """A column's name as it must be written where a dot or a mark in it would be read as syntax."""
    return "`" + name.replace("`", "``") + "`"


def fresh(name: str, columns: list[str]) -> str:
    """name with as many underscores in front as make it differ from all columns, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
