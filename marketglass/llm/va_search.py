"""Exact top-k inner-product search by vector-approximation files.

The approximation file holds one small cell number (a byte) for each component, in cells of a width of each vector's
own, and only it meets all queries: its cells give an upper and a lower bound of each product. Candidates whose upper
bound k others' lower bounds beat are out. The exact vectors are then read of the few that are left, and multiplied
in the order of their bounds until no bound is left that could reach the kth best product.

Blocks of cells are replicated once for each block of queries, and (query block, slot) is the key that deals them
out, so no task sees one key's rows only. Of equal vectors only the k + 1 with the smallest ids can be answers, so
further copies are left out beforehand, by a rank that is limited before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_ROWS = 4096
#: Candidates that are bounded against a block of queries at once.
SCAN_ROWS = 512
#: Scaled components from here on are beyond exact doubles: such vectors have no bounds and are always read.
LARGE = float(1 << 53)
LONG = 1 << 63


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (int8) of whole numbers below LARGE, and each row's width: the smallest power of two that fits."""
    most = np.abs(x).max(axis=1, initial=0)
    width = 2.0 ** np.ceil(np.log2(np.maximum((most + 1) / 127, 1)))
    return np.floor(x / width[:, None]).astype(np.int8), width


def bounds(q: np.ndarray, cell: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds (queries, candidates) of the products of q with the vectors in these cells.

    A component lies in [cell * width, cell * width + width - 1]. Sums that doubles hold exactly need no slack.
    """
    middle = cell * width[:, None] + ((width - 1) / 2)[:, None]
    about = q @ middle.T
    half = np.abs(q).sum(axis=1)[:, None] * ((width - 1) / 2)[None, :]
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(middle, axis=1)[None, :]
    slack = np.where(size + half < 2.0**50, 0.0, 1e-11 * (size + half))
    return about + half + slack, about - half - slack


class Queries:
    """One block of queries and the candidates that are left for each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.sound = np.abs(x).max(axis=1, initial=0) < LARGE
        self.x = np.where(self.sound[:, None], x, 0.0)
        self.least = np.full((len(ids), k), -np.inf)
        self.left: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def scan(self, ids: np.ndarray, cell: np.ndarray, width: np.ndarray) -> None:
        """width 0 stands for a vector without bounds."""
        for at in range(0, len(ids), SCAN_ROWS):
            part = slice(at, at + SCAN_ROWS)
            open_ = width[part] == 0
            up, low = bounds(self.x, cell[part].astype(np.float64), np.where(open_, 1.0, width[part]))
            up[:, open_], low[:, open_] = np.inf, -np.inf
            up[~self.sound], low[~self.sound] = np.inf, -np.inf
            own = self.ids[:, None] == ids[part][None, :]
            up[own], low[own] = -np.inf, -np.inf
            both = np.concatenate([self.least, low], axis=1)
            self.least = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
            kth = self.least.min(axis=1)
            q, c = np.nonzero((up >= kth[:, None]) & ~own)
            self._keep(q, ids[part][c], up[q, c], low[q, c])

    def _keep(self, q: np.ndarray, ids: np.ndarray, up: np.ndarray, low: np.ndarray) -> None:
        self.left.append((q, ids, up, low))
        if sum(len(x[0]) for x in self.left) > 64 * self.k * (len(self.ids) + 64):
            self.left = [self._pruned()]

    def _pruned(self) -> tuple[np.ndarray, ...]:
        q, ids, up, low = (np.concatenate(c) for c in zip(*self.left)) if self.left else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        # k others are certain to be at least as good, and of smaller ids where they are equal.
        order = np.lexsort((ids, -low, q))
        q, ids, up, low = q[order], ids[order], up[order], low[order]
        starts = np.searchsorted(q, np.arange(len(self.ids) + 1))
        kth = starts[:-1] + self.k - 1
        has = kth < starts[1:]
        bar, bar_id = np.full(len(self.ids), -np.inf), np.full(len(self.ids), np.iinfo(np.int64).max)
        bar[has], bar_id[has] = low[kth[has]], ids[kth[has]]
        stay = (up > bar[q]) | ((up == bar[q]) & (ids <= bar_id[q])) | (bar[q] == -np.inf)
        return q[stay], ids[stay], up[stay], low[stay]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids, upper and lower bounds."""
        q, ids, up, low = self._pruned()
        return self.ids[q.astype(np.int64)], ids, up, low


def product(q: list[float], v: list[float], scale: float) -> int:
    """The exact product of the scaled vectors, held at the bounds of 64 bits."""
    a, b = scaled(np.array(q), scale), scaled(np.array(v), scale)
    if np.isfinite(a).all() and np.isfinite(b).all():
        if np.abs(a) @ np.abs(b) < 2.0**53:
            return int(a @ b)
        total = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))
    else:
        # Scaled beyond doubles: whole numbers already, so scaled in integers.
        total = sum(_whole(x, scale) * _whole(y, scale) for x, y in zip(q, v))
    return min(max(total, -LONG), LONG - 1)


def _whole(x: float, scale: float) -> int:
    a, b = x.as_integer_ratio()
    c, d = float(scale).as_integer_ratio()
    return a * c // (b * d)


class Reader:
    """Reads exact vectors of one query after another, best bound first, and stops where the kth score is certain."""

    def __init__(self, k: int, scale: float):
        self.k, self.scale, self.query, self.best, self.read = k, scale, None, [], 0

    def take(self, query: int, vec: int, up: float, q: list[float], v: list[float]) -> Iterator[tuple[int, int, int, int]]:
        if query != self.query:
            yield from self.done()
            self.query, self.best = query, []
        if len(self.best) < self.k or up >= self.best[-1][1] * (1 - 1e-12 if self.best[-1][1] > 0 else 1 + 1e-12):
            self.read += 1
            self.best.append((vec, product(q, v, self.scale)))
            self.best.sort(key=lambda b: (-b[1], b[0]))
            del self.best[self.k :]

    def done(self) -> Iterator[tuple[int, int, int, int]]:
        for rank, (vec, score) in enumerate(self.best, 1):
            yield self.query, rank, vec, score


def approximation(vectors: DataFrame, scale: float) -> DataFrame:
    """Blocks of at most BLOCK_ROWS vectors (id, v) of one dimension: dim, n, ids, width, cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _blocks(batch, scale):
                large = ~(np.abs(x).max(axis=1, initial=0) < LARGE)
                cell, width = cells(np.where(large[:, None], 0.0, x))
                width[large] = 0
                yield pa.RecordBatch.from_pydict({"dim": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "width": pa.array([width.tobytes()], pa.binary()), "cells": pa.array([cell.tobytes()], pa.binary())})

    return vectors.mapInArrow(run, "dim int, n int, ids binary, width binary, cells binary")


def _blocks(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(at, BLOCK_ROWS)
        ids, lists = part.column(0).to_numpy(zero_copy_only=False).astype("<i8"), part.column(1)
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            yield ids[rows], scaled(values[starts[rows][:, None] + np.arange(dim)], scale)


def _sound(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v of rows that take part."""
    v: Column = F.col(common.quoted(vector))
    fine = v.isNotNull() & F.col(common.quoted(id_column)).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(fine).select(F.col(common.quoted(id_column)).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding", query_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of floor(scale * x) for each query row.

    Ties go to the smaller vec_id; with fewer than k candidates all are returned. Vectors that are null or hold null
    or non-finite components, and rows without an id, take no part; a query meets vectors of its own dimension only, as
    no product with others exists. A query's own row is told by its id: rows that repeat its id are not its
    candidates; others that repeat are candidates each. Query rows that repeat an id are answered once, for the
    smallest of its vectors. Finite components of any size are multiplied exactly; only a score beyond 64 bits is
    held at their bounds. Empty tables give no rows. Further columns, of any name, are left out.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _sound(queries, id_column, vector).groupBy("id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // query_rows))
    slots = max(1, -(-2 * parts // groups))
    given = _sound(vectors, id_column, vector).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # Copies of a vector beyond its k + 1 smallest ids are no answers (one of these may be the query's own row).
    often = common.materialize(given.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select("h1", "h2"))
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    copies = given.join(often, ["h1", "h2"], "left_semi").withColumn("r", first).filter(F.col("r") <= k + 1).select("id", "v")
    few = given.join(often, ["h1", "h2"], "left_anti").select("id", "v").unionByName(copies)
    file = common.materialize(approximation(few, scale))
    packed = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(groups, "g")

    def of_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _blocks(batch.select([1, 2]), scale):
                yield pa.RecordBatch.from_pydict({"g": pa.array([batch.column(0)[0].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "width": pa.array([b""], pa.binary()), "cells": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    blocks = packed.select("g", "id", "v").mapInArrow(of_queries, "g int, dim int, n int, ids binary, width binary, cells binary").withColumn("slot", every).withColumn("kind", F.lit(0))
    dealt = file.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int")).withColumn("kind", F.lit(1))
    names = ["g", "slot", "kind", "dim", "n", "ids", "width", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def left() -> Iterator[pa.RecordBatch]:
            for h in held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in h.rows()], ["query_id", "vec_id", "up", "low"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["g"], row["slot"]) != key:
                    yield from left()
                    key, held = (row["g"], row["slot"]), []
                ids = np.frombuffer(row["ids"], "<i8")
                if row["kind"] == 0:
                    held.append(Queries(ids, np.frombuffer(row["cells"], "<f8").reshape(row["n"], row["dim"]), k))
                else:
                    for h in held:
                        if h.x.shape[1] == row["dim"]:
                            h.scan(ids, np.frombuffer(row["cells"], np.int8).reshape(row["n"], row["dim"]), np.frombuffer(row["width"], "<f8"))
        yield from left()

    met = blocks.select(*names).unionByName(dealt.select(*names)).repartition("g", "slot").sortWithinPartitions("g", "slot", "kind")
    part = common.materialize(met.mapInArrow(run, "query_id long, vec_id long, up double, low double"))
    # The kth lower bound over all slots.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc(), "vec_id"))
    bar = F.max(F.when(F.col("r") == k, F.col("low"))).over(Window.partitionBy("query_id"))
    final = part.withColumn("r", rank).withColumn("bar", bar).filter(F.col("bar").isNull() | (F.col("up") >= F.col("bar")))
    # Of rows that repeat an id each is read, under the highest of their bounds.
    final = final.groupBy("query_id", "vec_id").agg(F.max("up").alias("up"))
    exact = final.join(few.withColumnRenamed("id", "vec_id"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = exact.filter(F.size("q") == F.size("v")).select("query_id", "vec_id", "up", "q", "v")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(k, scale)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))
                yield out([x for r in rows for x in reader.take(*r)])
        yield out(list(reader.done()))

    ordered = exact.repartition(parts, "query_id").sortWithinPartitions("query_id", F.col("up").desc(), "vec_id")
    return ordered.mapInArrow(read, "query_id long, rank int, vec_id long, score long")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose id is divisible by 50 (see top_k): null vectors and those with null or
    non-finite components take no part, ties go to the smaller id, rows that repeat are candidates each."""
    vectors = common.read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
