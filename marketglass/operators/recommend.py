"""Recommendations from what others buy: implicit alternating least squares on blocks.

Each customer's purchases are one weight a product, damped by a logarithm, so that a customer with very many orders
makes as many rows as products bought and never pairs of products.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Weights in a piece, about: what a task holds at once is a few times their number times the rank.
PIECE = 1 << 20
#: Factors in a row of a table of factors.
CHUNK = 1 << 14


def tastes(sales: DataFrame) -> DataFrame:
    """org_id, product_id, weight: log2(1 + units bought). Null ids and units of 0 or less take no part."""
    units = sales.filter("org_id is not null and product_id is not null").groupBy("org_id", "product_id").agg(F.sum("quantity").alias("units"))
    return units.filter("units > 0").select(F.col("org_id").cast("int"), F.col("product_id").cast("int"), F.log2(1 + F.col("units")).cast("float").alias("weight"))


@dataclass
class Table:
    """A table in the shared folder that tasks read by themselves, row by row: `files` are its URIs in the order of its partitions."""

    path: str
    files: list[str]


def _keep(df: DataFrame, codec: str) -> Table:
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return Table(path, sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()))


def _drop(spark: SparkSession, table: Table) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(table.path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _rows(uri: str, *columns: str) -> Iterator[tuple]:
    """The rows of a file, a few at a time."""
    fs, path = FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        for batch in pq.ParquetFile(f, pre_buffer=False).iter_batches(batch_size=1, columns=list(columns)):
            yield from zip(*(batch.column(c) for c in columns))


def _array(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind) if value.as_buffer() is not None else np.empty(0, kind)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], pa.binary() if isinstance(x, np.ndarray) else pa.float64()) for k, x in columns.items()})


def _pieces(weights: DataFrame, target: str, source: str, parts: int, piece: int) -> Table:
    """Weights by `target`, a row for about `piece` of them or for one target that has more: ids, by their number of weights;
    these numbers; for each weight, by its source: source, weight, and its place among the weights in the order of ids."""

    def one(t: np.ndarray, s: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        ids, first, counts = np.unique(t, return_index=True, return_counts=True)
        by = np.argsort(counts, kind="stable")
        ids, first, counts = ids[by], first[by], counts[by]
        where = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(len(t))
        s, w = s[where], w[where]
        place = np.argsort(s, kind="stable")
        return _batch(ids=ids, counts=counts.astype("<i4"), sources=s[place], places=place.astype("<i4"), weights=w)

    def whole(t: np.ndarray, s: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = 0
        while low < len(t):
            high = len(t) if len(t) - low <= piece else int(np.searchsorted(t, t[low + piece]))
            high = high if high > low else int(np.searchsorted(t, t[low], "right"))
            yield one(t[low:high], s[low:high], w[low:high])
            low = high

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, enough = 0, piece
        for b in batches:
            while b.num_rows:
                part = b.slice(0, enough + 1 - n)
                b, n = b.slice(part.num_rows), n + part.num_rows
                held.append([np.array(part.column(k).to_numpy(), kind) for k, kind in enumerate(("<i4", "<i4", "<f4"))])
                if n > enough:
                    t, s, w = (np.concatenate(x) for x in zip(*held))
                    cut = int(np.searchsorted(t, t[-1]))  # the last target may go on
                    yield from whole(t[:cut], s[:cut], w[:cut])
                    held, n = [[t[cut:].copy(), s[cut:].copy(), w[cut:].copy()]], len(t) - cut
                    enough = max(piece, 2 * n)
        if n:
            yield from whole(*(np.concatenate(x) for x in zip(*held)))

    by = weights.select(target, source, "weight").repartitionByRange(parts, target).sortWithinPartitions(target)
    # Every piece opens all files of the other side's factors, so there are no more of them than parts asked for.
    return _keep(by.mapInArrow(pack, "ids binary, counts binary, sources binary, places binary, weights binary").coalesce(parts), "zstd")


FACTORS = "ids binary, factors binary, gram binary"


def _chunks(ids: np.ndarray, factors: np.ndarray) -> Iterator[pa.RecordBatch]:
    by = np.argsort(ids)
    for k in range(0, len(ids), CHUNK):
        own = factors[by[k : k + CHUNK]].astype("<f4")
        wide = own.astype(np.float64)
        yield _batch(ids=ids[by[k : k + CHUNK]], factors=own, gram=wide.T @ wide)


def _started(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """A random direction for each id, which depends on nothing else."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(2 * rank) + np.arange(2 * rank, dtype=np.uint64)) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    g = np.sqrt(-2 * np.log(u[:, :rank])) * np.cos(2 * np.pi * u[:, rank:])
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def _solved(counts: np.ndarray, x: np.ndarray, w: np.ndarray, gram: np.ndarray, strength: float, ridge: float, most: int = 1 << 16) -> np.ndarray:
    """Factors of targets with `counts` weights w each, rising, that fall on sources' factors x; about `most` weights at once."""
    rank, out, at, done = x.shape[1], np.empty((len(counts), x.shape[1])), 0, 0
    for d, n in zip(*np.unique(counts, return_counts=True)):
        step = max(1, most // int(d))
        for k in range(0, n, step):
            m = min(step, n - k)
            a, b, liked = np.zeros((m, rank, rank)), np.zeros((m, rank, 1)), np.zeros((m, 1, 1))
            for low in range(0, m * d, max(most, m * d) if m > 1 else most):  # one target may have more
                high = m * d if m > 1 else min(d, low + most)
                own = x[at + low : at + high].astype(np.float64).reshape(m, -1, rank)
                weight = w[at + low : at + high].astype(np.float64).reshape(m, -1, 1)
                c, more = strength * np.abs(weight), weight > 0
                a += np.matmul((own * c).transpose(0, 2, 1), own)
                b += np.matmul(own.transpose(0, 2, 1), (1 + c) * more)
                liked += more.sum(axis=1, keepdims=True)
            a += gram + ridge * liked * np.eye(rank)
            out[done : done + m] = np.linalg.solve(a, b)[:, :, 0]
            at, done = at + m * d, done + m
    return out


def _step(spark: SparkSession, pieces: Table, sources: Table, rank: int, strength: float, ridge: float) -> Table:
    """Factors of the pieces' targets from the sources' factors. A task reads the latter a chunk at a time and keeps those
    that its weights fall on, so that no factors pass a shuffle and none are held that it doesn't need."""
    files, others = pieces.files, sources.files

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            for row in _rows(files[k], "ids", "counts", "sources", "places", "weights"):
                ids, counts, wanted, places, w = (_array(v, kind) for v, kind in zip(row, ("<i4", "<i4", "<i4", "<i4", "<f4")))
                x, gram = np.empty(len(w), f"V{4 * rank}"), np.zeros((rank, rank))
                for file in others:
                    for s, own, g in _rows(file, "ids", "factors", "gram"):
                        s, own = _array(s, "<i4"), _array(own, x.dtype)
                        gram += _array(g, "<f8").reshape(rank, rank)
                        a, b = np.searchsorted(wanted, s[0]), np.searchsorted(wanted, s[-1], "right")
                        if a < b:
                            x[places[a:b]] = own[np.searchsorted(s, wanted[a:b])]
                yield from _chunks(ids, _solved(counts, x.view("<f4").reshape(-1, rank), w, gram, strength, ridge))

    return _keep(spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(solve, FACTORS), "none")


@dataclass
class Model:
    """Factors in the shared folder: ids by chunks, with the sum of the products of their factors."""

    spark: SparkSession
    rank: int
    users: Table
    items: Table

    def _factors(self, table: Table) -> DataFrame:
        rank = self.rank

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, own in zip(b.column(0), b.column(1)):
                    yield pa.RecordBatch.from_arrays([pa.array(_array(ids, "<i4")), pa.FixedSizeListArray.from_arrays(pa.array(_array(own, "<f4")), rank).cast(pa.list_(pa.float32()))], ["id", "features"])

        return self.spark.read.schema(FACTORS).parquet(table.path).select("ids", "factors").mapInArrow(rows, "id int, features array<float>")

    @property
    def userFactors(self) -> DataFrame:  # noqa: N802, the names of Spark's own model
        return self._factors(self.users)

    @property
    def itemFactors(self) -> DataFrame:  # noqa: N802
        return self._factors(self.items)


def fit(weights: DataFrame, rank: int = 16, rounds: int = 8, strength: float = 10.0, blocks: int | None = None, piece: int = PIECE) -> Model:
    """Factors of customers and products; ids must be integers. Weights that fall on a customer or a product meet in one
    piece, and there are as many pieces as weights need, so that a task's memory doesn't grow with their number. Ridges grow
    with the number of weights above 0, as in Spark's own factorization; starting points depend on ids only. The weights are
    read several times."""
    spark, ridge, seed = weights.sparkSession, 0.05, 7
    parts = blocks or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), -(-weights.count() // piece))
    # Half as much again, as ranges are drawn by a sample.
    users, items = _pieces(weights, "org_id", "product_id", parts, piece * 3 // 2), _pieces(weights, "product_id", "org_id", parts, piece * 3 // 2)
    files = users.files

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            for (ids,) in _rows(files[k], "ids"):
                own = _array(ids, "<i4")
                yield from _chunks(own, _started(own, rank, seed))

    of_users, of_items = _keep(spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(start, FACTORS), "none"), None
    for _ in range(rounds):
        before = of_users, of_items
        of_items = _step(spark, items, of_users, rank, strength, ridge)
        of_users = _step(spark, users, of_items, rank, strength, ridge)
        for table in before:
            if table:
                _drop(spark, table)
    for table in (users, items):
        _drop(spark, table)
    return Model(spark, rank, of_users, of_items)


def _by_length(model: Model, block: int) -> Table:
    """ids, factors, longest: rows of up to `block` products by falling length of their factors, and the greatest length."""
    rank = model.rank

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, own in zip(b.column(0), b.column(1)):
                n, data = len(ids.as_buffer()) // 4, own.as_buffer()
                length = np.linalg.norm(_array(own, "<f4").reshape(-1, rank).astype(np.float64), axis=1)
                offsets = np.arange(0, 4 * rank * n + 1, 4 * rank, dtype="<i4")
                yield pa.RecordBatch.from_arrays([pa.array(_array(ids, "<i4")), pa.array(length), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), data])], ["id", "length", "own"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - n)
                b, n = b.slice(part.num_rows), n + part.num_rows
                held.append(part)
                if n == block:
                    yield row(held)
                    held, n = [], 0
        if held:
            yield row(held)

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column(0).to_numpy() for b in held]).astype("<i4")
        own = np.frombuffer(b"".join(v for b in held for v in b.column(2).to_pylist()), "<f4")
        return _batch(ids=ids, factors=own, longest=float(held[0].column(1)[0].as_py()))

    spark = model.spark
    each = spark.read.schema(FACTORS).parquet(model.items.path).select("ids", "factors").mapInArrow(rows, "id int, length double, own binary")
    parts = max(1, min(spark.sparkContext.defaultParallelism, len(model.items.files)), len(model.items.files) // 4)
    dealt = each.repartitionByRange(parts, F.col("length").desc(), F.col("id")).sortWithinPartitions(F.col("length").desc(), F.col("id"))
    return _keep(dealt.mapInArrow(pack, "ids binary, factors binary, longest double"), "none")


def recommended(model: Model, weights: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """org_id, rank, product_id, score, bought: the k products of the highest score for every customer, ties to smaller ids;
    those already bought are told, not left out.

    Every chunk of customers meets blocks of products, in one task and by falling length of their factors, so that after the
    first ones few scores pass a customer's k-th best so far. A customer whose k-th best a block's longest factors can't
    reach is done, as a score is at most the product of both lengths; where all of a chunk are, the rest isn't read.
    """
    spark, rank = model.spark, model.rank
    users, items = model.users.files, _by_length(model, block).files

    def meet(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, product = np.full((len(u), k), -np.inf, np.float32), np.full((len(u), k), -1, np.int32)
        long = np.linalg.norm(u.astype(np.float64), axis=1)
        for at, p, longest in ((_array(i, "<i4"), _array(f, "<f4").reshape(-1, rank), x.as_py()) for file in items for i, f, x in _rows(file, "ids", "factors", "longest")):
            live = np.flatnonzero(long * longest * (1 + 1e-5) + 1e-30 >= score[:, -1])
            if not len(live):
                break
            for low in range(0, len(live), 512):
                rows = live[low : low + 512]
                s = u[rows] @ p.T
                bound = score[rows, -1]
                if np.isneginf(bound).any() and s.shape[1] > k:
                    # The first block: k scores are at least this, and ties with it are kept.
                    width = s.shape[1] // (8 * k)
                    tops = s[:, : width * 8 * k].reshape(len(s), 8 * k, width).max(axis=2) if width > 1 else s
                    bound = np.maximum(bound, np.partition(tops, -k, axis=1)[:, -k])
                some = np.flatnonzero(s.max(axis=1) >= bound)
                if not len(some):
                    continue
                rows, s, bound = rows[some], s[some], bound[some]
                r, c = np.divmod(np.flatnonzero(s >= bound[:, None]), s.shape[1])
                hit = np.unique(r)
                rr = np.concatenate([r, np.repeat(hit, k)])
                ss = np.concatenate([s[r, c], score[rows[hit]].ravel()])
                pp = np.concatenate([at[c], product[rows[hit]].ravel()])
                order = np.lexsort((pp, -ss, rr))
                rr, ss, pp = rr[order], ss[order], pp[order]
                place = np.arange(len(rr)) - np.searchsorted(rr, rr)
                keep = place < k
                score[rows[rr[keep]], place[keep]] = ss[keep]
                product[rows[rr[keep]], place[keep]] = pp[keep]
        return score, product

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for b in batches for n in b.column(0).to_pylist()):
            for ids, own in _rows(users[n], "ids", "factors"):
                score, product = meet(_array(own, "<f4").reshape(-1, rank))
                found = ~np.isneginf(score).ravel()
                org, place = np.repeat(_array(ids, "<i4"), k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(score))
                yield pa.RecordBatch.from_pydict({"org_id": org[found], "rank": place[found], "product_id": product.ravel()[found], "score": score.ravel()[found]})

    found = spark.range(0, len(users), 1, max(1, len(users))).mapInArrow(best, "org_id int, rank int, product_id int, score float")
    known = weights.select("org_id", "product_id", F.lit(True).alias("bought"))
    return found.join(known, ["org_id", "product_id"], "left").select("org_id", "rank", "product_id", "score", F.coalesce("bought", F.lit(False)).alias("bought"))
