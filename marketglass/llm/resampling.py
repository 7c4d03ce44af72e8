"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Features of a text are its runs of one and two words, hashed to buckets by crc32. A first pass counts each bucket in
the documents and in the target texts. The second pass inverts the documents: a block of documents gives each of
its buckets one row of (document, count) postings, and these are shuffled by bucket together with the counts of both
corpora. Where a bucket arrives, its counts come first, so its gain is computed there and its postings follow as
contributions, summed in the task and then by document.

Bounds: a block has at most BLOCK_BYTES bytes (or one text) and BLOCK_ROWS rows, so a bucket that every document holds
has one row a block. Cells of GROUPS groups of buckets are further split by block, so that no bucket meets
in one task on large inputs; the counts, one row a bucket, are sent to each of these.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 14
#: Groups of buckets that are summed apart; a document gives at most so many contributions.
GROUPS = 32
#: Sums that a task holds before it gives them on.
HELD = 1 << 21
#: Words longer than this are hashed by the library, one by one.
LONG = 48

_byte = np.arange(256)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 0x20, _byte).astype(np.uint8)
#: Bytes of words once lower-cased: digits, a to z, and all of characters beyond ASCII.
INSIDE = (_byte >= 0x30) & (_byte <= 0x39) | (_byte >= 0x61) & (_byte <= 0x7A) | (_byte >= 0x80)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, and start, end and text number of each word. No word crosses two texts."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edges = np.flatnonzero(np.diff(INSIDE[data], prepend=False))
    starts, ends = edges[::2], edges[1::2]
    ahead = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(ahead, starts, "right") - 1


def crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 registers after the bytes of each run, all runs at once, byte by byte."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, LONG + 1).astype(np.int16), kind="stable")
    at, left, held = starts[order], lengths[order], state[order]
    longer = len(left) - np.cumsum(np.bincount(np.minimum(left, LONG + 1), minlength=LONG + 2))
    for k in range(LONG):
        m = longer[k]
        if not m:
            break
        held[:m] = CRC[(held[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (held[:m] >> np.uint32(8))
    for i in range(longer[LONG]):
        rest = data[at[i] + LONG : at[i] + left[i]].tobytes()
        held[i] = zlib.crc32(rest, int(held[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = held
    return out


def features_of(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each feature, repeats included."""
    data, starts, ends, owner = words_of(texts)
    one = crc_on(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    spaced = CRC[(one[pair] ^ np.uint32(0x20)) & np.uint32(255)] ^ (one[pair] >> np.uint32(8))
    two = crc_on(spaced, data, starts[pair + 1], ends[pair + 1])
    crc = ~np.concatenate([one, two])
    return np.concatenate([owner, owner[pair]]), (crc % np.uint32(buckets)).astype(np.int64)


def blocks_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive texts that make a block: first and behind the last."""
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and (size + len(t) > BLOCK_BYTES or k - low == BLOCK_ROWS):
            yield low, k
            low, size = k, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def bucket_counts(texts: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket and the number of its features in all texts, in column n; each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = _bytes(batch.column(0))
            for a, b in blocks_of(found):
                total += np.bincount(features_of(found[a:b], buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(common.quoted(column)).alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


_POSTED = "cell int, bucket int, kind int, n long, block long, docs binary, counts binary, doc_id {}, size long"


def postings(docs: DataFrame, buckets: int, salts: int) -> DataFrame:
    """The documents inverted block by block (kind 1: n is the block's number of rows), and a row of each (kind 2)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _POSTED.format(kind)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _bytes(batch.column(2))
            numbers = batch.column(0).to_numpy()
            for a, b in blocks_of(found):
                n, block = b - a, int(numbers[a])
                owner, bucket = features_of(found[a:b], buckets)
                keys, counts = np.unique(bucket * n + owner, return_counts=True)
                of, who = np.divmod(keys, n)
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                ends = np.append(cuts[1:], len(of))
                held = of[cuts]
                salt = zlib.crc32(str(block).encode()) % salts
                m = len(cuts)
                d, c = who.astype("<u2").tobytes(), counts.astype("<u4").tobytes()
                spread = (numbers[a:b] % (salts * GROUPS)).astype(np.int32)
                columns = [
                    pa.array(np.concatenate([(salt * GROUPS + held % GROUPS).astype(np.int32), spread])),
                    pa.array(np.concatenate([held, np.full(n, -1)]).astype(np.int32)),
                    pa.array(np.repeat(np.array([1, 2], np.int32), [m, n])),
                    pa.array(np.full(m + n, n, np.int64)),
                    pa.array(np.concatenate([np.full(m, block, np.int64), numbers[a:b]])),
                    pa.array([*(d[2 * x : 2 * y] for x, y in zip(cuts, ends)), *[None] * n], pa.binary()),
                    pa.array([*(c[4 * x : 4 * y] for x, y in zip(cuts, ends)), *[None] * n], pa.binary()),
                    pa.concat_arrays([pa.nulls(m, batch.column(1).type), batch.column(1).slice(a, n)]),
                    pa.array(np.concatenate([np.zeros(m, np.int64), np.bincount(owner, minlength=n)])),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in _POSTED.split(", ")])

    return rows.mapInArrow(run, schema)


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """Thousandfold logarithm of the smoothed ratio of the bucket's share in the target to that in the documents."""
    return math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, target_text: str = "text") -> DataFrame:
    """row (a number of the row), doc_id, n_features and weight, the floored mean gain of a row's features (none: 0).

    Null texts have no features; rows that repeat are weighed each; an empty target weighs all by the smoothing alone.
    Further columns are left out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = -(-parts // GROUPS)
    zero = F.lit(0).cast("long")
    both = bucket_counts(docs, "text", buckets).select("bucket", F.col("n").alias("s"), zero.alias("t"))
    both = both.union(bucket_counts(target, target_text, buckets).select("bucket", zero, "n"))
    counts = common.materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    all_s, all_t = (x or 0 for x in counts.agg(F.sum("s"), F.sum("t")).first())

    posted = postings(docs, buckets, salts)
    none = F.lit(None)
    heads = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        (F.col("salt") * GROUPS + F.col("bucket") % GROUPS).cast("int").alias("cell"), "bucket", F.lit(0).alias("kind"), F.col("s").alias("n"), F.col("t").alias("block"),
        none.cast("binary").alias("docs"), none.cast("binary").alias("counts"), none.cast(docs.schema["doc_id"].dataType).alias("doc_id"), zero.alias("size"),
    )
    met = posted.union(heads).repartitionById(salts * GROUPS, F.col("cell")).sortWithinPartitions("bucket", "kind")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "part", "doc_id", "n_features"]
        sums: dict[int, np.ndarray] = {}
        size, worth = 0, 0

        def given(like: pa.DataType) -> Iterator[pa.RecordBatch]:
            for block, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(block + at), pa.array(x[at]), pa.nulls(len(at), like), pa.nulls(len(at), pa.int64())], names)

        like = None
        for batch in batches:
            like = batch.column(7).type
            own = np.flatnonzero(batch.column(2).to_numpy() == 2)
            if len(own):
                mine = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([mine.column(4), pa.array(np.zeros(len(own), np.int64)), mine.column(7), mine.column(8)], names)
            for what, n, block, d, c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5, 6))):
                if what == 0:
                    worth = gain(n, block, all_s, all_t, buckets)
                elif what == 1:
                    x = sums.get(block)
                    if x is None:
                        if size + n > HELD and sums:
                            yield from given(like)
                            sums.clear()
                            size = 0
                        x = sums[block] = np.zeros(n, np.int64)
                        size += n
                    x[np.frombuffer(d, "<u2")] += worth * np.frombuffer(c, "<u4").astype(np.int64)
        if sums:
            yield from given(like)

    parted = met.mapInArrow(contribute, f"row long, part long, doc_id {kind}, n_features long")
    total, n = F.col("total"), F.col("n_features")
    mean = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(zero)
    return parted.groupBy("row").agg(F.sum("part").alias("total"), F.max("doc_id").alias("doc_id"), F.max("n_features").alias("n_features")).select("row", "doc_id", n, mean.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the drawn ones have a rank.

    Of the N rows with at least least_words words, floor(share * N / 100) are drawn: those of the highest score, the weight and
    Gumbel noise from a hash of seed and doc_id. Ties go to the smaller doc_id, a null one (whose hash is that of an empty
    one) last; rows equal in both are drawn in the order read. Null and empty texts have no words and aren't drawn; an
    empty table gives no rows. Ranks come from rows written once in ranges of the order, so no task sorts all.
    """
    spark = docs.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    may = F.col("n_features") >= 2 * least_words - 1
    scored = common.materialize(weights(docs, target, buckets).withColumn("score", F.col("weight") + noise))
    draw = scored.filter(may).count() * share // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.materialize(scored.filter(may).repartitionByRange(parts, *order).withColumn("at", F.spark_partition_id()))
    ahead = ranged.groupBy("at").count().select("at", (F.sum("count").over(Window.orderBy("at")) - F.col("count")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("at").orderBy(*order)) + F.col("ahead")
    ranked = ranged.join(F.broadcast(ahead), "at").withColumn("place", place.cast("long"))
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*out, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return drawn.union(scored.filter(~may).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards `benchmark` (see resample): null and empty texts aren't drawn, repeated rows each count."""
    return resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
