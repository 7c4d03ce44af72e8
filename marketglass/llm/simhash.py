"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits meet if both emit every variant within half the radius. Emitting all 2,081
variants of 64 bits for a radius of 4 would multiply the data by 33 kB a document, so the radius is first divided:
the bits are cut into three blocks, and of two fingerprints that differ in at most 4 bits, some two blocks
together differ in at most 2 (the block left out has the most differences, at least a third of them). For each
choice of two blocks a fingerprint emits all variants of those 42 or 43 bits within half of that radius, 1:
131 variants in all. No pair within the radius is lost. Variants are shuffled, each meeting is verified on all 64
bits, and what a task already knows to be linked isn't emitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Bits of the three blocks.
BLOCKS = (tuple(range(0, 22)), tuple(range(22, 43)), tuple(range(43, 64)))
SHINGLE = 4
SEED = 42


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's word shingles as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        low = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
        high = (ends[SHINGLE - 1 :] - 1).tolist()
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(low, high)), np.uint64, len(low))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the numbers."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns `keep` and fp (the fingerprint as a signed long) of every row; a null text counts as empty."""
    names = ["doc_id", *keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*names, "fp"])

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return common.map_slices(docs.select(F.coalesce("text", F.lit("")).alias("_text"), *names), run, f"{kinds}, fp long")


def masks() -> list[tuple[int, list[int]]]:
    """For each choice of two blocks: the mask of their bits, and single bits of it."""
    out = []
    for left_out in range(3):
        bits = [b for k in range(3) if k != left_out for b in BLOCKS[k]]
        out.append((sum(1 << b for b in bits), bits))
    return out


def variants(fps: DataFrame) -> DataFrame:
    """fp, kind, v: all 131 variants. kind is the choice of blocks."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def ball(kind: int, mask: int, bits: list[int]) -> Column:
        flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)).cast("long") for b in bits))
        return F.transform(flips, lambda flip: F.struct(F.lit(kind).cast("byte").alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(mask))).bitwiseXOR(flip).alias("v")))

    every = F.concat(*(ball(kind, mask, bits) for kind, (mask, bits) in enumerate(masks())))
    return fps.select("fp", F.explode(every).alias("x")).select("fp", "x.kind", "x.v")


class Joined:
    """Which fingerprints this task has linked already. Starts anew at `limit` names, so memory is bounded."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.up = limit, {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> bool:
        if len(self.up) > self.limit:
            self.up = {}
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(fp: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span every group within fp (uint64) of which each is within radius of another; never all pairs."""
    left = np.arange(len(fp))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
            for j in left[near].tolist():
                frontier.append(j)
                yield int(fp[i]), int(fp[j])
            left = left[~near]


#: Fingerprints of one variant that a task compares at once; larger groups are divided again.
HOT = 4096


def _meet(met: DataFrame, radius: int, hot: int | None) -> DataFrame:
    """a, b: links that span the groups of equal kind and v (columns kind, v, fp; sorted), and kind, v, fp of the rows of
    groups with more than `hot` members instead of links (None: there is no such bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Joined()
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        passing: tuple[int, int] | None = None

        def out(a: list[int], b: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
            pair = [np.array(c, np.uint64).view(np.int64) for c in (a, b)]
            n = sum(len(r[0]) for r in rows)
            sent = [np.concatenate([r[i] for r in rows]).astype(np.int64) if rows else np.empty(0, np.int64) for i in range(3)]
            ends = [pa.concat_arrays([pa.array(c), pa.nulls(n, pa.int64())]) for c in pair]
            return pa.RecordBatch.from_arrays(ends + [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(c)]) for c in sent], ["a", "b", "kind", "v", "fp"])

        def meet(kind: np.ndarray, v: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a: list[int] = []
            b: list[int] = []
            rows: list[np.ndarray] = []
            starts = np.concatenate([[0], np.flatnonzero((v[1:] != v[:-1]) | (kind[1:] != kind[:-1])) + 1])
            sizes = np.diff(np.append(starts, len(v)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius] if len(two) else two
            for x, y in zip(fp[two].tolist(), fp[two + 1].tolist()):
                if known.link(x, y):
                    a.append(x)
                    b.append(y)
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if hot is not None and n > hot:
                    rows.append((kind[s : s + n], v[s : s + n], fp[s : s + n].view(np.int64)))
                    continue
                for x, y in spanning(fp[s : s + n], radius):
                    if known.link(x, y):
                        a.append(x)
                        b.append(y)
            return out(a, b, rows)

        for batch in batches:
            part = [batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if passing is not None:
                # More rows of a group that is passed on already.
                same = (part[0] == passing[0]) & (part[1] == passing[1])
                if same.any():
                    yield out([], [], [(part[0][same], part[1][same], part[2][same].view(np.int64))])
                    part = [p[~same] for p in part]
                if len(part[0]):
                    passing = None
            if not len(part[0]):
                continue
            kind, v, fp = (np.concatenate(p) for p in zip(rest, part))
            cut = np.flatnonzero((v != v[-1]) | (kind != kind[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            rest = [kind[cut:], v[cut:], fp[cut:]]
            if hot is not None and len(rest[0]) > hot:
                passing = int(rest[0][0]), int(rest[1][0])
                yield out([], [], [(rest[0], rest[1], rest[2].view(np.int64))])
                rest = [r[:0] for r in rest]
            if cut:
                yield meet(kind[:cut], v[:cut], fp[:cut])
        if len(rest[0]):
            yield meet(*rest)

    return met.mapInArrow(run, "a long, b long, kind long, v long, fp long")


def _divided(hot: DataFrame) -> DataFrame:
    """kind, v, fp of hot groups, each dealt to five smaller ones: of two members that differ in at most four bits of the
    block that `kind` leaves out, some fifth of that block is equal. v becomes a hash of v and that fifth's place and bits."""
    every = []
    for kind, block in enumerate((BLOCKS[0], BLOCKS[1], BLOCKS[2])):
        fifths = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(block), 5)]
        keys = F.array(*(F.xxhash64("v", F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(fifths)))
        every.append(F.when(F.col("kind") == kind, keys))
    return hot.select("kind", "fp", F.explode(F.coalesce(*every)).alias("v")).select("kind", "v", "fp")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that span all groups linked at `radius` or fewer bits.

    radius: at most 4. Null fingerprints take no part. A variant that more than HOT fingerprints share is divided by
    the bits that it leaves open, so no link is lost and no task compares all of its fingerprints.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of partitions: a small table of fingerprints would be merged to few tasks, but each makes 131 rows of
    # one. By a hash, as a partitioning by fp itself is there already and would be taken instead.
    single = fps.select("fp").filter("fp is not null").distinct().repartition(parts, F.xxhash64("fp"))
    met = variants(single).select("kind", "v", "fp").repartition(parts, "kind", "v").sortWithinPartitions("kind", "v", "fp")
    found = common.materialize(_meet(met, radius, HOT))
    again = _divided(found.filter("a is null").select("kind", "v", "fp")).repartition(parts, "kind", "v").sortWithinPartitions("kind", "v", "fp")
    return found.filter("a is not null").select("a", "b").unionByName(_meet(again, radius, None).select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), fp, component_id of every row.

    Rows are linked if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that
    can be reached over links, the row's own included. Null and empty texts, and texts of white space, have
    fingerprint zero and are linked like others. Rows that repeat share a component. A null doc_id is never a
    component_id unless the component has no other. An empty table gives an empty result.
    """
    rows, every = _components(docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")), radius)
    return rows.join(every, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _components(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and fp of every row; root (a fingerprint that names the component) and component_id of every fp."""
    rows = common.materialize(fingerprints(docs, "text_hash"))
    least = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(least, radius)).withColumnRenamed("node", "fp")
    ids = root.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    wide = root.join(ids, "root").select("fp", "root", "component_id")
    # Written first: adaptive execution can then split the joins with it where very many rows share a fingerprint.
    every = least.join(wide, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return rows, common.materialize(every)


def representatives(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id (then text hash) stays, once.

    The columns are those of docs, whatever their names. Rows without a doc_id stay only if their component has no row
    with one. Null and empty texts are near-duplicates of each other. Of rows equal in doc_id and text one stays. An
    empty table gives an empty result. Whole texts are moved once, by a hash of doc_id and text.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows, every = _components(docs.select(docs["doc_id"], docs["text"], F.xxhash64(text).alias("text_hash")), radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    keep = rows.join(every, "fp").groupBy("root").agg(first.alias("k")).select(F.hash("k.doc_id", "k.text_hash").alias("_a"), F.xxhash64("k.doc_id", "k.text_hash").alias("_b"), F.xxhash64(F.lit(1), "k.doc_id", "k.text_hash").alias("_c"))
    h = F.xxhash64(text)
    row = F.struct(*(docs[common.quoted(n)] for n in docs.columns)).alias("row")
    keyed = docs.select(row, F.hash(docs["doc_id"], h).alias("_a"), F.xxhash64(docs["doc_id"], h).alias("_b"), F.xxhash64(F.lit(1), docs["doc_id"], h).alias("_c"))
    kept = keyed.join(keep, ["_a", "_b", "_c"], "left_semi").dropDuplicates(["_a", "_b", "_c"])
    return kept.select("row.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (see near_duplicates): null and empty texts have fingerprint zero and
    are linked, rows that repeat share a component, a null doc_id names no component that has another."""
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
