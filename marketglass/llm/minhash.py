"""MinHash document fingerprints: universal hash permutations over word shingles, in vectorised numpy.

A permutation is x -> a x + b mod 2^32 with odd a, over 32-bit shingle hashes. A fingerprint keeps the low 8 bits of
each minimum (b-bit minwise hashing). Bands of a signature are joined in Spark to find near-duplicates: texts that
share a band are candidates, which are verified by Jaccard similarity, by the fingerprints where these leave no doubt
and by the exact shingle sets where they do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

PERMUTATIONS = 128
SHINGLE = 5
#: Bands of five minima: texts of similarity 0.8 miss all 16 bands with a chance of 0.0017.
BANDS, BAND = 16, 5
#: Fingerprints further from the threshold than this decide alone: four standard deviations of their estimate.
DOUBT = 0.15
#: Texts of a band are numbered in chunks of as many; two chunks are compared at once.
CHUNK = 2048
#: Doubtful partners in a group that a text sends to verification at once.
PARTNERS = 2
#: Texts of groups that are compared again get signatures of as many minima, whose doubt (four standard deviations) is less.
LONG, LONG_DOUBT = 1024, 0.05
_rng = np.random.default_rng(20240229)
A = (_rng.integers(0, 1 << 31, (PERMUTATIONS, 1), np.int64) * 2 + 1).astype(np.uint32)
B = _rng.integers(0, 1 << 32, (PERMUTATIONS, 1), np.int64).astype(np.uint32)
LONG_A = (_rng.integers(0, 1 << 31, (LONG, 1), np.int64) * 2 + 1).astype(np.uint32)
LONG_B = _rng.integers(0, 1 << 32, (LONG, 1), np.int64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Most bits of a sieve (8 MB).
SIEVE = 1 << 26


def shingles(text: str) -> np.ndarray:
    """32-bit hashes of the shingles of SHINGLE lower-case words; fewer words are one shingle, no word none."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint32)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = h * MIX + w[k : k + n]
    h ^= h >> np.uint64(29)
    return (h * MIX >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray = A, b: np.ndarray = B) -> np.ndarray:
    """Minimum of each permutation; all ones for no shingle."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (a * hashes[at : at + 1024] + b).min(axis=1), out=out)
    return out


def digest(sig: np.ndarray) -> bytes:
    return sig.astype(np.uint8).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity estimated from two fingerprints, less what chance gives (1/256 of equal bytes); 1 for two empty texts."""
    same = float((a.astype(np.uint8) == b.astype(np.uint8)).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def band_keys(sig: np.ndarray) -> list[int]:
    """A 64-bit key of each band."""
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(sig[BAND * k : BAND * k + BAND].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many of the first code points of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_hash", "bands"]
SCHEMA = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text_hash long, bands array<long>"
TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]


def compare(text: str, sig: np.ndarray, hash_: int, following: str, next_sig: np.ndarray) -> tuple:
    new = edited(text, following)
    new_sig = signature(shingles(new))
    return len(text), hashlib.sha256(new.encode()).hexdigest(), digest(sig), digest(new_sig), likeness(sig, new_sig), likeness(sig, next_sig), hash_, band_keys(sig)


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS of every row (see with_next)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "text_hash", "packed"])

    # Whole texts pass one exchange, compressed.
    packed = common.map_slices(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")), pack, f"doc_id {kind}, text_hash long, packed binary")
    ranged = packed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    names = ["part", "edge", "doc_id", "text", *COLUMNS]
    types = [pa.int32(), pa.string(), None, pa.string(), *TYPES]
    none = [None] * len(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        part = TaskContext.get().partitionId()
        held, id_type = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(columns, types)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for low in range(0, batch.num_rows, 256):
                rows = []
                piece = batch.slice(low, 256)
                for doc_id, hash_, raw in zip(*(c.to_pylist() for c in piece.columns)):
                    text = unpack(raw).decode()
                    sig = signature(shingles(text))
                    if held is None:
                        rows.append((part, "first", doc_id, text, *none))
                    else:
                        rows.append((part, None, held[0], None, *compare(*held[1:], text, sig)))
                    held = doc_id, text, sig, hash_
                yield batch_of(rows)
        if held is not None:
            yield batch_of([(part, "last", held[0], held[1], *none[:-2], held[3], None)])

    done = common.materialize(ranged.mapInArrow(run, f"part int, edge string, doc_id {kind}, text string, {SCHEMA}"))
    # One small row a partition meets in this window.
    firsts = done.filter("edge = 'first'").select("part", F.col("text").alias("following"))
    order = firsts.select("part").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("then"))
    lasts = done.filter("edge = 'last'").select("part", "doc_id", "text", "text_hash").join(order, "part")
    pairs = lasts.join(firsts.select(F.col("part").alias("then"), "following"), "then").select("doc_id", "text", "following", "text_hash")

    def stitch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [compare(t, signature(shingles(t)), h, f, signature(shingles(f))) for t, f, h in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        columns = list(zip(*rows)) if rows else [()] * len(TYPES)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, TYPES))], ["doc_id", *COLUMNS])

    return done.filter("edge is null").select("doc_id", *COLUMNS).unionByName(common.map_slices(pairs, stitch, f"doc_id {kind}, {SCHEMA}"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row: its
    fingerprint and that of its text edited with the next document's.

    Documents follow each other by ascending doc_id (null first), rows of one id by a hash of the text; after the
    last comes the first. A null text counts as empty. A table of one row is its own next; an empty one gives no
    rows. Rows that repeat are compared each. Further columns are left out.

    The rows are range-partitioned once. The last row of a partition needs the first of the next: those two a
    partition are written with their texts and joined afterwards.
    """
    return _shown(_with_next(docs))


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("doc_id", *COLUMNS[:-2], *more).withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint and bands of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = [signature(shingles(t)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(digest, sigs), pa.binary()), pa.array(map(band_keys, sigs), pa.list_(pa.int64()))], ["doc_id", "text_hash", "fingerprint", "bands"])

    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_slices(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")), run, f"doc_id {kind}, text_hash long, fingerprint binary, bands array<long>")


def _members(banded: DataFrame, chunk: int) -> DataFrame:
    """band, t, chunk of the rows (band, t; distinct) whose band has another text; chunk numbers every `chunk` texts of a
    band. A stream over sorted rows: no band is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, held = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            band, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.arange(len(t))
            new = np.concatenate([[band[0] != last], band[1:] != band[:-1]])
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + seen, at - start)
            second, later = np.flatnonzero(place == 1), np.flatnonzero(place >= 1)
            first = np.where(second > 0, t[second - 1], held)
            columns = [np.concatenate(c) for c in ((band[second], band[later]), (first, t[later]), (np.zeros(len(second), np.int64), place[later] // chunk))]
            last, seen, held = band[-1], place[-1] + 1, t[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "t", "chunk"])

    parts = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return banded.repartition(parts, "band").sortWithinPartitions("band", "t").mapInArrow(run, "band long, t long, chunk long")


def _groups(members: DataFrame) -> DataFrame:
    """key, t: the groups that are compared. A band of one chunk is a group; of more chunks, each two of them are one."""
    many = members.groupBy("band").agg(F.max("chunk").alias("top")).filter("top > 0")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("top")), lambda o: o != F.col("chunk"))
    keys = F.transform(others, lambda o: F.xxhash64("band", F.least("chunk", o), F.greatest("chunk", o)))
    return members.join(many, "band", "left").select(F.explode(F.coalesce(keys, F.array("band"))).alias("key"), "t")


def _alike(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Jaccard similarity of fingerprints (rows) with one, estimated as in likeness."""
    return ((many == one).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def compare_group(fp: np.ndarray, known: np.ndarray, judged: dict[int, list[int]], low: float, high: float, partners: int) -> tuple[list, list, bool]:
    """Sure links, doubtful pairs (i, j) of a group's fingerprints, and whether it has further doubtful pairs.

    Sure links (estimate of at least `high`) span what they join, and are never all pairs. Of what then isn't joined,
    each text names at most `partners` doubtful ones (from `low` on), most alike first. known: names of what is joined
    already; judged: pairs that have been verified.
    """
    name = known.copy()
    sure, doubtful, more = [], [], False
    left = np.arange(len(fp))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            near = _alike(fp[left], fp[i]) >= high
            for j in left[near].tolist():
                frontier.append(j)
                if name[i] != name[j]:
                    sure.append((i, j))
                    name[name == name[j]] = name[i]
            left = left[~near]
    if (name == name[0]).all():
        return sure, doubtful, more
    for i in range(len(fp) - 1):
        s = _alike(fp[i + 1 :], fp[i])
        open_ = (s >= low) & (s < high) & (name[i + 1 :] != name[i])
        if i in judged:
            open_[np.array(judged[i]) - i - 1] = False
        j = np.flatnonzero(open_)
        if len(j) > partners:
            more = True
            j = j[np.argsort(-s[j], kind="stable")[:partners]]
        doubtful.extend((i, i + 1 + k) for k in j.tolist())
    return sure, doubtful, more


def _compared(rows: DataFrame, threshold: float, partners: int, width: int, doubt: float) -> DataFrame:
    """key, a, b, sure: links and doubtful pairs of the groups (see compare_group), and a row without a and b for each group
    that has further doubtful pairs. rows: key, t, fingerprint (of `width` minima), root of members; key, t, other of pairs verified before."""
    low, high = threshold - doubt, threshold + doubt

    def meet(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(pieces)
        key, t = whole.column("key").to_numpy(), whole.column("t").to_numpy()
        member = whole.column("other").is_null().to_numpy()
        fp = np.zeros((len(t), width), np.uint8)
        fp[member] = np.frombuffer(b"".join(x for x in whole.column("fingerprint").to_pylist() if x is not None), np.uint8).reshape(-1, width)
        root = whole.column("root").fill_null(0).to_numpy()
        other = whole.column("other").fill_null(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(t)))
        two = starts[sizes == 2]
        two = two[root[two] != root[two + 1]] if len(two) else two
        s = _alike(fp[two], fp[two + 1])
        two, s = two[s >= low], s[s >= low]
        out = [list(c) for c in (key[two].tolist(), t[two].tolist(), t[two + 1].tolist(), (s >= high).tolist())]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            # Members come first.
            m = at + int(member[at : at + n].sum())
            judged: dict[int, list[int]] = {}
            if m < at + n:
                place = {x: i for i, x in enumerate(t[at:m].tolist())}
                for x, y in zip(t[m : at + n].tolist(), other[m : at + n].tolist()):
                    i, j = sorted((place[x], place[y]))
                    judged.setdefault(i, []).append(j)
            sure, doubtful, more = compare_group(fp[at:m], root[at:m], judged, low, high, partners)
            for pairs, is_sure in ((sure, True), (doubtful, False)):
                for i, j in pairs:
                    for c, v in zip(out, (key[at], t[at + i], t[at + j], is_sure)):
                        c.append(v)
            if more:
                for c, v in zip(out, (key[at], None, None, None)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield meet(held)
                held = []
            cut = np.flatnonzero(key != key[-1])
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield meet([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield meet(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "other", "t").mapInArrow(run, "key long, a long, b long, sure boolean")


def _sieve(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test whether ids (t, distinct and written) may hold numbers, by two bits a number, which rows pass where they are read.

    It has at least 32 bits an id, so a number outside passes with a chance of 1/256; it stops growing at SIEVE, from where
    on more pass, and still all in ids.
    """
    size = min(SIEVE, max(1 << 10, 1 << (32 * ids.count() - 1).bit_length()))
    places = ids.select(F.explode(F.array(F.col("t").bitwiseAND(size - 1), F.shiftrightunsigned("t", 32).bitwiseAND(size - 1))).alias("p"))
    set_ = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()
    bits = np.zeros(size >> 6, np.int64)
    bits[set_.column("w").to_numpy()] = set_.column("x").to_numpy()
    sieve = ids.sparkSession.sparkContext.broadcast(bits)

    def held(t: np.ndarray) -> np.ndarray:
        found = np.ones(len(t), bool)
        for p in (t & (size - 1), t >> 32 & (size - 1)):
            found &= (sieve.value[p >> 6] >> (p & 63) & 1).astype(bool)
        return found

    return held


def _may_be_in(ids: DataFrame, t: Column) -> Column:
    """Whether ids (t, distinct and written) may hold t (see _sieve). Only t goes to Python."""
    held = _sieve(ids)

    @F.pandas_udf("boolean")
    def test(t: pd.Series) -> pd.Series:
        return pd.Series(held(t.to_numpy()))

    return test(t)


def _of_texts(ids: DataFrame, docs: DataFrame, name: str, make: Callable[[str], bytes]) -> DataFrame:
    """t, name: what make gives for the texts in ids (t, distinct). Whole texts pass no exchange: a sieve leaves those that
    ids may hold where they are read, and what make gives for these meets ids."""
    ids = common.materialize(ids)
    held = _sieve(ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = batch.filter(pa.array(held(batch.column(0).to_numpy())))
        return pa.RecordBatch.from_arrays([kept.column(0), pa.array(map(make, kept.column(1).to_pylist()), pa.binary())], ["t", name])

    text = F.coalesce("text", F.lit(""))
    met = common.map_slices(docs.select(F.xxhash64(text).alias("t"), text.alias("text")), run, f"t long, {name} binary")
    return met.join(ids, "t", "left_semi").dropDuplicates(["t"])


def _long(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """t, fingerprint of LONG minima of the texts in ids (t)."""
    return common.materialize(_of_texts(ids, docs, "fingerprint", lambda text: digest(signature(shingles(text), LONG_A, LONG_B))))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, similarity: the exact Jaccard similarity of the pairs' shingle sets."""

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for g, h in zip(x, y):
            g, h = np.frombuffer(g, np.uint32), np.frombuffer(h, np.uint32)
            both = len(np.intersect1d(g, h, assume_unique=True))
            out.append(both / max(1, len(g) + len(h) - both))
        return pd.Series(out, dtype=float)

    pairs = common.materialize(pairs)
    of = _of_texts(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct(), docs, "x", lambda text: np.unique(shingles(text)).tobytes())
    # The exchange by which copies are dropped serves both joins: a set passes it once, and once more for each pair.
    beside = pairs.join(of.select(F.col("t").alias("b"), F.col("x").alias("y")), "b").join(of.select(F.col("t").alias("a"), "x"), "a")
    return common.materialize(beside.select("a", "b", exact("x", "y").alias("similarity")))


def _links(per: DataFrame, rows: DataFrame, docs: DataFrame, threshold: float, chunk: int, partners: int) -> DataFrame:
    """a, b of links between texts that share a band and are similar: enough of them to join all that such links join.

    per: text_hash, bands of distinct texts; rows: text_hash, fingerprint. Groups are compared by fingerprints, pairs these
    leave in doubt by their shingle sets. A group with more doubtful pairs than its texts may send at once is compared
    again by longer signatures, without what is joined or verified by then, until none is left; each time 16 times as many
    may be sent.
    """
    members = common.materialize(_members(per.select(F.explode("bands").alias("band"), F.col("text_hash").alias("t")), chunk))
    met = common.materialize(members.select("t").distinct())
    prints = rows.select(F.col("text_hash").alias("t"), "fingerprint").filter(_may_be_in(met, F.col("t"))).join(met, "t", "left_semi").groupBy("t").agg(F.first("fingerprint").alias("fingerprint"))
    grouped = _groups(members).join(prints, "t").select("key", "t", "fingerprint", F.col("t").alias("root"), F.lit(None).cast("long").alias("other"))
    found: DataFrame | None = None
    told: DataFrame | None = None
    asked: DataFrame | None = None
    width, doubt = PERMUTATIONS, DOUBT
    while True:
        met = common.materialize(_compared(grouped, threshold, partners, width, doubt))
        links = met.filter("sure").select("a", "b")
        doubtful = met.filter("not sure").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        asked = doubtful if asked is None else asked.unionByName(doubtful)
        pairs = doubtful.select("a", "b").distinct()
        new = _verified(pairs if told is None else pairs.join(told, ["a", "b"], "left_anti"), docs)
        told = new if told is None else told.unionByName(new)
        links = links.unionByName(new.filter(F.col("similarity") >= threshold).select("a", "b"))
        found = links if found is None else found.unionByName(links)
        again = met.filter("a is null").select("key").distinct()
        if again.isEmpty():
            return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = common.materialize(found.distinct())
        root = components(found).withColumnRenamed("node", "t")
        left = common.materialize(_groups(members).join(again, "key", "left_semi"))
        if width != LONG:
            prints, width, doubt = _long(left.select("t").distinct(), docs), LONG, LONG_DOUBT
        open_ = left.join(prints, "t").join(root, "t", "left").select("key", "t", "fingerprint", F.coalesce("root", "t").alias("root"), F.lit(None).cast("long").alias("other"))
        judged = asked.join(again, "key", "left_semi").select("key", F.col("a").alias("t"), F.lit(None).cast("binary").alias("fingerprint"), F.lit(None).cast("long").alias("root"), F.col("b").alias("other"))
        grouped = open_.unionByName(judged)
        partners *= 16


def _classes(rows: DataFrame, docs: DataFrame, threshold: float, chunk: int = CHUNK, partners: int = PARTNERS) -> DataFrame:
    """text_hash, class_id, links of texts that have copies or links; rows: doc_id, text_hash, fingerprint, bands."""
    per = common.materialize(rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")))
    links = common.materialize(_links(per, rows, docs, threshold, chunk, partners))
    root = components(links).withColumnRenamed("node", "text_hash")
    degree = links.select(F.explode(F.array("a", "b")).alias("text_hash")).groupBy("text_hash").agg(F.count(F.lit(1)).alias("links"))
    named = per.select("text_hash", "least", "n").join(root, "text_hash", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "text_hash")).join(degree, "text_hash", "left")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return common.materialize(named.join(least, "root").select("text_hash", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, chunk: int = CHUNK, partners: int = PARTNERS) -> DataFrame:
    """doc_id, class_id, links of every row: rows of equal text (null is empty) are one class, and so are all that links
    join; class_id is the smallest doc_id in it, links the number of other texts that the row's was found to be linked
    with (enough to join the class, not all of them).

    Texts are linked if they share a band of their signatures and their shingles' Jaccard similarity is at least the
    threshold (1 for two texts without words): texts of similarity 0.8 miss all bands with a chance of 0.0017. The
    fingerprints decide alone where their estimate is further than DOUBT from the threshold, which errs with a chance of
    about 0.0001 (LONG_DOUBT in groups compared again); all other links are verified exactly. No task holds more than twice `chunk` texts of a band, and a
    text sends at most `partners` doubtful pairs of a group to verification at once. An empty table gives no rows; a null
    doc_id names a class only if it has no other. Further columns are left out.
    """
    rows = common.materialize(_signed(docs))
    return _in_class(rows, _classes(rows, docs, threshold, chunk, partners)).select("doc_id", "class_id", "links")


def _in_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with class_id and links of classes (written). Only rows of texts that classes may hold pass an exchange."""
    may = _may_be_in(classes.select(F.col("text_hash").alias("t")), F.col("text_hash"))
    none = F.lit(0).cast("long")
    j = rows.filter(may).join(classes.withColumn("known", F.lit(True)), "text_hash", "left").withColumns({"class_id": F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")), "links": F.coalesce("links", none)})
    return j.drop("known").unionByName(rows.filter(~may).withColumns({"class_id": F.col("doc_id"), "links": none}))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts (see with_next), and each document's class of
    near-duplicates (class_id, links: see near_duplicates) by joined bands and verified Jaccard similarity: null texts
    count as empty, equal texts have equal fingerprints, rows that repeat come each."""
    docs = common.read(spark, sf_dir, "documents")
    found = _with_next(docs)
    return _shown(_in_class(found, _classes(found, docs, 0.8)), "class_id", "links")
