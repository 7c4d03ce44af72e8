"""Best-fit packing of tokenised documents by a grouping genetic algorithm with islands.

Pieces are dealt by hash into shards of about `shard_items` pieces, so that a shard fits one task at any corpus
size. Each shard is evolved on several islands (one Spark group each). Between the epochs the islands' best
packings migrate: they are shuffled to the next island of the ring as small rows. The best packing of a shard is
then joined back to its pieces. Its loosely filled sequences are opened again: the pieces of all shards' loose
sequences are dealt anew and evolved there, until that needs no fewer sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizer

#: Token that ends each document.
END = 0
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32.

    A document's ids are its token ids and then id 0, so a null or empty text is one piece of length 1. Documents
    of more than `capacity` ids are cut so that all pieces but the first have `capacity` ids; the first has the
    rest. Rows that repeat give pieces each; a null doc_id stays null; further columns are left out.
    """
    path = path or tokenizer.default_path()
    whole = docs.sparkSession.sparkContext.broadcast(tokenizer.whole_tokens(path))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, numbers, starts, lengths, sums = [], [], [], [], []
        for k, ids in enumerate(tokenizer.load(path, whole.value).ids_all(batch.column(1).to_pylist())):
            raw = ids.tobytes() + END.to_bytes(4, "little")
            n, low = len(ids) + 1, 0
            high = n % capacity or capacity
            i = 0
            while low < n:
                at.append(k)
                numbers.append(i)
                starts.append(low)
                lengths.append(high - low)
                sums.append(zlib.crc32(raw[4 * low : 4 * high]))
                i, low, high = i + 1, high, high + capacity
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
        return pa.RecordBatch.from_arrays(columns, PIECE)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_slices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """bins: item numbers of each sequence. free: what each has left."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins = bins
        self.free = [capacity - sum(sizes[i] for i in b) for b in bins]

    def score(self, capacity: int) -> tuple[int, float]:
        """Fewer sequences first, then sequences filled unevenly: full ones beside loose ones are easier to improve."""
        return len(self.bins), -sum((1 - f / capacity) ** 2 for f in self.free)


def best_fit(items: list[int], bins: list[list[int]], sizes: list[int], capacity: int) -> Packing:
    """Puts items, in the order given, each into the fullest sequence of `bins` that has room, or a new one."""
    bins = list(bins)
    own = len(bins)
    room = sorted((left, k) for k, b in enumerate(bins) if (left := capacity - sum([sizes[i] for i in b])))
    changed: set[int] = set()
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            k, left = len(bins), capacity
            bins.append([])
        else:
            left, k = room.pop(at)
        if k < own and k not in changed:
            changed.add(k)
            bins[k] = list(bins[k])
        bins[k].append(i)
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return Packing(bins, sizes, capacity)


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Some well-filled sequences of b go whole into a; a's sequences that share a document with them go, and so do the
    loosest and a few others; the documents left over are best-fitted, longest first but for some noise."""
    order = np.argsort(b.free, kind="stable")
    filled = order[: max(1, int(np.searchsorted(np.array(b.free)[order], capacity // 100, "right")))]
    taken = [b.bins[k] for k in rng.choice(filled, min(len(filled), int(rng.integers(1, 9))), replace=False)]
    there = {i for bin_ in taken for i in bin_}
    opened = {int(k) for k in np.argsort(a.free)[-int(rng.integers(1, 5)) :]} | set(rng.integers(0, len(a.bins), int(rng.integers(0, 7))).tolist())
    kept, displaced = [], []
    for k, bin_ in enumerate(a.bins):
        if k not in opened and there.isdisjoint(bin_):
            kept.append(bin_)
        else:
            displaced += [i for i in bin_ if i not in there]
    noise = rng.random(len(displaced)) * (0.0 if rng.random() < 0.5 else 0.5)
    displaced = [displaced[k] for k in np.argsort([-sizes[i] * (1 - x) for i, x in zip(displaced, noise.tolist())], kind="stable")]
    return best_fit(displaced, kept + taken, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, population: int, generations: int, elites: list[list[list[int]]] = ()) -> Packing:
    """A steady-state grouping genetic algorithm, from best-fit packings of nearly descending orders and the elites given.

    The aim is fewer sequences, then unevenly filled ones, so that what is loose comes together and can be packed
    again elsewhere. It ends after the generations, or from the tenth on when the lower bound is met and all sequences
    but one are well filled.
    """
    rng, n = np.random.default_rng(seed), np.array(sizes)
    least = -(-int(n.sum()) // capacity)
    people = [Packing(e, sizes, capacity) for e in elites]
    for k in range(population - len(people)):
        order = np.argsort(-n * (1 + (0.1 * k) * rng.random(len(n))), kind="stable").tolist()
        people.append(best_fit(order, [], sizes, capacity))
    people = sorted(((p.score(capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for born in range(population, population + generations):
        best = people[0][2]
        if born >= population + 10 and len(best.bins) == least and sum(f > capacity // 100 for f in best.free) < 2:
            break
        i, j = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        child = crossover(people[min(i, j)][2], people[max(i, j)][2], sizes, capacity, rng)
        score = child.score(capacity)
        if score < people[-1][0] and all(score != s for s, _, _ in people):
            people[-1] = (score, born, child)
            people.sort(key=lambda x: x[:2])
    return people[0][2]


def encode(p: Packing, n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, bin_ in enumerate(p.bins):
        out[bin_] = k
    return out.tobytes()


def decode(raw: bytes) -> list[list[int]]:
    where = np.frombuffer(raw, "<i4")
    bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for i, k in enumerate(where.tolist()):
        bins[k].append(i)
    return bins


def _evolved(part: DataFrame, shards: int, turn: int, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """part (PIECE, _copy) dealt to shards and packed: with shard, bin, offset and free (what its sequence has left)."""
    part = part.withColumn("shard", F.pmod(F.xxhash64(*PIECE, "_copy", F.lit(turn)), F.lit(shards)))

    def lengths(pdf: pd.DataFrame) -> list[int]:
        return np.sort(pdf["length"].to_numpy()).tolist()

    def row(key: tuple, best: Packing, n: int) -> pd.DataFrame:
        count, fill = best.score(capacity)
        there = (int(key[1]) + 1) % islands
        return pd.DataFrame({"shard": [key[0]], "island": [there], "score": [float(count) + fill / (count + 1)], "elite": [encode(best, n)]})

    def start(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = lengths(pdf)
        return row(key, evolve(sizes, capacity, int(key[0]) * islands + int(key[1]), population, generations), len(sizes))

    def again(epoch: int):
        def run(key, pdf: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
            sizes = lengths(pdf)
            seed = (epoch << 40) + int(key[0]) * islands + int(key[1])
            return row(key, evolve(sizes, capacity, seed, population, generations, [decode(e) for e in elites["elite"]]), len(sizes))

        return run

    order = ["length", "doc_id", "piece", "ids_crc32", "start", "_copy"]

    def place(key, pdf: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        pdf["bin"] = np.frombuffer(best["elite"].iloc[0], "<i4")
        by = pdf.groupby("bin")["length"]
        pdf["offset"] = by.cumsum() - pdf["length"]
        pdf["free"] = capacity - by.transform("sum")
        return pdf[[*PIECE, "_copy", "shard", "bin", "offset", "free"]]

    held = part.select("shard", "length", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"))
    kind = "shard long, island int, score double, elite binary"
    elites = held.groupBy("shard", "island").applyInPandas(start, kind)
    for epoch in range(1, epochs):
        elites = held.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island")).applyInPandas(again(epoch), kind)
    best = elites.groupBy("shard").agg(F.min(F.struct("score", "island", "elite")).alias("b")).select("shard", "b.elite")
    id_kind = part.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, piece int, start long, length long, ids_crc32 long, _copy long, shard long, bin int, offset long, free long"
    return common.materialize(part.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, schema))


def pack_pieces(pieces: DataFrame, capacity: int = 2048, shard_items: int = 2000, islands: int = 2, epochs: int = 3, population: int = 6, generations: int = 60, loose: float = 0.005) -> DataFrame:
    """pieces with sequence_id and offset; length must be 1 to capacity.

    Pieces of full length are sequences of their own. Others are packed within their shard, and sequences with more
    than the share `loose` left are opened and packed again in the company of other shards' ones, as often as that needs
    fewer sequences than were opened. Rows that repeat are numbered, so that they spread over shards, and packed each. An
    empty table gives an empty result. The result is the same for the same rows in any order.
    """
    pieces = common.materialize(pieces.select(*PIECE))
    short = pieces.filter(F.col("length") < capacity)
    part = common.spread_copies(short.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("_n")), "_n", "_copy")
    out = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    left, opened, turn = short.count(), None, 0
    placed = part
    is_loose = F.col("free") > int(loose * capacity)
    while left:
        done = _evolved(part, -(-left // shard_items), turn, capacity, islands, epochs, population, generations)
        # A sequence's first piece stands for it.
        first = F.col("offset") == 0
        bins, open_bins, left = done.agg(F.count_if(first), F.count_if(first & is_loose), F.count_if(is_loose)).first()
        if opened is not None and bins >= opened:
            break
        number = F.lit(-1) - F.lit(turn << 56) - F.shiftleft("shard", 24) - F.col("bin")
        done = done.withColumn("sequence_id", number)
        out = out.unionByName(done.filter(~is_loose).select(*PIECE, "sequence_id", "offset"))
        placed = done.filter(is_loose)
        part, opened, turn = placed.select(*PIECE, "_copy"), open_bins, turn + 1
    return out.unionByName(placed.select(*PIECE, "sequence_id", "offset")) if opened else out


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, **options) -> DataFrame:
    """tokenised_pieces, then pack_pieces."""
    return pack_pieces(tokenised_pieces(docs, path, capacity), capacity, **options)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places (see tokenised_pieces and pack_pieces): a null or empty text is one
    piece of length 1, and rows that repeat are packed each."""
    return pack(common.read(spark, sf_dir, "documents"))
