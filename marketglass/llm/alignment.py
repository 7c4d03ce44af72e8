"""Alignment of two tokenizers' tokens through a dictionary of groups.

Byte offsets where tokens of both end cut a text into groups: a few ids of A and the ids of B for the same bytes. Groups
repeat in all texts, so each is interned: a block of documents names its distinct groups once and refers to them by
place. Distinct groups are counted over all blocks, and the links between their tokens are expanded once for each
distinct group, not once for each place, and multiplied by its frequency. What a group's links give (their number, how
many are their B id's best, the sum of their counts) is joined back by the group to the blocks that hold it, and there
summed by document.

Words between single spaces or line feeds are aligned once a block, as no token of either crosses these: A's pre-tokens
begin there, and no piece of B has a space behind another character (`Pair` makes sure). All other texts are aligned whole.

Bounds: a block has at most BLOCK_BYTES bytes (or one text) and BLOCK_ROWS rows; so has what meets by block. A group, however
frequent, has one row a block.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizer

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 14

def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(s[3:5], 16)]) if model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]


def letter_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; ids of special strings have none."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in tokenizer.byte_letters().items()}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    named = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special}
    return [named.get(i, b"") for i in range(max(named) + 1)]


class Units:
    """Token ids of consecutive words or texts: flat, and their numbers."""

    def __init__(self, a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray):
        self.a, self.a_n, self.b, self.b_n = a, a_n, b, b_n

    def kept(self, good: np.ndarray) -> Units:
        return self if good.all() else Units(self.a[np.repeat(good, self.a_n)], self.a_n[good], self.b[np.repeat(good, self.b_n)], self.b_n[good])

    def and_then(self, more: Units) -> Units:
        return Units(*(np.concatenate(x) for x in zip((self.a, self.a_n, self.b, self.b_n), (more.a, more.a_n, more.b, more.b_n))))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places starts, starts + 1 and so on, n of each."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Pair:
    """Two tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = tokenizer.ByteBpe(a_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = letter_bytes(a_path), piece_bytes(b_path)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.by_word = not any(b" " in p.lstrip(b" ") or b"\n" in p and len(p) > 1 for p in self.b_bytes)

    def cut(self, text: str) -> list[str] | None:
        """Words, each with the line feed before it or without the space before it; None for a text that has other white space."""
        words = text.split()
        feeds = "\n" in text
        if not self.by_word or not words or " ".join(words) != (text.replace("\n", " ") if feeds else text):
            return None
        return text.replace("\n", " \n").split(" ") if feeds else words

    def of_words(self, words: list[str]) -> tuple[Units, np.ndarray]:
        """Ids of words as `cut` gives them, and which of them are sound."""
        ids = self.a.word_ids(words)
        packed = [ids[w] for w in words]
        a, a_n = np.frombuffer(b"".join(packed), "<u4").astype(np.int64), np.array(list(map(len, packed)), np.int64) // 4
        pieces = self.b.encode(words, num_threads=1) if words else []
        # The space that B adds before a line feed isn't there.
        fed = [w[0] == "\n" for w in words]
        ok = np.array([not f or p[0] == self.space for f, p in zip(fed, pieces)], bool)
        units = Units(a, a_n, *_flat([p[1:] if f else p for f, p in zip(fed, pieces)]))
        return units, ok & self.sound([(w if f else f" {w}").encode() for w, f in zip(words, fed)], units)

    def of_texts(self, texts: list[str]) -> tuple[Units, np.ndarray]:
        units = Units(*_flat([self.a._ids(f" {t}") for t in texts]), *_flat([self.b.encode(t, num_threads=1) for t in texts]))
        return units, self.sound([f" {t}".encode() for t in texts], units)

    def sound(self, wanted: list[bytes], units: Units) -> np.ndarray:
        """Whether the tokens of both have the unit's bytes."""
        good = np.ones(len(wanted), bool)
        for ids, n, names in ((units.a, units.a_n, self.a_bytes), (units.b, units.b_n, self.b_bytes)):
            parts = list(map(names.__getitem__, ids.tolist()))
            if b"\0".join(wanted) != b"\0".join(b"".join(parts[e - k : e]) for e, k in zip(np.cumsum(n).tolist(), n.tolist())):
                good &= [w == b"".join(parts[e - k : e]) for w, e, k in zip(wanted, np.cumsum(n).tolist(), n.tolist())]
        return good

    def groups(self, units: Units) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct groups of sound units, the group at each place, and the number of groups of each unit."""
        a_end, b_end = np.cumsum(self.a_size[units.a]), np.cumsum(self.b_size[units.b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        last = a_end[np.cumsum(units.a_n) - 1] if len(units.a_n) else a_end
        per_unit = np.diff(np.searchsorted(cuts, last, "right"), prepend=0)
        sides = []
        h, check = (np.zeros(len(cuts), np.uint64) for _ in range(2))
        for k, (ids, end) in enumerate(((units.a, a_end), (units.b, b_end))):
            behind = np.searchsorted(end, cuts) + 1
            start = np.append(0, behind[:-1])
            sides.append((ids.tolist(), start.tolist(), behind.tolist()))
            if len(cuts):
                place = np.arange(len(ids)) - np.repeat(start, behind - start)
                x = ids.astype(np.uint64) | place.astype(np.uint64) << np.uint64(24) | np.uint64(k + 1) << np.uint64(62)
                h += np.add.reduceat(_mixed(x), start)
                check += np.add.reduceat(_mixed(x ^ np.uint64(0x9E3779B97F4A7C15)), start)
        _, first, at = np.unique(h, return_index=True, return_inverse=True)
        if (check != check[first][at]).any():
            _, first, at = np.unique(np.stack([h, check], 1), axis=0, return_index=True, return_inverse=True)
            at = at.ravel()
        (a, a0, a1), (b, b0, b1) = sides
        names = [f"{','.join(map(str, a[a0[i] : a1[i]]))}|{','.join(map(str, b[b0[i] : b1[i]]))}" for i in first.tolist()]
        return names, at, per_unit


def _pair(a_path: str, b_path: str) -> Pair:
    return common.kept(("pair", a_path, b_path), lambda: Pair(a_path, b_path))


_BLOCK = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ends", "places", "times", "keys", "totals"]


def _block(pair: Pair, number: int, doc_id: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """One row: the block's documents, its distinct groups, and how often each document has each."""
    cut = [pair.cut(t) if t else None for t in texts]
    words = list(set().union(*(w for w in cut if w)))
    units, good = pair.of_words(words)
    index = {w: k for w, k in zip(words, (np.cumsum(good) - 1).tolist())}
    bad = {words[k] for k in np.flatnonzero(~good)}
    units = units.kept(good)
    if bad:
        cut = [None if w and not bad.isdisjoint(w) else w for w in cut]
    whole = [k for k, (t, w) in enumerate(zip(texts, cut)) if t and not w]
    if whole:
        more, good = pair.of_texts([texts[k] for k in whole])
        whole = [k for k, ok in zip(whole, good) if ok]
        first = len(units.a_n)
        units = units.and_then(more.kept(good))
        alone = {k: first + j for j, k in enumerate(whole)}
    else:
        alone = {}
    names, groups, sizes = pair.groups(units)
    begins = np.cumsum(sizes) - sizes
    listed = list(map(names.__getitem__, groups.tolist()))
    shown = [";".join(listed[b : b + n]) for b, n in zip(begins.tolist(), sizes.tolist())]

    rows, sums = [], []
    for k, w in enumerate(cut):
        here = list(map(index.__getitem__, w)) if w else [alone[k]] if k in alone else []
        rows.append(here)
        sums.append(hashlib.sha256(";".join(map(shown.__getitem__, here)).encode()).hexdigest() if here else "")
    row, lengths = _flat(rows)
    owner = np.repeat(np.arange(len(texts)), lengths)
    counts = [np.bincount(owner, x[row], len(texts)).astype(np.int64) for x in (units.a_n, units.b_n, sizes)]
    n = sizes[row]
    wide = max(1, len(names))
    keys, times = np.unique(np.repeat(owner, n) * wide + groups[_within(begins[row], n)], return_counts=True)
    of, place = np.divmod(keys, wide)
    totals = np.zeros(len(names), np.int64)
    np.add.at(totals, place, times)
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in counts]
    packed = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((ends, "<i8"), (place, "<i4"), (times, "<i4"))]
    ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), doc_id)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *lists, pa.array([sums], pa.list_(pa.string())), *packed, pa.array([names], pa.list_(pa.string())), pa.array([totals.tolist()], pa.list_(pa.int64()))], _BLOCK)


def interned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of documents with their dictionaries of groups, a row each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            numbers = batch.column(0).to_pylist()
            low = 0
            while low < len(texts):
                high, size = low + 1, len(texts[low] or "")
                while high < len(texts) and high - low < BLOCK_ROWS and size + len(texts[high] or "") <= BLOCK_BYTES:
                    size += len(texts[high] or "")
                    high += 1
                ids = pa.concat_arrays([batch.column(1).slice(low, high - low)])
                yield _block(pair, numbers[low], ids, texts[low:high])
                low = high

    schema = f"block long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, ends binary, places binary, times binary, keys array<string>, totals array<long>"
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def links_of(group: str, a_size: list[int], b_size: list[int]) -> Counter:
    """Pairs of ids whose bytes overlap, with the number of their places in the group."""
    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
    found: Counter = Counter()
    i = j = 0
    a_end, b_end = a_size[a[0]], b_size[b[0]]
    while True:
        found[a[i], b[j]] += 1
        if a_end == b_end:
            return found
        if a_end < b_end:
            i += 1
            a_end += a_size[a[i]]
        else:
            j += 1
            b_end += b_size[b[j]]


def expanded(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Links of each distinct group: key, times, a, b and n, the number of places of the pair in the group."""
    sizes = groups.sparkSession.sparkContext.broadcast((list(map(len, letter_bytes(a_path))), list(map(len, piece_bytes(b_path)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = sizes.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                out = [links_of(g, a_size, b_size) for g in part.column(0).to_pylist()]
                again = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]))
                pairs = [(a, b, n) for x in out for (a, b), n in x.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(again), part.column(1).take(again), *(pa.array([p[k] for p in pairs], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64())))], ["key", "times", "a", "b", "n"])

    return groups.select("key", "times").mapInArrow(run, "key string, times long, a int, b int, n long")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' figures (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row)
    and the table of linked pairs of ids (a, b, count, best: the highest count of b).

    A is a byte-level vocabulary and gets a space before each text; B is a piece model that adds one itself. Null and
    empty texts, and those whose tokens have other bytes than the text, have no tokens: zeros and an empty groups_sha256. Rows
    that repeat count each; a null doc_id stays null; ids tied for the highest count are all best; further columns are
    left out; an empty table gives no rows.
    """
    a_path, b_path = a_path or tokenizer.default_path(), b_path or piece_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = common.materialize(interned(docs, a_path, b_path))
    held = blocks.select("block", F.posexplode(F.arrays_zip("keys", "totals")).alias("place", "g")).select("block", "place", F.col("g.keys").alias("key"), F.col("g.totals").alias("times"))
    links = common.materialize(expanded(held.groupBy("key").agg(F.sum("times").alias("times")), a_path, b_path))
    counts = common.materialize(links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col("n")).alias("count")))
    pairs = counts.join(counts.groupBy("b").agg(F.max("count").alias("best")), "b").select("a", "b", "count", "best")
    n = F.col("n")
    worth = links.select("key", "a", "b", "n").join(pairs, ["a", "b"]).groupBy("key").agg(
        F.sum(n).alias("links"), F.sum(F.when(F.col("count") == F.col("best"), n).otherwise(0)).alias("bests"), F.sum(n * F.col("count")).alias("counted")
    )
    back = held.select("block", "place", "key").join(worth, "key").select(F.col("block").alias("owner"), "place", "links", "bests", "counted")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def summed(mine: pa.Table, worths: pa.Table) -> pa.Table:
        row = mine.to_batches()[0]
        lists = [row.column(k).flatten() for k in (1, 2, 3, 4, 5)]
        ends, place, times = (np.frombuffer(row.column(k)[0].as_py(), kind).astype(np.int64) for k, kind in ((6, "<i8"), (7, "<i4"), (8, "<i4")))
        begins = np.append(0, ends)[:-1]
        full = np.flatnonzero(ends > begins)
        at = worths.column("place").to_numpy()
        sums = []
        for name in ("links", "bests", "counted"):
            by = np.zeros(len(at), np.int64)
            by[at] = worths.column(name).to_numpy()
            out = np.zeros(len(ends), np.int64)
            if len(full):
                out[full] = np.add.reduceat(by[place] * times, begins[full])
            sums.append(pa.array(out))
        return pa.Table.from_arrays([*lists[:4], *sums, lists[4]], names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    figures = blocks.select(*_BLOCK[:9]).groupBy("block").cogroup(back.groupBy("owner")).applyInArrow(summed, schema)
    return figures, pairs


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned (see align): null and empty texts have zeros, repeated rows count each."""
    return align(common.read(spark, sf_dir, "documents"))[0]
