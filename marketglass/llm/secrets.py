"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions are compiled to one automaton that reads a text backwards: a subset construction over
the reversed rules, started anew at every byte, then minimised. In each state it tells by a bit a rule whether a match
of that rule starts here, so one pass over the bytes finds the starts of all matches of all rules. Where a match starts,
the rule's own forward automaton gives its longest end, and the search goes on behind it: leftmost, longest,
not overlapping within a kind.

The pass is made in numpy over lanes of one buffer, in lock step. Each lane begins in the initial state; lanes whose
right neighbour ended in another state run again from that one until they meet the states they had, so a match that
crosses lanes is found as well. A zero byte between texts leads back to the initial state, as no rule has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    """A kind of secret: pattern, then at least `least` bytes of the class `tail`, as many as there are.

    A match with fewer is dropped, and the search goes on behind it. `base`: it belongs to the rules that are counted.
    """

    kind: str
    head: str
    tail: str
    least: int
    base: bool = True
    any_case: bool = False


# The rules. The first three are the counted ones; the others are public formats of keys and tokens.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6, any_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 16),
    Rule("hex", r"[0-9a-f]{23}", r"[0-9a-f]", 1),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36, base=False),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 20, base=False),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 20, base=False),
    Rule("pem", r"-----BEGIN\x20(RSA\x20|EC\x20|DSA\x20|OPENSSH\x20|ENCRYPTED\x20)?PRIVATE\x20KEY", r"-", 5, base=False),
)

Node = tuple


def parsed(pattern: str) -> Node:
    """Syntax tree of literals, \\xHH, \\ before marks, classes, groups, |, ?, *, + and {n}: ("set", bytes), ("all", parts), ("any", parts), ("rep", part, least, endless)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        return ord(c)

    def one() -> Node:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            node = either()
            at += 1
            return node
        if pattern[at] == "[":
            at += 1
            members: set[int] = set()
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                members.update(range(low, high + 1))
            at += 1
            return ("set", frozenset(members))
        return ("set", frozenset([char()]))

    def row() -> Node:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            node = one()
            while at < len(pattern) and pattern[at] in "?*+{":
                mark = pattern[at]
                at += 1
                if mark == "{":
                    end = pattern.index("}", at)
                    n = int(pattern[at:end])
                    at = end + 1
                    node = ("all", [node] * n)
                else:
                    node = ("any", [node, ("all", [])]) if mark == "?" else ("rep", node, mark == "+")
            parts.append(node)
        return ("all", parts)

    def either() -> Node:
        nonlocal at
        parts = [row()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(row())
        return parts[0] if len(parts) == 1 else ("any", parts)

    return either()


def any_cased(node: Node) -> Node:
    if node[0] == "set":
        return ("set", frozenset(x for b in node[1] for x in {b, *(ord(f(chr(b))) for f in (str.lower, str.upper) if b < 128)}))
    if node[0] == "rep":
        return ("rep", any_cased(node[1]), node[2])
    return (node[0], [any_cased(n) for n in node[1]])


class Nfa:
    """Thompson's automaton: edges by sets of bytes, and free edges."""

    def __init__(self) -> None:
        self.by: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.by.append([])
        self.free.append([])
        return len(self.by) - 1

    def add(self, node: Node, start: int, backwards: bool) -> int:
        """Puts node behind start; the state where it ends."""
        if node[0] == "set":
            end = self.state()
            self.by[start].append((node[1], end))
            return end
        if node[0] == "all":
            for n in reversed(node[1]) if backwards else node[1]:
                start = self.add(n, start, backwards)
            return start
        end = self.state()
        if node[0] == "any":
            for n in node[1]:
                self.free[self.add(n, self.branch(start), backwards)].append(end)
            return end
        loop = self.branch(start)
        last = self.add(node[1], loop, backwards)
        self.free[last] += [loop, end]
        if not node[2]:
            self.free[loop].append(end)
        return end

    def branch(self, start: int) -> int:
        s = self.state()
        self.free[start].append(s)
        return s

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


class Automaton(NamedTuple):
    """next[state * 256 + byte], already times 256; marks[state]: bits of the rules. States with marks come last; 0 is the initial state."""

    next: np.ndarray
    marks: np.ndarray
    first_marked: int


def determined(nfa: Nfa, start: Iterable[int], ends: dict[int, int], again: bool) -> Automaton:
    """Subset construction and minimisation. ends: bits of the states in which rules end. again: start at every byte."""
    begin = nfa.closed(start)
    index: dict[frozenset[int], int] = {begin: 0}
    table: list[list[int]] = []
    todo = [begin]
    while todo:
        following: list[list[frozenset[int]]] = []
        for current in todo:
            moves: list[set[int]] = [set() for _ in range(256)]
            for s in current:
                for members, t in nfa.by[s]:
                    for b in members:
                        moves[b].add(t)
            seen: dict[frozenset[int], frozenset[int]] = {}
            out = []
            for m in moves:
                key = frozenset(m)
                if key not in seen:
                    seen[key] = nfa.closed(key | begin if again else key)
                out.append(seen[key])
            following.append(out)
        todo = []
        for out in following:
            line = []
            for target in out:
                if target not in index:
                    index[target] = len(index)
                    todo.append(target)
                line.append(index[target])
            table.append(line)
    marks = np.zeros(len(index), np.int64)
    for states, k in index.items():
        for s in states:
            marks[k] |= ends.get(s, 0)
    return minimised(np.array(table), marks)


def minimised(table: np.ndarray, marks: np.ndarray) -> Automaton:
    """Splits the classes of states by where their bytes lead until none is split any more."""
    classes = np.unique(marks, return_inverse=True)[1].ravel()
    while True:
        found = np.unique(np.column_stack([classes, classes[table]]), axis=0, return_inverse=True)[1].ravel()
        if found.max() == classes.max():
            break
        classes = found
    n = classes.max() + 1
    one = np.zeros(n, np.int64)
    one[classes] = np.arange(len(classes))
    of = marks[one]
    order = np.lexsort((np.arange(n), np.arange(n) != classes[0], of != 0)) if not marks[0] else np.arange(n)
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    following = number[classes[table[one[order]]]]
    return Automaton((following * 256).astype(np.int32).ravel(), of[order], int(np.count_nonzero(of == 0)))


class Scanner:
    """The rules compiled: one backward automaton for all, and for each rule one for its head and one for its tail."""

    LANES = 4096

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfa = Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        self.heads: list[tuple[list[int], list[bool]]] = []
        self.tails: list[np.ndarray] = []
        for k, rule in enumerate(rules):
            head, tail = parsed(rule.head), parsed(rule.tail)
            if rule.any_case:
                head, tail = any_cased(head), any_cased(tail)
            ends[nfa.add(("all", [head, ("rep", tail, True)]), nfa.branch(start), True)] = 1 << k
            own = Nfa()
            first = own.state()
            forward = determined(own, [first], {own.add(head, first, False): 1}, False)
            dead = [s for s in range(len(forward.marks)) if not forward.marks[s] and (forward.next[s * 256 : s * 256 + 256] == s * 256).all()]
            self.heads.append((forward.next.tolist(), [bool(m) for m in forward.marks], dead[0] * 256 if dead else -1))
            inside = np.zeros(256, bool)
            inside[list(tail[1][0][1])] = True
            self.tails.append(inside)
        self.all = determined(nfa, [start], ends, True)

    def starts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in data at which matches start, ascending, and the rules' bits there."""
        lanes = max(1, min(self.LANES, len(data) // 64))
        length = -(-len(data) // lanes)
        grid = np.zeros(lanes * length, np.uint8)
        grid[: len(data)] = data
        columns = np.ascontiguousarray(grid.reshape(lanes, length).T).astype(np.int32)
        states = np.empty((length, lanes), np.int32)
        move = self.all.next
        now = np.zeros(lanes, np.int32)
        for k in range(length - 1, -1, -1):
            now = move[now + columns[k]]
            states[k] = now
        # Lanes that should have begun in another state than the initial one.
        begun = np.zeros(lanes, np.int32)
        while True:
            wanted = np.append(states[0, 1:], np.int32(0))
            lane = np.flatnonzero(wanted != begun)
            if not len(lane):
                break
            begun[lane] = wanted[lane]
            now = wanted[lane]
            for k in range(length - 1, -1, -1):
                now = move[now + columns[k, lane]]
                other = now != states[k, lane]
                lane, now = lane[other], now[other]
                if not len(lane):
                    break
                states[k, lane] = now
        k, lane = np.nonzero(states >= self.all.first_marked * 256)
        place = lane * length + k
        order = np.argsort(place, kind="stable")
        return place[order], self.all.marks[states[k, lane][order] >> 8]

    def _match(self, k: int, raw: bytes, at: int) -> tuple[int, int]:
        """Ends of the longest head and of the tail of the rule's match at `at`."""
        move, good, dead = self.heads[k]
        state, head, i = 0, at if good[0] else -1, at
        while i < len(raw):
            state = move[state + raw[i]]
            if state == dead:
                break
            i += 1
            if good[state >> 8]:
                head = i
        end, inside = head, self.tails[k]
        step = 256
        while True:
            out = np.flatnonzero(~inside[np.frombuffer(raw[end : end + step], np.uint8)])
            if len(out):
                return head, end + int(out[0])
            if end + step >= len(raw):
                return head, len(raw)
            end, step = end + step, step * 4

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text by start, then kind as listed; places are code points."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        raw = b"\0".join([*texts, b""])
        ahead = np.cumsum([0] + [len(t) + 1 for t in texts])
        places, bits = self.starts(np.frombuffer(raw, np.uint8))
        for k, rule in enumerate(self.rules):
            mine = places[(bits >> k & 1) == 1]
            i = 0
            while i < len(mine):
                a = int(mine[i])
                head, b = self._match(k, raw, a)
                if b - head >= rule.least:
                    out[int(np.searchsorted(ahead, a, "right")) - 1].append((a, k, b))
                i += 1
                if i < len(mine) and mine[i] < b:
                    i = int(np.searchsorted(mine, b))
        return [[(self.rules[k].kind, a, b) for a, k, b in self._points(t, sorted(found), int(base))] for t, found, base in zip(texts, out, ahead)]

    @staticmethod
    def _points(text: bytes, found: list[tuple[int, int, int]], base: int) -> list[tuple[int, int, int]]:
        if not found or text.isascii():
            return [(a - base, k, b - base) for a, k, b in found]
        points = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
        return [(int(points[a - base]), k, int(points[b - base])) for a, k, b in found]


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Bytes of texts that are scanned at once.
BLOCK_BYTES = 4 << 20


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each counted kind (n_assign and so on), base_sha256 (of those spans) and spans (all) of every row.

    A map over the rows: no shuffle. Null texts count as empty and have no span; rows that repeat are scanned each; a null
    doc_id stays null; further columns are left out; an empty table gives no rows. The automata, some hundred kilobytes
    that depend on the rules only, are compiled on the driver and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    base = [r.kind for r in rules if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            low = 0
            while low < len(texts):
                high, size = low + 1, len(texts[low])
                while high < len(texts) and size + len(texts[high]) <= BLOCK_BYTES:
                    size += len(texts[high])
                    high += 1
                found = sent.value.scan(texts[low:high])
                counted = [[s for s in f if s[0] in base] for f in found]
                columns = [batch.column(0).slice(low, high - low), *(pa.array([sum(s[0] == k for s in f) for f in counted], pa.int64()) for k in base)]
                columns += [pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in counted], pa.string()), pa.array(map(joined, found), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])
                low = high

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"n_{k} long" for k in base), "base_sha256 string", "spans string"])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents (see scan): null and empty texts have none, rows that repeat are scanned each."""
    return scan(common.read(spark, sf_dir, "documents"))
