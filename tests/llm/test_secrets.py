"""Secret scans against the regular expressions themselves."""

import hashlib
import random
import re

import pytest

from marketglass.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.ASCII)
PLAIN = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6), "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]+"), lambda m: len(m[0]) >= 40), "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), lambda m: len(m[0]) >= 25),
    "webtoken": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)"), lambda m: len(m[1]) >= 20),
    "pem": (re.compile(r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY(-+)"), lambda m: len(m[1]) >= 5),
}
KINDS = list(PLAIN)


def plain(text, kinds=KINDS):
    found = [(m.start(), KINDS.index(k), m.end()) for k in kinds for m in PLAIN[k][0].finditer(text) if PLAIN[k][1](m)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner()


def odd_texts(n, seed):
    rng = random.Random(seed)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "api__key", "passwtoken", "=", ":", " ", "  ", '"', "'", "==", "AKIA", "AKIAAKIA", "A", "Z9", "0123456789abcdef", "deadbeef", "f", "g", "é", "\0", "\n", "ſ", "K",
            "ghp_", "gho_x", "Ab3" * 12, "xoxb-", "1234-abcd-" * 3, "eyJ", ".", "_-", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "word", "x" * 30, "+/", "secret=token: abcdefgh", "token=pass"]
    return ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("lanes", [1, 7, 4096])
def test_equals_the_expressions(scanner, monkeypatch, lanes):
    monkeypatch.setattr(secrets.Scanner, "LANES", lanes)
    texts = odd_texts(1500, lanes)
    for low in range(0, len(texts), 100):
        part = texts[low : low + 100]
        assert scanner.scan([t.encode() for t in part]) == [plain(t) for t in part]


def test_long_matches_cross_lanes(scanner):
    for text in ("a1" * 100_000, "token=" * 40_000, "x" * 5000 + "AKIA" + "B7" * 90_000 + " end", "password : '" + "é" * 9 + "secret='" + "q" * 150_000, "AKIA" * 60_000):
        assert scanner.scan([b"", text.encode(), b"deadbeef" * 4]) == [[], plain(text), plain("deadbeef" * 4)]


def test_automaton_is_minimal_and_small(scanner):
    assert 24 < len(scanner.all.marks) < 2000
    table = scanner.all.next.reshape(-1, 256)
    assert len({(m, *row) for m, row in zip(scanner.all.marks.tolist(), table.tolist())}) == len(table)


def test_awkward_rows(spark, scanner):
    rows = [(1, None, "a"), (2, "", "b"), (None, "token=abcdef", "c"), (3, "token=abcdef", "d"), (3, "token=abcdef", "d"), (4, "é token = 'abcdef", "e"), (5, "token=abcde", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.scan(df).collect()
    assert secrets.scan(df).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted((str(r.doc_id), r.n_assign, r.spans) for r in got) == sorted([("1", 0, ""), ("2", 0, ""), ("None", 1, "assign:0:12"), ("3", 1, "assign:0:12"), ("3", 1, "assign:0:12"), ("4", 1, "assign:2:17"), ("5", 0, "")])
    assert secrets.scan(df.limit(0)).count() == 0


def test_whole_table_equals_the_expressions(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op12_secret_scan(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain(docs[r.doc_id], KINDS[:3])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert r.spans == secrets.joined(plain(docs[r.doc_id]))
    assert sum(r.n_assign + r.n_hex for r in got) > 0
