"""Personal data: exact rules, and a linear-chain conditional random field over word shapes that adds spans.

The field labels tokens (words, numbers, single marks) as outside or as beginning or inside of an e-mail address, an
IP address, a card number or a phone number. It is trained on the small labelled table below, and finds written
forms that the rules don't have, such as "jo at mail dot org" or a phone number without a plus. Whatever a plausible
span may be lies in one run: numbers with the marks between them, or words joined by marks or by words such as "at"
and "dot". Tokens further than REACH characters (widened to white space) from every run that has a cue (a digit, an
at-sign or the word "at", in brackets or not) are outside by constraint, so the chain falls into independent windows;
under that constraint decoding these by Viterbi is exact however long the text or the run is. An added span must
not overlap a rule's span and must pass its kind's test (parts up to 255, Luhn's check, number of digits).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, crf

KINDS = ("email", "ip", "card", "phone")
#: Labels: outside, then begin and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
HASHED = 1 << 12
REACH = 48
#: How far a window is widened to white space.
WIDEN = 256

# The rules. A run of one class is entered at its start only, which gives the same matches.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: No plausible span is without one of these.
CUE = re.compile(r"[0-9@]|\b[Aa][Tt]\b")
_ATOM = r"[^\W_]++(?:[._%+-]++[^\W_]++)*+"
_WORD = r"(?:at|dot|punkt|point|punto)"
_JOIN = rf"\s*+(?:[(\[]\s*+{_WORD}\s*+[)\]]|@|\.|\b{_WORD}\b)\s*+"
#: Runs that a span can't leave: joined words, and numbers with marks; single cues for the rest. Joined words and the
#: marks before a number are entered at their first character only, so a text is passed once.
RUN = re.compile(rf"(?<![\w.%+-])[._%+-]*+{_ATOM}(?:{_JOIN}{_ATOM})+|(?<![+(])[+(]*+[0-9](?:[0-9+(). /-]*[0-9])?|{CUE.pattern}", re.IGNORECASE)
#: A written-out address: a full stop joins words only with white space on both sides or on none.
_PART = r"[^\W_]+(?:[_%+-]+[^\W_]+)*"
_DOT = r"(?:\.|\s+\.\s+|\s*[(\[]\s*(?:dot|punkt|point|punto)\s*[)\]]\s*|\s+(?:dot|punkt|point|punto)\s+)"
WRITTEN = re.compile(rf"{_PART}(?:{_DOT}{_PART})*(?:{_DOT})?\s*(?:@|[(\[]\s*at\s*[)\]]|\bat\b)\s*{_PART}(?:{_DOT}{_PART})+", re.IGNORECASE)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\sA-Za-z0-9]|_")

#: The labelled table. A tagged part is [kind text].
LABELLED = """
write to [email jo.81@mail7.example.com] for more
her address is [email anna.b-k@post.example.org], he said
mail [email x_y%z+news@a-b.co.uk] or come by
contact [email jo at mail7 dot example dot com] today
reach me under [email maria dot lopez at post dot org] soon
an [email max punkt mustermann at web punkt de] senden
schreib an [email eva punkt k at post punkt de] bitte
escribe a [email ana punto ruiz at correo punto es] hoy
ecris a [email luc point dupont at poste point fr] demain
to [email lee dot ann dot park at mail dot example dot org] by noon
ask [email kim (at) example (dot) net] about it
send it to [email lee[at]example[dot]com] now
schreib an [email max punkt at web dot de] bitte
we met at noon and left at 5
at the house of 12 they sat at a table
the host [ip 192.168.10.4] is down
from [ip 97.51.17.173] and [ip 8.8.4.4] came
address [ip 10 . 0 . 12 . 7] was seen
on [ip 172.16.254.1], port 8080
version 1.2.3 and 4.0. and 3. came out
see section 2.4.1 and page 17
paid with [card 9807915762804490] in may
card [card 4111 1111 1111 1111] was used
la carte [card 5500-0000-0000-0004] est perdue
number [card 3782 822463 10005] expires 08/27
mit [card 6011.1111.1111.1117] bezahlt
order 20240117 has 3 parts
the year 1999 and 2024, 50 % and 3,5 kg
call [phone +1 (319) 555-5132] today
ring [phone +44 20 7946 0958] before 9
phone [phone (319) 555-5132] or write
tel [phone 319-555-5132] at night
tel. [phone 319.555.5132] bitte
mobile [phone 0049 170 1234567] nur abends
phone: [phone 555-0134] ask for jo
on 2024-01-05 and 05.01.2024 at 10:30
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ends
key 5d190bd7c06284de91015a36974748794293dd8a here
id 4c226-790fc and room 12-34 of 7
isbn 978-3-16-148410-0 of the book
costs 1,250.00 or 99.95 in all
from 10-20 to 30-40 words
""".strip()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' spans by kind, then start; ends are exclusive; positions are code points."""
    out = []
    if "@" in text:
        at, m = 0, EMAIL.search(text)
        while m:
            out.append(("email", m.start(), m.end()))
            at = m.end()
            m = EMAIL_HERE.match(text, at) or EMAIL.search(text, at)
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def shape(token: str) -> str:
    if "0" <= token[0] <= "9":
        return f"9{min(len(token), 20)}"
    if token[0].isalpha():
        return ("x" if token.islower() else "X") + str(min(len(token), 4))
    return token


def token_features(tokens: list[str], spaced: list[bool]) -> Iterator[list[str]]:
    """Shapes of a token and its neighbours, whether a space stands between, and the words that connect parts."""
    low = [t.lower() if t.isalpha() and len(t) <= 6 and t.lower() in CONNECTING else "" for t in tokens]
    s = ["^", "^", *map(shape, tokens), "$", "$"]
    g = ["", "", *("_" if x else "" for x in spaced), "_", ""]
    w = ["", "", *low, "", ""]
    value = ["" if not "0" <= t[0] <= "9" or len(t) > 3 else "b" if int(t) <= 255 else "B" for t in tokens]
    for k in range(2, len(tokens) + 2):
        yield [
            f"s{s[k]}", f"w{w[k]}", f"v{value[k - 2]}", f"p{s[k - 1]}{g[k]}|{s[k]}", f"n{s[k]}{g[k + 1]}|{s[k + 1]}", f"P{s[k - 2]}{s[k - 1]}|{s[k]}",
            f"N{s[k]}|{s[k + 1]}{s[k + 2]}", f"b{s[k - 1]}{g[k]}{s[k]}{g[k + 1]}{s[k + 1]}", f"c{w[k - 1]}|{s[k]}|{w[k + 1]}", f"d{w[k - 2]}|{w[k - 1]}|{s[k]}", f"g{g[k]}{s[k][0]}",
        ]


#: Words that join the parts of a written-out address or announce a number.
CONNECTING = {"at", "dot", "punkt", "point", "punto", "tel", "phone", "call", "card", "mail", "token", "key", "id", "look", "looked", "stays", "arrive", "pages"}


def hashed(rows: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh32_intdigest

    cache: dict[str, int] = {}
    numbers: list[int] = []
    sizes: list[int] = []
    for row in rows:
        for f in row:
            n = cache.get(f)
            if n is None:
                n = cache[f] = xxh32_intdigest(f) % HASHED
            numbers.append(n)
        sizes.append(len(row))
    ends = np.cumsum(sizes)
    return np.array(numbers, np.int64), ends - np.array(sizes)


def tokenise(text: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    found = list(TOKEN.finditer(text))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    return [m.group() for m in found], starts, ends, [k > 0 and starts[k] > ends[k - 1] for k in range(len(found))]


def labelled_rows(table: str = LABELLED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of the labelled table and their spans."""
    out = []
    for line in table.splitlines():
        text, spans = "", []
        for part in re.split(r"(\[(?:email|ip|card|phone) (?:[^\[\]]|\[\w+\])*\])", line):
            m = re.fullmatch(r"\[(email|ip|card|phone) (.*)\]", part)
            if m:
                spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        out.append((text, spans))
    return out


class Model:
    """The trained field."""

    def __init__(self, rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None, copies: int = 12, epochs: int = 60, seed: int = 2):
        rng = np.random.default_rng(seed)
        rows = labelled_rows() if rows is None else rows
        features: list[list[str]] = []
        y: list[int] = []
        begins: list[bool] = []
        for copy in range(copies):
            for text, spans in rows:
                # Other digits of the same shape, and another word in front, so that shapes and not values are learned.
                if copy:
                    text = "".join(str(rng.integers(0, 10)) if c.isdigit() and not any(k == "ip" and a <= i < b for k, a, b in spans) else c for i, c in enumerate(text))
                tokens, starts, ends, spaced = tokenise(text)
                at = 0 if copy % 2 == 0 else int(rng.integers(0, max(1, min([k for k, (s, e) in enumerate(zip(starts, ends)) if any(a <= s < b for _, a, b in spans)], default=1))))
                features += token_features(tokens[at:], spaced[at:])
                begins += [True] + [False] * (len(tokens) - at - 1)
                for s in starts[at:]:
                    y.append(next((LABELS.index(("B-" if s == a else "I-") + k) for k, a, b in spans if a <= s < b), 0))
        at, offsets = hashed(features)
        field = crf.Field(HASHED, len(LABELS), rate=0.5)
        yy, bb = np.array(y), np.array(begins)
        for _ in range(epochs):
            field.update(at, offsets, yy, bb, copies * len(rows))
        self.weights = field.weights
        # Inside follows begin or inside of its kind only.
        t = np.log(field.transition() + 1e-12)
        for k in range(len(KINDS)):
            for before in range(len(LABELS)):
                if before not in (1 + 2 * k, 2 + 2 * k):
                    t[before, 2 + 2 * k] = -1e9
        self.transition = t
        self.start = np.array([0.0 if k == 0 or k % 2 else -1e9 for k in range(len(LABELS))])

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Parts of the text that may hold spans: whole runs and REACH characters beside them, widened to white space."""
        out: list[list[int]] = []
        for m in RUN.finditer(text) if CUE.search(text) else ():
            if not CUE.search(m.group()):
                continue
            low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
            done = out[-1][1] if out else 0
            if high <= done:
                continue
            # To white space, or beyond WIDEN characters to the end of a token; each character is passed once.
            least, most = low - WIDEN, high + WIDEN
            while low > done and not text[low - 1].isspace() and (low > least or text[low - 1].isalnum() and text[low].isalnum()):
                low -= 1
            while high < len(text) and not text[high].isspace() and (high < most or text[high - 1].isalnum() and text[high].isalnum()):
                high += 1
            if out and low <= done:
                out[-1][1] = high
            else:
                out.append([low, high])
        return [(a, b) for a, b in out]

    def added(self, texts: list[str], found: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text beside those found by the rules."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        held = []
        for k, text in enumerate(texts):
            for a, b in self.windows(text):
                tokens, starts, ends, spaced = tokenise(text[a:b])
                if tokens:
                    held.append((k, a, tokens, starts, ends, spaced))
        held.sort(key=lambda h: len(h[2]))
        low = 0
        while low < len(held):
            # Windows of similar length together, at most about 200,000 cells of the trellis.
            high = low + 1
            while high < len(held) and high - low < 256 and (high - low + 1) * len(held[high][2]) <= 20_000:
                high += 1
            part = held[low:high]
            low = high
            at, offsets = hashed(f for h in part for f in token_features(h[2], h[5]))
            scores = np.add.reduceat(self.weights[at], offsets, axis=0).astype(np.float64)
            lengths = np.array([len(h[2]) for h in part])
            grid = np.zeros((len(part), lengths.max(), len(LABELS)))
            grid[np.arange(lengths.max())[None] < lengths[:, None]] = scores
            grid[:, 0] += self.start
            best = crf.viterbi(grid, lengths, self.transition)
            for (k, a, tokens, starts, ends, _), labels in zip(part, best):
                if labels[: len(tokens)].any():
                    out[k] += self._spans(texts[k], a, labels[: len(tokens)].tolist(), starts, ends, found[k])
        return [sorted(set(o)) for o in out]

    @staticmethod
    def _spans(text: str, base: int, labels: list[int], starts: list[int], ends: list[int], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        out, k = [], 0
        while k < len(labels):
            if labels[k] % 2 == 1:
                j = k + 1
                while j < len(labels) and labels[j] == labels[k] + 1:
                    j += 1
                kind, a, b = KINDS[labels[k] // 2], base + starts[k], base + ends[j - 1]
                if plausible(kind, text[a:b]) and not any(a < e and s < b for _, s, e in found):
                    out.append((kind, a, b))
                k = j
            else:
                k += 1
        return out


def plausible(kind: str, s: str) -> bool:
    d = digits_of(s)
    if kind == "email":
        return WRITTEN.fullmatch(s) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9. ]", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9. -]", s)
    # Local numbers of seven digits begin with 2 to 9; ranges such as 100-2000 don't.
    return 7 <= len(d) <= 15 and (len(d) > 7 or d[0] not in "01") and not re.search(r"[^0-9+(). /-]", s) and re.search(r"[ )./-]", s) is not None


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap, all are covered by the first's."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(model: Model, texts: list[str]) -> tuple[list, list]:
    base = [base_spans(t) for t in texts]
    return base, [b + a for b, a in zip(base, model.added(texts, base))]


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (spans by the rules), base_sha256, spans (all) of every row.

    A map over the rows. Null texts count as empty and have no span. Rows that repeat are searched each; a null
    doc_id stays null; further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or Model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, every = _find(sent.value, batch.column(1).to_pylist())
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        sums = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sums, pa.string()), pa.array(map(joined, every), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_slices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets.

    Null texts stay null and empty ones empty; rows that repeat are each redacted; other columns, of any name, stay. An
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or Model())
    docs_names = docs.columns
    at = docs_names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        _, every = _find(sent.value, [t or "" for t in texts])
        new = pa.array([redacted(t, s) if s else t for t, s in zip(texts, every)], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], docs_names)

    return common.map_slices(docs, run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents (see find): null and empty texts have none, rows that repeat are searched each."""
    return find(common.read(spark, sf_dir, "documents"))
