"""Byte-level BPE counts and ids, with the whole-token shortcut.

A vocabulary string that is one pre-token and encodes alone as one token never needs a merge. `whole_tokens` proves
offline which strings these are; the table goes to the workers by broadcast. Pre-tokens in it are counted directly
and only the rest are merged. Pre-tokens are cut by the library's own pre-tokenizer, so texts of any script take this
way. Where every white space of a text is a single space or line feed, which no pre-token crosses, the words between
them are looked up first, and only words not met before are cut and merged, all new ones of a batch together.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import common


#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every Unicode version classes alike (ASCII without controls, Latin-1 and Latin Extended letters).
PLAIN = re.compile(r"[\x20-\x7e\nÀ-ÖØ-öø-ſ]+")


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes in pre-tokens and in the vocabulary file, by the rule that defines them."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings, in byte letters, that are one pre-token and encode alone as one token, with their ids."""
    library = _library(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    back = {c: b for b, c in byte_letters().items()}
    out = {}
    for s, i in spec["model"]["vocab"].items():
        try:
            text = bytes(back[c] for c in s).decode("utf-8") if s not in special else ""
        except (KeyError, UnicodeDecodeError):
            continue
        cut = library.pre_tokenizer.pre_tokenize_str(text)
        if len(cut) == 1 and cut[0][0] == s and [t.id for t in library.model.tokenize(s)] == [i]:
            out[s] = i
    return out


class ByteBpe:
    """Token ids and counts as the tokenizers library gives them for a byte-level BPE file.

    Words are kept with what they gave, up to `limit` bytes (estimated). Then no more are kept, and when half of a
    batch's words are unknown, all are forgotten and it starts anew. So memory is bounded.
    """

    #: Estimated bytes of a kept word beside its characters.
    ENTRY = 200

    def __init__(self, path: str, whole: dict[str, int] | None = None, limit: int = 80_000_000, special: bool = True):
        import tiktoken

        self.library = _library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        found = {t["content"]: t["id"] for t in added}
        # Without `special`, their strings are plain text.
        self.special = found if special else {}
        # Special strings with further rules, or several of them, are left to the library.
        self.plain_special = len(added) < 2 and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in found}
        self.line_feed = ranks[b"\n"]
        self.merger = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = self.library.pre_tokenizer.pre_tokenize_str
        self.whole = whole_tokens(path) if whole is None else whole
        self.limit = limit
        # Whole tokens as words: with a space before them, or at a line feed.
        self.known = {"".join(chr(back[c]) for c in s): i for s, i in self.whole.items() if s.isascii() or s[0] == "\u0120" and s[1:].isascii()}
        self._forget()

    def _forget(self) -> None:
        self.counts: dict[str, int] = {s[1:]: 1 for s in self.known if s[0] == " " and len(s) > 1} | {"\n" + s: 2 for s in self.known if s[0] not in " \n"}
        self.packed: dict[str, bytes] = {}
        self.size = 0

    def _ids(self, s: str) -> list[int]:
        """Ids of a text without special strings, pre-token by pre-token."""
        out: list[int] = []
        for p, (a, b) in self.cut(s):
            i = self.whole.get(p)
            if i is None:
                out += self.merger._encode_single_piece(s[a:b])
            else:
                out.append(i)
        return out

    def text_ids(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            return self._ids(text)
        if not self.plain_special:
            return self.library.encode(text, add_special_tokens=False).ids
        ((name, number),) = self.special.items()
        first, *rest = text.split(name)
        out = self._ids(first)
        for part in rest:
            out.append(number)
            out += self._ids(part)
        return out

    def words(self, text: str) -> list[str] | None:
        """Words that no pre-token crosses, each with the line feed before it or without the space before it.

        One line feed is put before the text. None for a text with other white space, or with a special string.
        """
        words = text.split()
        if not words or any(s in text for s in self.special):
            return None
        feeds = "\n" in text
        if " ".join(words) != (text.replace("\n", " ") if feeds else text):
            return None
        if feeds:
            words = text.replace("\n", " \n").split(" ")
        words[0] = "\n" + words[0]
        return words

    def _counted(self, ids: np.ndarray, starts: list[int], fed: list[bool]) -> list[int]:
        return [b - a - (not f) for a, b, f in zip(starts, starts[1:], fed)]

    def _packed(self, ids: np.ndarray, starts: list[int], fed: list[bool]) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[4 * (a + (not f)) : 4 * b] for a, b, f in zip(starts, starts[1:], fed)]

    def _learn(self, words: list[str], kept: dict, values, one) -> dict:
        """What new words give; those that there is room for are kept."""
        plain = words if PLAIN.fullmatch("".join(words)) else [w for w in words if PLAIN.fullmatch(w)]
        got: dict = {}
        if plain:
            # A line feed stands before each: a pre-token of its own, by which the ids are told apart.
            fed = [w[0] == "\n" for w in plain]
            ids = np.asarray(self.merger.encode_ordinary("".join(w if f else "\n " + w for w, f in zip(plain, fed))), "<u4")
            starts = np.append(np.flatnonzero(ids == self.line_feed), len(ids)).tolist()
            got = dict(zip(plain, values(ids, starts, fed)))
        if len(plain) < len(words):
            got.update((w, one(self._ids(w if w[0] == "\n" else " " + w))) for w in words if w not in got)
        size = sum(map(len, got)) + self.ENTRY * len(got)
        if self.size + size <= self.limit:
            self.size += size
            kept.update(got)
        return got

    def _all(self, texts: list[str], kept: dict, values, one) -> list[list | None]:
        """The values of each text's words; None for texts that are cut whole."""
        out, later, new, seen = [], [], {}, 0
        for text in texts:
            words = self.words(text)
            found = None if words is None else list(map(kept.get, words))
            if found is not None:
                seen += len(found)
                if None in found:
                    missing = [i for i, v in enumerate(found) if v is None]
                    names = [words[i] for i in missing]
                    new.update(dict.fromkeys(names))
                    later.append((found, missing, names))
            out.append(found)
        if new:
            got = self._learn(list(new), kept, values, one)
            for found, missing, names in later:
                for i, w in zip(missing, names):
                    found[i] = got[w]
            if 2 * len(new) > seen and 2 * self.size > self.limit:
                self._forget()
        return out

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids (unsigned 32-bit, little-endian) of words as `words` gives them; none is kept."""
        size = self.size
        got = self._learn(words, {}, self._packed, lambda ids: np.array(ids, "<u4").tobytes()) if words else {}
        self.size = size
        return got

    def count_all(self, texts: list[str]) -> list[int]:
        found = self._all(texts, self.counts, self._counted, len)
        return [len(self.text_ids(t)) if f is None else sum(f) - 1 for t, f in zip(texts, found)]

    def ids_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids as unsigned 32-bit little-endian integers."""
        found = self._all(texts, self.packed, self._packed, lambda ids: np.array(ids, "<u4").tobytes())
        return [np.array(self.text_ids(t), "<u4") if f is None else np.frombuffer(b"".join(f), "<u4")[1:] for t, f in zip(texts, found)]


def load(path: str, whole: dict[str, int] | None = None) -> ByteBpe:
    """The tokenizer that this Python worker uses now; the file lies at the same path on every machine."""
    return common.kept(("byte bpe", path), lambda: ByteBpe(path, whole))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
