"""Scalar text functions. Built-in expressions, but for the two that need Unicode normal forms and sequence matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.fillna("").str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def normalize_ascii(c: Column) -> Column:
    """Lower-case letters and digits with single spaces between; for ASCII text. Null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def normalize(c: Column) -> Column:
    """normalize_ascii after compatibility decomposition; other than ASCII is dropped."""
    return normalize_ascii(_fold(c))


def compact(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "), F.lit(""))


def similarity(a: Column, b: Column) -> Column:
    """Longest-matching-blocks ratio of two normalised texts: 1 if equal, 0 if either is empty or null."""
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(_ratio(a, b))


@F.pandas_udf(T.DoubleType())
def ratio_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """An upper bound of the sequence ratio of two normalised texts: by the characters that both hold, as often; 0 for null."""
    a, b = a.fillna(""), b.fillna("")

    def counts(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        at, unique = pd.factorize(s)
        out = np.zeros((len(unique), 256), np.int32)
        for k, x in enumerate(unique):
            out[k] = np.bincount(np.frombuffer(x.encode("latin-1", "replace"), np.uint8), minlength=256)
        return at, out[:, [32, *range(48, 58), *range(97, 123)]]

    (i, x), (j, y) = counts(a), counts(b)
    both = np.concatenate([np.minimum(x[i[k : k + 4096]], y[j[k : k + 4096]]).sum(axis=1) for k in range(0, len(i), 4096)]) if len(i) else np.zeros(0)
    return pd.Series(2.0 * both / np.maximum(1, a.str.len() + b.str.len()).to_numpy())


def token_share(title: Column, name: Column) -> Column:
    """Share of the name's distinct tokens that the title holds; 0 for a name of none."""
    tokens = F.array_distinct(F.filter(F.split(name, " "), lambda t: t != ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, F.split(title, " "))), F.size(tokens)), F.lit(0.0))


def name_similarity(title: Column, name: Column) -> Column:
    """The largest of the sequence ratio, the share of the name's tokens in the title, and 1 if the title holds the name."""
    share = token_share(title, name)
    inside = (name != "") & F.contains(title, name)
    return F.when(inside, 1.0).otherwise(F.greatest(similarity(F.when(~inside, title), name), share))


def slug_base(c: Column, default: str = "organization") -> Column:
    """Lower-case words joined by hyphens; accents fold to their letters."""
    s = F.btrim(F.regexp_replace(F.lower(_fold(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", default).otherwise(s)


def target_price(message: Column) -> Column:
    """The last number of a message (commas group digits, up to two digits behind the point); null unless above 0."""
    numbers = F.regexp_extract_all(F.lower(message), F.lit(r"[0-9][0-9,]*(?:\.[0-9]{1,2})?"), 0)
    n = F.replace(F.try_element_at(numbers, F.lit(-1)), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    return F.when(n > 0, n)


def whole_ids(values: Column) -> Column:
    """Those of an array of texts that are digits only, as numbers; what no long can hold is left out."""
    return F.array_compact(F.transform(values, lambda v: F.when(v.rlike("^[0-9]+$"), v.try_cast("long"))))


def label(name: Column) -> Column:
    """snake_case as words with capital initials; letters behind marks count as initials too."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    parts = F.regexp_extract_all(spaced, F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")


def compact_number(n: Column) -> Column:
    """1.2M from a million on, 12K (half up) from a thousand on, else the number as it is; null and not finite give ''."""
    n = n.cast("double")
    millions = F.concat(F.round(n / 1e6, 1).cast("decimal(20,1)").cast("string"), F.lit("M"))
    thousands = F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit("K"))
    plain = F.regexp_replace(n.cast("string"), r"\.0$", "")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), "").when(n >= 1e6, millions).when(n >= 1e3, thousands).otherwise(plain)


def file_name(path: Column, default: str = "sales-import.csv", most: int = 255) -> Column:
    """Last part of an uploaded path, trimmed, at most `most` characters; the default where nothing is left."""
    name = F.trim(F.element_at(F.split(F.rtrim(F.coalesce(path, F.lit("")), F.lit("/")), "/"), -1))
    return F.when(name == "", default).otherwise(F.left(name, F.lit(most)))


def variant(title: Column) -> Column:
    """What stands in brackets from a memory size on, as in '(8GB RAM, 256GB)'; '' without one."""
    return F.regexp_extract(title, r"(?i)\((\d+\s*GB[^)]*)\)", 1)


def sku(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s != "", s)


def spreadsheet_safe(c: Column) -> Column:
    """A leading apostrophe where a spreadsheet would take the text for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def price_number(c: Column) -> Column:
    """Digits and points of a price text as a number; 0 where nothing is left or it isn't one."""
    return F.coalesce(F.regexp_replace(c, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def last_segment(url: Column) -> Column:
    """Last path segment of a URL without trailing slashes, query or fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.element_at(F.split(path, "/"), -1)


def absolute_url(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)


def memory(title: Column) -> tuple[Column, Column]:
    """RAM and storage in GB named in a title: explicit marks first, else all sizes (RAM the first up to 32, storage the first other of at least 32)."""
    low = F.lower(title)
    ram = F.regexp_extract(low, r"(\d+)\s*gb\s*ram", 1)
    rom = F.regexp_extract(low, r"(\d+)\s*gb\s*(?:storage|rom)", 1)
    sizes = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+\s*(?:gb|tb))"), 1), lambda s: F.regexp_extract(s, r"(\d+)", 1).cast("int") * F.when(F.endswith(s, F.lit("tb")), 1024).otherwise(1)))
    first_ram = F.try_element_at(F.filter(sizes, lambda x: x <= 32), F.lit(1))
    found_ram = F.coalesce(F.nullif(ram, F.lit("")).cast("int"), first_ram)
    first_rom = F.try_element_at(F.filter(sizes, lambda x: (x >= 32) & (found_ram.isNull() | (x != found_ram))), F.lit(1))
    return found_ram, F.coalesce(F.nullif(rom, F.lit("")).cast("int"), first_rom)
