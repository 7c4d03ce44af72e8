"""State changes as plans: upsert, insert-if-absent, supersede, deduplicate. The results are written by the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """old with new's rows by key: columns in keep stay as they were where the key exists, others are replaced.

    One full join on the key; both sides must hold a key once.
    """
    rest = [c for c in old.columns if c not in key]
    o, n = old.select(*key, F.struct(*rest).alias("o")), new.select(*key, F.struct(*rest).alias("n"))
    j = o.join(n, key, "full")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*key, *(pick(c).alias(c) for c in rest), F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").otherwise("updated").alias("action"))


def missing(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key doesn't exist yet."""
    return new.join(existing, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """rule, failures: for each named condition the rows that break it (null counts as breaking). One pass."""
    counted = df.agg(*(F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()))
    return counted.unpivot([], list(rules), "rule", "failures")


def repeats(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    """rule, failures: rows beyond the first of each key."""
    again = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n"))
    return again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(F.lit(rule).alias("rule"), "failures")


def keeps(rules: dict[str, Column]) -> Column:
    """Whether a row keeps all rules (null counts as breaking)."""
    return reduce(Column.__and__, (F.coalesce(test, F.lit(False)) for test in rules.values()), F.lit(True))


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_except(F.array(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules.items())), F.array(F.lit(None).cast("string")))


def split_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and rows that don't with the rules they break, which are named for these only."""
    return df.filter(keeps(rules)), df.filter(~keeps(rules)).withColumn("broken", broken_rules(rules))
