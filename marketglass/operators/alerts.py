"""Alerts in batch: price targets that fire once, and risk levels that fire when they rise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matches(alerts: DataFrame, points: DataFrame, available_only: bool = False) -> DataFrame:
    """Captures that concern an active alert: of its product, or of its listing, in its currency where both have one.

    An alert has one kind of target, so two equi joins cover the disjunction and give no pair twice. points may be a
    stream. Unavailable captures count too, unless available_only.
    """
    a, p = alerts.filter("is_active"), points.filter("is_available") if available_only else points
    key = ["currency"] if "currency" in alerts.columns and "currency" in points.columns else []
    # The captures' side comes first: a stream keeps its partitioning, and the alerts are the static side.
    whole = p.join(a.filter("on_product").drop("seller_id"), ["product_id", *key])
    one = p.join(a.filter("not on_product"), ["product_id", "seller_id", *key])
    return whole.select("alert_id", "target_price", *_ORDER).unionByName(one.select("alert_id", "target_price", *_ORDER))


def first_triggers(alerts: DataFrame, points: DataFrame, available_only: bool = False) -> DataFrame:
    """Each active alert's first capture at or below its target. Targets are filtered before the first capture is taken
    with a partial minimum."""
    hits = matches(alerts, points, available_only).filter("price <= target_price")
    g = hits.groupBy("alert_id").agg(F.min(F.struct(*_ORDER)).alias("x"), F.count(F.lit(1)).alias("qualifying"))
    return g.select("alert_id", F.to_date("x.captured_at").alias("triggered_on"), F.col("x.price").cast("decimal(18,2)").alias("price"), "qualifying")


def evaluated(alerts: DataFrame, points: DataFrame) -> DataFrame:
    """Of each active alert that captures concern: when it was last checked, and its first trigger (null without one).

    One grouping, so it runs as a stream too: the state is a row an alert. An alert that the table tells has triggered
    (is_triggered, where there is such a column) is checked, but doesn't trigger again.
    """
    found = matches(alerts, points)
    armed = F.lit(True)
    if "is_triggered" in alerts.columns:
        found = found.join(alerts.select("alert_id", F.coalesce("is_triggered", F.lit(False)).alias("_done")), "alert_id")
        armed = ~F.col("_done")
    hit = F.when(armed & (F.col("price") <= F.col("target_price")), F.struct(*_ORDER))
    g = found.groupBy("alert_id").agg(F.max("captured_at").alias("last"), F.min(hit).alias("x"))
    return g.select("alert_id", F.to_date("last").alias("last_checked"), F.col("x").isNotNull().alias("is_triggered"), F.to_date("x.captured_at").alias("triggered_on"), F.col("x.price").cast("decimal(18,2)").alias("price"))


_ORDER = ("captured_at", "ord", "line", "price")


def trigger_once(captures: DataFrame, target: float) -> DataFrame:
    """Per user, the first capture with a value at or below target."""
    g = captures.filter(F.col("value") <= target).groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "value")).alias("x"))
    return g.select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.value").alias("value"))


def rising_edges(captures: DataFrame, threshold: float) -> DataFrame:
    """Captures at which a user's level becomes high (value at or above threshold)."""
    high = F.col("value") >= threshold
    before = F.lag(high).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return captures.withColumn("was", F.coalesce(before, F.lit(False))).filter(high & ~F.col("was")).select("event_id", "user_id", "value")


def duplicates(alerts: DataFrame) -> DataFrame:
    """Active alerts of one user for one target: the number beyond the first."""
    return alerts.filter("is_active").groupBy("product_id", "seller_id").agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0")
