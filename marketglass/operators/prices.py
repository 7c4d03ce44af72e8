"""Price history: summaries, buying guidance, comparison, forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import average, half_up, percent

#: What orders a listing's captures totally.
ORDER = ("captured_at", "ord", "line", "price")


def between(points: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Captures from start to end, both inclusive; either may be None. Refuses an inverted range."""
    if start is not None and end is not None and start > end:
        raise ValueError("start is after end")
    tests = [F.col("captured_at") >= F.lit(start).cast("timestamp")] if start is not None else []
    tests += [F.col("captured_at") <= F.lit(end).cast("timestamp")] if end is not None else []
    return points.filter(reduce(Column.__and__, tests)) if tests else points


def summary(points: DataFrame, listings: DataFrame, *key: str) -> DataFrame:
    """Lowest, highest and average price of each listing, and the change of its current price from its first capture.

    Listings without captures have their current price only.
    """
    first = F.min(F.struct(*ORDER)).alias("f")
    g = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.sum("price").alias("total"), first, F.max("captured_at").alias("last_at"))
    j = listings.select(*key, "current_price").join(g, list(key), "left")
    change = F.col("current_price") - F.col("f.price")
    return j.select(
        *key, F.col("current_price").cast("decimal(18,2)").alias("current_price"), F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"),
        F.col("lowest").cast("decimal(18,2)").alias("lowest"), F.col("highest").cast("decimal(18,2)").alias("highest"), average(F.col("total"), F.col("n_points")).alias("average"),
        change.cast("decimal(18,2)").alias("change"), F.when(F.col("f.price") > 0, percent(change, F.col("f.price"))).alias("change_pct"),
        F.to_date("f.captured_at").alias("first_day"), F.to_date("last_at").alias("last_day"),
    )


def point_statistics(points: DataFrame, *key: str) -> DataFrame:
    """Statistics from captures alone: the last capture is current; change in percent is 0 where the first isn't above 0."""
    g = points.groupBy(*key).agg(F.min(F.struct(*ORDER)).alias("f"), F.max(F.struct(*ORDER)).alias("l"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.sum("price").alias("total"), F.count(F.lit(1)).alias("n"))
    change = F.col("l.price") - F.col("f.price")
    return g.select(*key, F.col("l.price").cast("decimal(18,2)").alias("current"), F.col("lowest").cast("decimal(18,2)").alias("lowest"), F.col("highest").cast("decimal(18,2)").alias("highest"), average(F.col("total"), F.col("n")).alias("average"), change.cast("decimal(18,2)").alias("change"), F.when(F.col("f.price") > 0, percent(change, F.col("f.price"))).otherwise(F.lit(0).cast("decimal(18,2)")).alias("change_pct"))


def guidance(points: DataFrame, listings: DataFrame) -> DataFrame:
    """Buy or wait, for each product with listings.

    The current low is over all listings, available or not; history is of available captures. Within 2 % of the
    low: buy_now. At least five captures and more than 3 % above their average: wait. Coverage counts started days
    of elapsed time. Prices are compared exactly, in cents, with the average rounded half up.
    """
    now = listings.groupBy("product_id").agg(F.min("current_price").alias("current_lowest"))
    seen = points.filter("is_available").groupBy("product_id").agg(F.min("price").alias("low"), F.sum("price").alias("total"), F.count(F.lit(1)).alias("n"), F.min("captured_at").alias("a"), F.max("captured_at").alias("b"))
    days = F.greatest(F.lit(1), F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / F.lit(86_400_000_000)) + 1).cast("long")
    j = now.join(seen, "product_id", "left").withColumn("mean", average(F.col("total"), F.col("n"))).withColumn("coverage_days", F.when(F.col("n") > 0, days).otherwise(0))
    n = F.coalesce("n", F.lit(0))
    rule = (
        F.when(n == 0, "insufficient_data")
        .when(F.col("current_lowest") * 100 <= F.col("low") * 102, "buy_now")
        .when((n >= 5) & (F.col("current_lowest") * 100 > F.col("mean") * 103), "wait")
        .otherwise("price_stable")
    )
    trust = F.when((n >= 20) & (F.col("coverage_days") >= 30), "high").when((n >= 5) & (F.col("coverage_days") >= 7), "medium").otherwise("low")
    d = lambda c: F.col(c).cast("decimal(18,2)").alias(c)
    return j.select("product_id", rule.alias("suggestion"), trust.alias("confidence"), d("current_lowest"), d("low"), d("mean"), n.cast("long").alias("n_points"), F.col("coverage_days").cast("long").alias("coverage_days"))


def reasons(guided: DataFrame) -> DataFrame:
    """guided with limitations, joined by '; ': little data first, then the standing note."""
    few = F.when(F.col("confidence") == "low", "limited observations or time coverage")
    note = F.lit("a rule over stored history, not a forecast")
    return guided.withColumn("limitations", F.array_join(F.array_compact(F.array(few, note)), "; "))


def personalise(guided: DataFrame, alerts: DataFrame, listings: DataFrame) -> DataFrame:
    """guided with the user's own target, for products with active alerts.

    Of a product's active alerts the newest product alert counts, else the newest of an available listing, else the
    newest. A product alert is compared with the current low, a listing alert with that listing's price, which is
    unknown while the listing is unavailable: then there is no gap, and insufficient data.
    """
    seen = listings.select("product_id", "seller_id", F.col("current_price").alias("own_price"), F.col("is_available").alias("open"))
    a = alerts.filter("is_active").join(seen, ["product_id", "seller_id"], "left")
    rank = F.when(F.col("on_product"), 2).when(F.col("open"), 1).otherwise(0)
    best = a.groupBy("product_id").agg(F.max(F.struct(rank.alias("rank"), "alert_id", "target_price", F.when(F.col("open"), F.col("own_price")).alias("own"))).alias("a"))
    j = guided.join(best, "product_id").withColumn("evaluated", F.when(F.col("a.rank") == 2, F.col("current_lowest")).otherwise(F.col("a.own")).cast("decimal(18,2)"))
    target = F.col("a.target_price").cast("decimal(18,2)")
    gap = F.when(F.col("evaluated").isNotNull(), F.greatest(F.lit(0).cast("decimal(18,2)"), F.col("evaluated") - target).cast("decimal(18,2)"))
    reached = F.col("evaluated") <= target
    signal = F.when(F.col("evaluated").isNull(), "insufficient_data").when(reached, "buy_now").otherwise("wait")
    return j.select("product_id", F.col("a.alert_id").alias("alert_id"), target.alias("target_price"), "evaluated", gap.alias("gap"), percent(gap, target).alias("gap_pct"), reached.alias("reached"), signal.alias("suggestion"))


def compare(products: DataFrame, listings: DataFrame, ids: list[int]) -> DataFrame:
    """Cheapest of two or three distinct products, and the gap to the dearest in percent of the cheapest.

    No row if one is missing, none has an available listing, or the products' cheapest listings (column currency, one
    currency where there is none) differ in currency. One priced product has no gap. Ties go to the first of ids.
    """
    if not 2 <= len(ids) <= 3 or len(set(ids)) != len(ids):
        raise ValueError("two or three distinct products")
    rank = F.array_position(F.array(*(F.lit(i).cast("long") for i in ids)), F.col("product_id"))
    if "currency" not in listings.columns:
        listings = listings.withColumn("currency", F.lit("PKR"))
    open_ = listings.filter(F.col("product_id").isin(ids) & F.col("is_available"))
    low = open_.groupBy("product_id").agg(F.min(F.struct("current_price", "seller_id", "currency")).alias("x")).select("product_id", F.col("x.current_price").alias("p"), F.col("x.currency").alias("currency"))
    there = products.filter(F.col("product_id").isin(ids)).join(low, "product_id", "left")
    cheapest = F.min(F.when(F.col("p").isNotNull(), F.struct("p", rank.alias("r"), "product_id", "name"))).alias("c")
    g = there.agg(F.count("product_id").alias("n"), F.count("p").alias("priced"), cheapest, F.max("p").alias("top"), F.countDistinct("currency").alias("currencies"), F.min("currency").alias("currency"))
    gap = F.when(F.col("priced") > 1, F.col("top") - F.col("c.p"))
    return g.filter((F.col("n") == len(ids)) & (F.col("currencies") == 1)).select(
        F.col("c.product_id").alias("cheapest_id"), F.col("c.name").alias("cheapest_name"), F.col("c.p").cast("decimal(18,2)").alias("cheapest_price"), "currency",
        gap.cast("decimal(18,2)").alias("gap"), F.when(F.col("c.p") > 0, percent(gap, F.col("c.p"))).alias("gap_pct"),
    )


def publish(active: DataFrame, documents: DataFrame) -> DataFrame:
    """documents (variant_id, forecast_id, generated_at) with outcome: published, superseded or rejected.

    Documents come in the order of forecast_id; one that isn't strictly newer than the variant's newest so far, stored
    or sent before it, is rejected. Of those accepted the last stays published, the others are superseded.
    """
    held = active.groupBy("variant_id").agg(F.max("generated_at").alias("held"))
    w = Window.partitionBy("variant_id").orderBy("forecast_id")
    j = documents.join(held, "variant_id", "left").withColumn("before", F.greatest("held", F.max("generated_at").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    newest = F.max(F.greatest("held", "generated_at")).over(Window.partitionBy("variant_id"))
    j = j.withColumn("newest", newest)
    outcome = F.when(F.col("generated_at") <= F.col("before"), "rejected").when(F.col("generated_at") < F.col("newest"), "superseded").otherwise("published")
    return j.select("variant_id", "forecast_id", outcome.alias("outcome"))


def forecast_answer(products: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every product with its active forecast, or the plain statement that there is none."""
    j = products.select("product_id").join(newest_forecast(forecasts).withColumnRenamed("variant_id", "product_id"), "product_id", "left")
    return j.withColumn("status", F.when(F.col("forecast_id").isNull(), "no_forecast").otherwise("available"))


def contract_breaches(documents: DataFrame) -> DataFrame:
    """documents with `broken`: the rules of the forecast contract that they break.

    documents: horizon, generated_at, points (an array of structs with column at, in the order sent). Points must be as
    many as the horizon says, in ascending order, each time once, and all after generated_at.
    """
    days = F.transform("points", lambda p: p["at"])
    rules = {
        "horizon": F.size(days) == F.col("horizon"), "order": days == F.array_sort(days), "repeats": F.size(F.array_distinct(days)) == F.size(days),
        "future": F.forall(days, lambda x: x > F.col("generated_at")),
    }
    return documents.withColumn("broken", F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules.items()))))


def newest_forecast(forecasts: DataFrame) -> DataFrame:
    """The active forecast of each variant: the newest, of the highest id."""
    g = forecasts.groupBy("variant_id").agg(F.max(F.struct("generated_at", "forecast_id", "predicted_price")).alias("x"))
    return g.select("variant_id", F.col("x.forecast_id").alias("forecast_id"), F.to_date("x.generated_at").alias("generated_on"), F.col("x.predicted_price").cast("decimal(18,2)").alias("predicted_price"))


def forecast_versions(forecasts: DataFrame) -> DataFrame:
    """Every forecast with its version (1 is the newest) and whether it is active."""
    w = Window.partitionBy("variant_id").orderBy(F.col("generated_at").desc(), F.col("forecast_id").desc())
    return forecasts.withColumn("version", F.row_number().over(w)).select("variant_id", "forecast_id", "version", (F.col("version") == 1).alias("is_active"))


def day_low(points: DataFrame) -> DataFrame:
    return points.filter("is_available").groupBy(F.to_date("captured_at").alias("day")).agg(F.min("price").cast("decimal(18,2)").alias("low"))


def with_forecast_days(lows: DataFrame, forecast_days: DataFrame) -> DataFrame:
    """Daily lows and predicted prices (day, predicted) on one time line."""
    return lows.join(forecast_days, "day", "full").select("day", "low", "predicted")


def recent(points: DataFrame, n: int, *key: str) -> DataFrame:
    """The latest n captures of each listing, numbered from the oldest of them."""
    down = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in ORDER))
    up = Window.partitionBy(*key).orderBy(*ORDER)
    return points.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") <= n).withColumn("position", F.row_number().over(up)).drop("_r")


def changes_only(captures: DataFrame) -> DataFrame:
    """Captures whose price differs from the one before, and the first of each user."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return captures.withColumn("before", before).filter(F.col("before").isNull() | (F.col("value") != F.col("before")))


def discount(original: Column, current: Column) -> Column:
    """Whole percent off, half up; 0 where the original isn't above the current price."""
    return F.when(original > current, half_up(F.try_divide((original - current) * 100, original), 0)).otherwise(F.lit(0).cast("decimal(18,0)")).cast("long")
