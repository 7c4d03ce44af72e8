"""Competitors: gaps and risk, inverse-price shares, pricing scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import average, half_up, percent


def level(own: Column, other: Column, threshold: float) -> tuple[Column, Column, Column, Column]:
    """gap, gap in percent, position and risk of own price against another.

    A null own price is unknown and medium. Risk goes by the rounded percentage: a gap of 0.01 on 500 is low. Against a
    price of 0 the percentage is null, and any gap above 0 is medium.
    """
    gap = own - other
    pct = percent(gap, other)
    position = F.when(own.isNull(), "unknown").when(gap > 0, "above_competitor").when(gap < 0, "below_competitor").otherwise("matched")
    risk = F.when(own.isNull(), "medium").when(pct >= F.lit(str(threshold)).cast("decimal(10,2)"), "high").when(F.coalesce(pct > 0, gap > 0), "medium").otherwise("low")
    return gap.cast("decimal(18,2)"), pct, position, risk


def gaps(watch: DataFrame, own: DataFrame, listings: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Each watched listing against the merchant's own price. The own products join by id; listings by id pair."""
    j = watch.join(listings, ["product_id", "seller_id"]).join(own.select("product_id", "selling_price"), "product_id")
    gap, pct, position, risk = level(F.col("selling_price"), F.col("current_price"), threshold)
    note = F.array_join(F.array_compact(F.array(F.when(risk == "high", "above threshold"), F.when((risk == "medium") & F.col("selling_price").isNotNull(), "above competitor"), F.when(~F.col("is_available"), "unavailable"))), "; ")
    return j.select("org_id", "product_id", "seller_id", gap.alias("gap"), pct.alias("gap_pct"), position.alias("position"), risk.alias("risk"), note.alias("reasons"), F.col("is_available"))


def market_share(watch: DataFrame, own: DataFrame, listings: DataFrame) -> DataFrame:
    """Basis points of each product that an organisation watches, under shares in inverse proportion to price among the
    listings that it watches: own weight / all weights, in decimals (weights to 19 digits, their quotient to 16), rounded half
    up, also where a share lies half between two basis points; null without an own price above 0.

    Listings without a price above 0 have no weight; those that nobody of the organisation watches don't count.
    """
    weight = lambda c: F.when(F.col(c) > 0, F.lit(1).cast("decimal(1,0)") / F.col(c).cast("decimal(18,2)"))
    seen = watch.join(listings.select("product_id", "seller_id", weight("current_price").alias("w")), ["product_id", "seller_id"])
    g = seen.groupBy("org_id", "product_id").agg(F.sum("w").alias("others"))
    j = g.join(own.select("product_id", weight("selling_price").alias("mine")), "product_id")
    share = half_up(F.col("mine") / (F.col("mine") + F.coalesce("others", F.lit(0))) * 100)
    return j.select("org_id", "product_id", (share * 100).cast("long").alias("share_bp"))


def summary(found: DataFrame, shares: DataFrame) -> DataFrame:
    """Of each organisation: tracked competitors and products, products at risk, average gap, and the average share (in
    basis points, rounded half up) of its products that have one; each product counts once."""
    per = found.groupBy("org_id", "product_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("risk") == "high").alias("high"), F.sum("gap").alias("gap"), F.count("gap").alias("gaps"))
    g = per.join(shares, ["org_id", "product_id"], "left").groupBy("org_id").agg(F.sum("n").alias("tracked"), F.count(F.lit(1)).alias("products"), F.count_if("high").alias("at_risk"), average(F.sum("gap"), F.sum("gaps")).alias("average_gap"), F.sum("share_bp").alias("s"), F.count("share_bp").alias("c"))
    return g.select("org_id", "tracked", "products", "at_risk", "average_gap", (average(F.col("s") / F.lit(100).cast("decimal(5,2)"), F.col("c")) * 100).cast("long").alias("average_share_bp"))


def scenarios(priced: DataFrame, changes: tuple[int, ...] = (-5, 0, 5)) -> DataFrame:
    """Price scenarios of each row of priced: columns product_id, current, cost, competitor, units, sensitivity (decimals).

    Rows whose cost is three times the price or more, and rows without a positive competitor price, give none.
    """
    x = priced.filter((F.col("cost") < F.col("current") * 3) & (F.col("competitor") > 0)).withColumn("change", F.explode(F.array(*(F.lit(c) for c in changes))))
    d = lambda c: c.cast("decimal(18,2)")
    x = x.withColumn("proposed", half_up(F.col("current") * (100 + F.col("change")) / 100))
    x = x.withColumn("sold", d(F.greatest(F.lit(0), half_up(F.col("units") * (100 - F.col("change") * F.col("sensitivity")) / 100))))
    x = x.withColumn("revenue", half_up(F.col("proposed") * F.col("sold"))).withColumn("profit", half_up((F.col("proposed") - F.col("cost")) * F.col("sold")))
    x = x.withColumn("margin_pct", F.when(F.col("proposed") > 0, percent(F.col("proposed") - F.col("cost"), F.col("proposed"))).otherwise(d(F.lit(0))))
    x = x.withColumn("gap_pct", percent(F.col("proposed") - F.col("competitor"), F.col("competitor")))
    high = (F.col("proposed") <= F.col("cost")) | (F.col("gap_pct") > 10) | (F.col("margin_pct") < 10)
    medium = (F.col("gap_pct") > 5) | (F.col("margin_pct") < 20)
    return x.withColumn("risk", F.when(high, "high").when(medium, "medium").otherwise("low")).select("product_id", "change", "proposed", "sold", "revenue", "profit", "margin_pct", "gap_pct", "risk")


def recommend(found: DataFrame) -> DataFrame:
    """The scenario of the highest profit among those without a loss or high risk, else among all; the lower change wins ties."""
    viable = (F.col("profit") >= 0) & (F.col("risk") != "high")
    best = F.max(F.struct(viable.alias("v"), "profit", (-F.col("change")).alias("c"), "proposed")).alias("b")
    g = found.groupBy("product_id").agg(best)
    return g.select("product_id", (-F.col("b.c")).alias("change"), F.col("b.proposed").alias("proposed"), F.col("b.profit").alias("profit"))
