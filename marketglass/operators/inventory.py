"""Inventory: stock ledgers replayed from deliveries and sales, and reorder points from the demand of a lead time.

Movements are summed by product and day first, so a product's ledger has at most one row a day, however much it sells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ledger(opening: DataFrame, deliveries: DataFrame, sales: DataFrame) -> DataFrame:
    """product_id, day, delivered, demanded, balance, lost of every day with a movement.

    opening: product_id, stock. deliveries and sales: product_id, day, quantity. On a day deliveries come before sales;
    what exceeds the stock isn't sold, so the balance never falls below 0: it is the running sum less its lowest value
    below 0 so far, and no loop is needed. Products without opening stock begin with 0; a null quantity counts as 0.
    """
    q = F.coalesce(F.col("quantity"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    moves = deliveries.select("product_id", "day", q.alias("delivered"), zero.alias("demanded")).unionByName(sales.select("product_id", "day", zero.alias("delivered"), q.alias("demanded")))
    days = moves.groupBy("product_id", "day").agg(F.sum("delivered").alias("delivered"), F.sum("demanded").alias("demanded"))
    w = Window.partitionBy("product_id").orderBy("day")
    days = days.join(opening.select("product_id", F.col("stock").cast("long").alias("stock")), "product_id", "left")
    run = F.coalesce("stock", zero) + F.sum(F.col("delivered") - F.col("demanded")).over(w)
    days = days.withColumn("run", run).withColumn("short", F.greatest(zero, -F.min("run").over(w)))
    return days.select("product_id", "day", "delivered", "demanded", (F.col("run") + F.col("short")).alias("balance"), (F.col("short") - F.coalesce(F.lag("short").over(w), zero)).alias("lost"))


def lead_time_demand(sales: DataFrame, lead_days: int) -> DataFrame:
    """product_id, day, demand: what is sold from each day with a sale on, over lead_days days."""
    q = F.coalesce(F.col("quantity"), F.lit(0)).cast("long")
    days = sales.groupBy("product_id", "day").agg(F.sum(q).alias("sold"))
    number = F.datediff("day", F.lit("1970-01-01"))
    ahead = Window.partitionBy("product_id").orderBy(number).rangeBetween(0, lead_days - 1)
    return days.select("product_id", "day", F.sum("sold").over(ahead).alias("demand"))


def reorder_points(book: DataFrame, sales: DataFrame, lead_days: int = 14, service: float = 0.95) -> DataFrame:
    """product_id, demand_days, reorder_point, balance, lost, order_quantity.

    The reorder point is the smallest lead-time demand that a share `service` of the days with a sale doesn't exceed. A
    product whose last balance is at or below it is to be ordered up to twice that point. lost: units that couldn't be sold.
    """
    d = lead_time_demand(sales, lead_days)
    by = Window.partitionBy("product_id")
    # The place among a product's days, at most one row a day.
    placed = d.withColumns({"n": F.count(F.lit(1)).over(by), "place": F.row_number().over(by.orderBy("demand", "day"))})
    point = placed.filter(F.col("place") == F.ceil(F.col("n") * F.lit(str(service)).cast("decimal(6,4)"))).select("product_id", F.col("n").alias("demand_days"), F.col("demand").alias("reorder_point"))
    last = book.groupBy("product_id").agg(F.max_by("balance", "day").alias("balance"), F.sum("lost").alias("lost"))
    j = last.join(point, "product_id", "left").withColumn("reorder_point", F.coalesce("reorder_point", F.lit(0).cast("long")))
    order = F.when(F.col("balance") <= F.col("reorder_point"), F.greatest(F.lit(0).cast("long"), 2 * F.col("reorder_point") - F.col("balance"))).otherwise(0)
    return j.select("product_id", F.coalesce("demand_days", F.lit(0).cast("long")).alias("demand_days"), "reorder_point", "balance", "lost", order.alias("order_quantity"))
