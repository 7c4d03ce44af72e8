"""Sales: analytics and validated imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import half_even, half_up, parsed_currency, parsed_date, parsed_price, parsed_quantity
from ..functions.text import sku
from ..sources.shared import materialize

COLUMNS = ("sku", "sale_date", "quantity", "unit_price", "currency")


def _asp(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return df.withColumn("asp", F.coalesce(half_even(F.try_divide("revenue", "units")), zero)).withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))


def _sums():
    return [F.coalesce(F.sum("revenue"), F.lit(0).cast("decimal(14,2)")).alias("revenue"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("units"), F.count(F.lit(1)).alias("records")]


def summary(sales: DataFrame) -> DataFrame:
    """Totals over all rows; the average price of a unit is rounded half to even and 0 without units."""
    return _asp(sales.agg(*_sums(), F.countDistinct("product_id").alias("products")))


def trend(sales: DataFrame) -> DataFrame:
    """Totals of each day that has sales."""
    return _asp(sales.groupBy("sale_date").agg(*_sums())).drop("asp")


def by_product(sales: DataFrame) -> DataFrame:
    return _asp(sales.groupBy("product_id").agg(*_sums()))


def share_and_rank(totals: DataFrame, sales: DataFrame) -> DataFrame:
    """by_product with each product's share of all revenue and its place by revenue, units and id.

    The total is one number, joined to every row; places come from a range sort with counts of what lies before.
    """
    whole = sales.agg(F.sum("revenue").alias("whole"))
    ranked = share_rank_order(totals).crossJoin(F.broadcast(whole))
    return ranked.select("product_id", "revenue", half_up(F.try_divide(F.col("revenue") * 100, "whole")).alias("share_pct"), "rank")


def check_headers(headers: list[str]) -> list[str]:
    """Normalised headers of an import. Refuses repeated, missing and unknown ones."""
    names = [h.strip().lower().lstrip("﻿") for h in headers]
    missing, unknown = set(COLUMNS[:4]) - set(names), set(names) - set(COLUMNS)
    repeated = {n for n in names if names.count(n) > 1}
    if missing or unknown or repeated:
        raise ValueError(f"headers: missing {sorted(missing)}, unknown {sorted(unknown)}, repeated {sorted(repeated)}")
    return names


def validate(rows: DataFrame) -> DataFrame:
    """rows (text columns COLUMNS) with parsed values and errors, the failing fields joined by ','; '' if it is valid."""
    values = {"sku": sku(F.col("sku")), "sale_date": parsed_date(F.col("sale_date")), "quantity": parsed_quantity(F.col("quantity")), "unit_price": parsed_price(F.col("unit_price")), "currency": parsed_currency(F.col("currency"))}
    out = rows.withColumns({f"v_{k}": v for k, v in values.items()})
    return out.withColumn("errors", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"v_{k}").isNull(), k) for k in values))), ","))


def import_totals(validated: DataFrame, *key: str) -> DataFrame:
    """Accepted and rejected rows of each import, and its status."""
    g = validated.groupBy(*key).agg(F.count_if(F.col("errors") == "").alias("accepted"), F.count_if(F.col("errors") != "").alias("rejected"))
    return g.withColumn("status", F.when(F.col("accepted") == 0, "failed").when(F.col("rejected") > 0, "completed_with_errors").otherwise("completed"))


#: Most bytes and rows of an import file.
MOST_BYTES, MOST_ROWS = 2 * 1024 * 1024, 5000


def read_csv(spark, path: str) -> DataFrame:
    """An import file as text columns with source_row, which counts from 2 (1 is the header).

    Quoted line breaks are kept; rows without any value are counted but left out. Refuses files of more than MOST_BYTES
    bytes or MOST_ROWS rows, and headers that check_headers refuses. The file is small, so it is read as one partition.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is None or size > MOST_BYTES:
        raise ValueError(f"an import file has at most {MOST_BYTES} bytes")
    df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*check_headers(df.columns))
    df = df if "currency" in df.columns else df.withColumn("currency", F.lit(None).cast("string"))
    df = df.select(*COLUMNS).withColumn("source_row", F.monotonically_increasing_id() + 2)
    df = df.filter(F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in COLUMNS)).isNotNull())
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"an import file has at most {MOST_ROWS} rows")
    return df


def share_rank_order(df: DataFrame) -> DataFrame:
    """df with rank by revenue, units and id, and no window over all rows.

    Rows are range-sorted over partitions and written once with the partition's number, as bounds are drawn anew each time
    the exchange is planned. Counts by partition (one small row each) then give each partition's first rank.
    """
    keys = [F.col("revenue").desc(), F.col("units").desc(), F.col("product_id").asc()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn("rank", (F.col("_own") + F.col("_before")).cast("int")).drop("_p", "_own", "_before")
