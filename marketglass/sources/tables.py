"""Tables of the engine: readers, and the adapters that give the engine's tables from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.merge import split_quarantine

MONEY = T.DecimalType(14, 2)

#: Normalised listing capture, as sent by collectors.
CAPTURE = T.StructType([
    T.StructField("platform", T.StringType()), T.StructField("external_id", T.StringType()), T.StructField("product_id", T.LongType()),
    T.StructField("seller_name", T.StringType()), T.StructField("price", MONEY), T.StructField("currency", T.StringType()),
    T.StructField("is_available", T.BooleanType()), T.StructField("scraped_at", T.TimestampType()),
])

#: Search page of a marketplace's JSON interface.
MARKET_PAGE = "struct<mods:struct<listItems:array<struct<itemId:string,name:string,price:string,itemUrl:string,sellerName:string,inStock:boolean>>>,mainInfo:struct<totalResults:int,pageSize:int>>"


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in parallel by ranges of a numeric column; filters and columns are pushed to the database."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def captures_json(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captures of JSON files, in batch or as a stream; a record that doesn't fit is all null."""
    return (spark.readStream if stream else spark.read).schema(CAPTURE).json(path)


#: A capture as it is sent: texts, so that what doesn't fit can be told from what is missing.
SENT = "capture_id long, platform string, title string, price string, currency string, scraped_at string"


def sent_price() -> Column:
    return F.col("price").try_cast("decimal(20,6)")


def sent_time() -> Column:
    return F.try_to_timestamp("scraped_at")


def capture_rules(price: Column | None = None, at: Column | None = None) -> dict[str, Column]:
    """The contract of a sent capture (columns SENT): names, a price above 0 with at most two digits behind the point, the
    currency served, and a time with its offset. price, at: columns that hold sent_price and sent_time already."""
    price, at = sent_price() if price is None else price, sent_time() if at is None else at
    return {
        "platform": F.trim("platform") != "", "title": F.length(F.trim("title")).between(1, 500), "price": (price > 0) & (price == F.round(price, 2)), "currency": F.upper(F.trim("currency")) == "PKR",
        "offset": F.col("scraped_at").endswith("Z") | F.col("scraped_at").rlike(r"[+-]\d{2}:?\d{2}$"), "time": at.isNotNull(),
    }


def sent_captures(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Captures of JSON files that keep the contract, and those in quarantine with the rules they break; in batch or as streams."""
    raw = (spark.readStream if stream else spark.read).schema(SENT).json(path)
    return split_quarantine(raw, capture_rules())


#: A forecast as it is handed over; its points in the order sent.
FORECAST = "variant_id long, generated_at timestamp, horizon int, points array<struct<at:timestamp,price:decimal(14,2)>>"


def forecast_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORECAST).option("multiLine", True).json(path)


def feed_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A feed file: one JSON array of items."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def market_items(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items of marketplace search pages, one row an item; pages that aren't JSON give none. Adds pages, the number of pages to read."""
    page = F.from_json(body, MARKET_PAGE)
    info = F.col("_page.mainInfo")
    rows = bodies.withColumn("_page", page).withColumn("pages", F.expr("try_divide(_page.mainInfo.totalResults, _page.mainInfo.pageSize)").cast("int") + 1)
    return rows.select(info.isNotNull().alias("has_info"), "pages", F.explode("_page.mods.listItems").alias("i")).select("pages", "i.*")


def products(spark: SparkSession, d: str) -> DataFrame:
    p = parquet(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), (F.col("p_size") % 10 != 0).alias("is_active"), money("p_retailprice").alias("ref_price"), F.col("p_size").alias("storage_gb"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Price captures; (captured_at, ord, line, price) orders those of a listing totally."""
    return as_points(parquet(spark, d, "lineitem"))


def as_points(p: DataFrame) -> DataFrame:
    """Order lines, in batch or as a stream, as price captures."""
    return p.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("captured_at"), money("l_extendedprice").alias("price"), (F.col("l_returnflag") != "R").alias("is_available"))


def sellers(spark: SparkSession, d: str) -> DataFrame:
    """Sellers with country, platform (region) and rating in tenths. Nations and regions are small by nature."""
    s, n, r = (parquet(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"), F.col("n_name").alias("country"), F.col("r_name").alias("platform"), (10 + F.col("s_suppkey") % 41).alias("rating"))


def latest(captures: DataFrame, *key: str) -> DataFrame:
    """Snapshot of each listing: its last capture's price and availability, first and last capture time.

    One grouping with partial aggregation; no sort of a listing's history.
    """
    last = F.max(F.struct("captured_at", "ord", "line", "price", "is_available"))
    g = captures.groupBy(*key).agg(last.alias("x"), F.min("captured_at").alias("first_seen_at"))
    return g.select(*key, F.col("x.price").alias("current_price"), F.col("x.is_available").alias("is_available"), "first_seen_at", F.col("x.captured_at").alias("last_seen_at"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    return latest(points(spark, d), "product_id", "seller_id")


def sales(spark: SparkSession, d: str) -> DataFrame:
    o, li = parquet(spark, d, "orders"), parquet(spark, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("org_id"), F.col("o_orderkey").alias("import_id"), F.col("l_linenumber").alias("source_row"), F.col("l_partkey").alias("product_id"), F.to_date("l_shipdate").alias("sale_date"), F.col("l_quantity").cast("int").alias("quantity"), money("l_extendedprice").alias("revenue"))


def own_products(spark: SparkSession, d: str) -> DataFrame:
    """A merchant's products with selling and cost price and stock."""
    p = parquet(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), money(F.col("p_retailprice") * 38).alias("selling_price"), money(F.col("p_retailprice") * 30).alias("cost_price"), F.col("p_size").alias("stock"), F.lit(20).alias("reorder_level"))


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    o, li = parquet(spark, d, "orders"), parquet(spark, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("o_custkey").alias("org_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id")).distinct()


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Price alerts: even ids watch a product, odd ids the listing of the smallest seller of the product."""
    c = parquet(spark, d, "customer")
    first = points(spark, d).groupBy("product_id").agg(F.min("seller_id").alias("least_seller"))
    even = F.col("c_custkey") % 2 == 0
    j = c.join(first, c.c_custkey == first.product_id, "left")
    return j.select(F.col("c_custkey").alias("alert_id"), F.col("c_custkey").alias("product_id"), F.when(~even, F.col("least_seller")).alias("seller_id"), even.alias("on_product"), money(F.col("c_acctbal") * 2).alias("target_price"), (F.col("c_acctbal") > 0).alias("is_active"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("variant_id"), F.col("o_orderkey").alias("forecast_id"), F.col("o_orderdate").alias("generated_at"), money("o_totalprice").alias("predicted_price"))


#: The same adapters as DuckDB SQL.
SQL = """with products as (
  select p_partkey as product_id, p_name as name, p_brand as brand, p_type as category, p_size % 10 <> 0 as is_active, cast(p_retailprice as decimal(14,2)) as ref_price, p_size as storage_gb from part),
points as (
  select l_partkey as product_id, l_suppkey as seller_id, l_orderkey as ord, l_linenumber as line, l_shipdate as captured_at, cast(l_extendedprice as decimal(14,2)) as price, l_returnflag <> 'R' as is_available from lineitem),
sellers as (
  select s_suppkey as seller_id, s_name as seller_name, n_name as country, r_name as platform, 10 + s_suppkey % 41 as rating
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
listings as (
  select product_id, seller_id, price as current_price, is_available, first_seen_at, captured_at as last_seen_at from (
    select *, min(captured_at) over (partition by product_id, seller_id) as first_seen_at,
      row_number() over (partition by product_id, seller_id order by captured_at desc, ord desc, line desc, price desc) as rn from points) where rn = 1),
sales as (
  select o_custkey as org_id, o_orderkey as import_id, l_linenumber as source_row, l_partkey as product_id, cast(l_shipdate as date) as sale_date, cast(l_quantity as integer) as quantity, cast(l_extendedprice as decimal(14,2)) as revenue
  from lineitem join orders on l_orderkey = o_orderkey),
own as (
  select p_partkey as product_id, p_name as name, cast(p_retailprice * 38 as decimal(14,2)) as selling_price, cast(p_retailprice * 30 as decimal(14,2)) as cost_price, p_size as stock, 20 as reorder_level from part),
watch as (
  select distinct o_custkey as org_id, l_partkey as product_id, l_suppkey as seller_id from lineitem join orders on l_orderkey = o_orderkey),
alerts as (
  select c_custkey as alert_id, c_custkey as product_id, case when c_custkey % 2 <> 0 then s end as seller_id, c_custkey % 2 = 0 as on_product, cast(c_acctbal * 2 as decimal(14,2)) as target_price, c_acctbal > 0 as is_active
  from customer left join (select l_partkey as k, min(l_suppkey) as s from lineitem group by 1) on c_custkey = k),
forecasts as (
  select o_custkey as variant_id, o_orderkey as forecast_id, o_orderdate as generated_at, cast(o_totalprice as decimal(14,2)) as predicted_price from orders)
"""
