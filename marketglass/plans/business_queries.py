"""Queries on sales, imports, competitors and pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, competitors, sales
from ..sources import tables as t
from .registry import cents, d2, dec, half_even, half_up, pct, query

SUMS = f"{d2('coalesce(sum(revenue), 0)')} as revenue, cast(coalesce(sum(quantity), 0) as bigint) as units, count(*) as records"
ASP = f"coalesce({dec(half_even('sum(cast(revenue * 100 as bigint))', 'sum(quantity)'))}, 0.00) as asp"


def _year(spark, d):
    return t.sales(spark, d).filter("sale_date >= '1996-01-01' and sale_date <= '1996-12-31'")


@query(f"select {SUMS}, count(distinct product_id) as products, {ASP} from sales where sale_date between date '1996-01-01' and date '1996-12-31'")
def sales_summary(spark, d):
    return sales.summary(_year(spark, d))


@query(f"select sale_date, {SUMS} from sales group by 1")
def sales_trend(spark, d):
    return sales.trend(t.sales(spark, d))


@query(f"select product_id, {SUMS}, {ASP} from sales group by 1")
def sales_products(spark, d):
    return sales.by_product(t.sales(spark, d))


@query(f"""select product_id, {d2('revenue')} as revenue, {dec(half_up('cast(revenue * 100 as hugeint) * 10000', '(select sum(cast(revenue * 100 as bigint)) from sales)'))} as share_pct, cast(row_number() over (order by revenue desc, units desc, product_id) as integer) as rank
from (select product_id, sum(revenue) as revenue, sum(quantity) as units from sales group by 1)""")
def sales_product_share_rank(spark, d):
    s = t.sales(spark, d)
    return sales.share_and_rank(sales.by_product(s), s)


@query(f"select import_id, source_row, product_id, sale_date, quantity, {d2('revenue')} as revenue from sales where org_id = 7 order by sale_date desc, import_id, source_row, product_id limit 50")
def sales_records_page(spark, d):
    s = t.sales(spark, d).filter("org_id = 7").orderBy(F.col("sale_date").desc(), "import_id", "source_row", "product_id").limit(50)
    return s.withColumn("revenue", F.col("revenue").cast("decimal(18,2)")).drop("org_id")


def _raw_import(spark, d):
    """Import rows as text, some of them spoilt."""
    li = t.parquet(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        k.alias("import_id"), n.alias("row"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" p-"), F.col("l_partkey").cast("string"))).alias("sku"),
        F.when(k % 7 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("sale_date"),
        F.when(n % 5 == 0, "1.5").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"), F.when(k % 11 == 0, "12.345").otherwise(F.col("l_extendedprice").cast("decimal(14,2)").cast("string")).alias("unit_price"),
        F.when(k % 17 == 0, "usd").when(k % 2 == 0, "pkr").otherwise("").alias("currency"),
    )


ERRORS = """, v as (select l_orderkey as import_id, l_linenumber as row, concat_ws(',', case when l_orderkey % 13 = 0 then 'sku' end, case when l_orderkey % 7 = 0 then 'sale_date' end, case when l_linenumber % 5 = 0 then 'quantity' end, case when l_orderkey % 11 = 0 then 'unit_price' end, case when l_orderkey % 17 = 0 then 'currency' end) as errors, l_partkey from lineitem)
"""


@query(ERRORS + "select import_id, row, errors, count(*) as n from v group by all")
def sales_csv_validation(spark, d):
    return sales.validate(_raw_import(spark, d)).groupBy("import_id", "row", "errors").agg(F.count(F.lit(1)).alias("n"))


@query(ERRORS + "select import_id, count(*) filter (errors = '') as accepted, count(*) filter (errors <> '') as rejected, case when count(*) filter (errors = '') = 0 then 'failed' when count(*) filter (errors <> '') > 0 then 'completed_with_errors' else 'completed' end as status from v group by 1")
def import_totals(spark, d):
    return sales.import_totals(sales.validate(_raw_import(spark, d)), "import_id")


@query(ERRORS + """, x as (select import_id, count(*) filter (errors = '') as a, count(*) filter (errors <> '') as r from v group by 1)
select count(*) filter (a > 0 and r = 0) as completed, count(*) filter (a > 0 and r > 0) as with_errors, cast(sum(a) as bigint) as accepted_rows from x""")
def import_kpis(spark, d):
    x = sales.import_totals(sales.validate(_raw_import(spark, d)), "import_id")
    return x.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "completed_with_errors").alias("with_errors"), F.sum("accepted").alias("accepted_rows"))


@query("select count(*) as products, count(*) filter (stock % 3 <> 0) as active, count(*) filter (stock <= reorder_level) as low_stock, sum(stock) as stock from own")
def stock_kpis(spark, d):
    return t.own_products(spark, d).agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("stock") % 3 != 0).alias("active"), F.count_if(F.col("stock") <= F.col("reorder_level")).alias("low_stock"), F.sum("stock").alias("stock"))


@query("select w.org_id, count(*) as entries, count(*) filter (w.product_id % 4 <> 0) as active, count(distinct w.product_id) as products, count(*) filter (l.is_available) as available from watch w join listings l on w.product_id = l.product_id and w.seller_id = l.seller_id group by 1")
def watch_kpis(spark, d):
    j = t.watchlist(spark, d).join(t.listings(spark, d), ["product_id", "seller_id"])
    return j.groupBy("org_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("product_id") % 4 != 0).alias("active"), F.countDistinct("product_id").alias("products"), F.count_if("is_available").alias("available"))


@query("""select count(*) filter (is_active) as active, count(*) filter (not is_active) as paused, count(distinct product_id) as products, (select count(distinct a.alert_id) from alerts a join points p on a.product_id = p.product_id and (a.on_product or a.seller_id = p.seller_id)
  where a.is_active and p.price <= a.target_price) as triggered, (select count(*) from events where event_type = 'error') as notifications from alerts""")
def alert_kpis(spark, d):
    a = t.alerts(spark, d)
    own = a.agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("paused"), F.countDistinct("product_id").alias("products"))
    fired = alerts.first_triggers(a, t.points(spark, d)).agg(F.count(F.lit(1)).alias("triggered"))
    told = t.parquet(spark, d, "events").filter("event_type = 'error'").agg(F.count(F.lit(1)).alias("notifications"))
    return own.crossJoin(fired).crossJoin(told)  # single rows


@query(f"select w.org_id, w.product_id, {d2('min(l.current_price)')} as lowest from watch w join listings l on w.product_id = l.product_id and w.seller_id = l.seller_id where l.is_available group by all")
def lowest_competitor(spark, d):
    j = t.watchlist(spark, d).join(t.listings(spark, d).filter("is_available"), ["product_id", "seller_id"])
    return j.groupBy("org_id", "product_id").agg(F.min("current_price").cast("decimal(18,2)").alias("lowest"))


GAPS = f""", g0 as (select w.org_id, w.product_id, w.seller_id, o.selling_price - l.current_price as g, l.current_price as c, l.is_available from watch w join listings l on w.product_id = l.product_id and w.seller_id = l.seller_id join own o on w.product_id = o.product_id),
g1 as (select *, {pct('g', 'c')} as gap_pct from g0),
gaps as (select org_id, product_id, seller_id, {d2('g')} as gap, gap_pct, case when g > 0 then 'above_competitor' when g < 0 then 'below_competitor' else 'matched' end as position, case when gap_pct >= 5 then 'high' when coalesce(gap_pct > 0, g > 0) then 'medium' else 'low' end as risk, is_available from g1)
"""


def _gaps(spark, d):
    return competitors.gaps(t.watchlist(spark, d), t.own_products(spark, d), t.listings(spark, d))


@query(GAPS + "select *, concat_ws('; ', case when risk = 'high' then 'above threshold' end, case when risk = 'medium' then 'above competitor' end, case when not is_available then 'unavailable' end) as reasons from gaps")
def competitor_gaps(spark, d):
    return _gaps(spark, d)


#: Inverse prices in 10^-19, rounded half up, of the listings that the organisation watches, and the product's share in basis points:
#: the quotient to 16 digits, percent to 12 and then to 2, each half up, as the decimals of the query. One rounding of the
#: quotient of rounded inverses would put shares that lie half between two basis points on either side.
SHARES = f"""select org_id, product_id, {half_up("pct12", "10000000000::hugeint")} as share_bp from (select *, {half_up("q16", "100::hugeint")}::hugeint as pct12 from (select x.org_id, x.product_id, {half_up("mine * 10000000000000000::hugeint", "mine + others")}::hugeint as q16 from (
  select w.org_id, w.product_id, case when any_value(o.selling_price) > 0 then {half_up("1000000000000000000000::hugeint", cents("any_value(o.selling_price)"))}::hugeint end as mine,
    coalesce(sum(case when l.current_price > 0 then {half_up("1000000000000000000000::hugeint", cents("l.current_price"))}::hugeint end), 0)::hugeint as others
  from watch w join listings l on w.product_id = l.product_id and w.seller_id = l.seller_id join own o on w.product_id = o.product_id group by all) x) y) z""".replace("as bigint) end)::hugeint", "as hugeint) end)::hugeint")


@query(GAPS + f"""select org_id, count(*) as tracked, count(distinct product_id) as products, count(distinct case when risk = 'high' then product_id end) as at_risk, {dec(half_up('sum(cast(gap * 100 as bigint))', 'count(gap)'))} as average_gap,
  {half_up('sum(distinct_share)', 'count(distinct_share)')} as average_share_bp
from (select gaps.*, case when row_number() over (partition by gaps.org_id, gaps.product_id order by seller_id) = 1 then share_bp end as distinct_share from gaps left join (""" + SHARES + """) sh on gaps.product_id = sh.product_id and gaps.org_id = sh.org_id) group by 1""")
def competitor_summary(spark, d):
    return competitors.summary(_gaps(spark, d), competitors.market_share(t.watchlist(spark, d), t.own_products(spark, d), t.listings(spark, d)))


@query(SHARES)
def competitor_market_share(spark, d):
    return competitors.market_share(t.watchlist(spark, d), t.own_products(spark, d), t.listings(spark, d))


@query(f"select w.org_id, w.product_id, w.seller_id, o.name, s.seller_name, s.platform, {d2('l.current_price')} as current_price from watch w join own o on w.product_id = o.product_id join listings l on w.product_id = l.product_id and w.seller_id = l.seller_id left join sellers s on w.seller_id = s.seller_id where w.org_id in (1, 7, 42)")
def competitor_rows(spark, d):
    w = t.watchlist(spark, d).filter(F.col("org_id").isin(1, 7, 42))
    j = w.join(t.own_products(spark, d).select("product_id", "name"), "product_id").join(t.listings(spark, d), ["product_id", "seller_id"]).join(t.sellers(spark, d), "seller_id", "left")
    return j.select("org_id", "product_id", "seller_id", "name", "seller_name", "platform", F.col("current_price").cast("decimal(18,2)").alias("current_price"))


@query("select l.product_id, l.seller_id from listings l where not exists (select 1 from watch w where w.org_id % 100 = 0 and w.product_id = l.product_id and w.seller_id = l.seller_id)")
def unwatched_listings(spark, d):
    w = t.watchlist(spark, d).filter("org_id % 100 = 0").select("product_id", "seller_id")
    return t.listings(spark, d).select("product_id", "seller_id").join(w, ["product_id", "seller_id"], "left_anti")


@query(GAPS + "select product_id, count(*) as watchers from gaps where risk = 'high' group by 1")
def risk_targets(spark, d):
    return _gaps(spark, d).filter("risk = 'high'").groupBy("product_id").agg(F.count(F.lit(1)).alias("watchers"))


PRICED = f""", lows as (select product_id, min(current_price) as low, sum(1) as n from listings group by 1),
priced as (select o.product_id, {cents('selling_price')} as cur, {cents('cost_price')} as cost, {cents('low')} as comp, 100 + o.product_id % 50 as units, 15 as sens from own o join lows l on o.product_id = l.product_id),
s0 as (select *, unnest([-5, 0, 5]) as change from priced where cost < cur * 3 and comp > 0),
s1 as (select *, {half_up('cur * (100 + change)', '100')} as p, {half_up('units * (1000 - change * sens) * 100', '1000')} as u from s0),
s2 as (select *, {half_up('cast(p as hugeint) * u', '100')} as rev, {half_up('cast(p - cost as hugeint) * u', '100')} as prof, {half_up('(p - cost) * 10000', 'p')} as margin, {half_up('(p - comp) * 10000', 'comp')} as gap from s1),
sc as (select *, case when p <= cost or gap > 1000 or margin < 1000 then 'high' when gap > 500 or margin < 2000 then 'medium' else 'low' end as risk from s2)
"""


def _priced(spark, d):
    low = t.listings(spark, d).groupBy("product_id").agg(F.min("current_price").alias("competitor"))
    o = t.own_products(spark, d)
    return o.join(low, "product_id").select("product_id", F.col("selling_price").alias("current"), F.col("cost_price").alias("cost"), "competitor", (100 + F.col("product_id") % 50).cast("decimal(10,2)").alias("units"), F.lit("1.5").cast("decimal(4,1)").alias("sensitivity"))


@query(PRICED + f"select product_id, change, {dec('p')} as proposed, {dec('u')} as sold, {dec('rev')} as revenue, {dec('prof')} as profit, {dec('margin')} as margin_pct, {dec('gap')} as gap_pct, risk from sc")
def pricing_scenarios(spark, d):
    return competitors.scenarios(_priced(spark, d))


@query(PRICED + f"select product_id, change, {dec('p')} as proposed, {dec('prof')} as profit from (select *, row_number() over (partition by product_id order by (prof >= 0 and risk <> 'high') desc, prof desc, change) as r from sc) where r = 1")
def pricing_recommendation(spark, d):
    return competitors.recommend(competitors.scenarios(_priced(spark, d)))


@query(f"select o.product_id, {d2('coalesce(nullif(l.low, 0), o.selling_price)')} as competitor, greatest(0, o.stock - 20) as units from own o left join (select product_id, min(current_price) as low from listings where is_available group by 1) l on o.product_id = l.product_id")
def pricing_inputs(spark, d):
    low = t.listings(spark, d).filter("is_available").groupBy("product_id").agg(F.min("current_price").alias("low"))
    j = t.own_products(spark, d).join(low, "product_id", "left")
    return j.select("product_id", F.coalesce(F.when(F.col("low") != 0, F.col("low")), "selling_price").cast("decimal(18,2)").alias("competitor"), F.greatest(F.lit(0), F.col("stock") - 20).alias("units"))
