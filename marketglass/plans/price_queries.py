"""Queries on prices, guidance, forecasts and captures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import alerts, prices
from ..sources import tables as t
from .registry import cents, d2, dec, half_up, pct, query

ORDER = "captured_at, ord, line, price"
FIRST = f"""f as (select * from (select *, row_number() over (partition by product_id, seller_id order by {ORDER}) as rn from points) where rn = 1)"""
AVG = half_up("sum(cast(price * 100 as bigint))", "count(*)")

SUMMARY = f""", {FIRST}, g as (
  select product_id, seller_id, count(*) as n_points, min(price) as lowest, max(price) as highest, {AVG} as avg_c, min(captured_at) as a, max(captured_at) as b from points {{where}} group by all)
select l.product_id, l.seller_id, {d2('l.current_price')} as current_price, g.n_points, {d2('lowest')} as lowest, {d2('highest')} as highest, {dec('avg_c')} as average,
  {d2('l.current_price - f.price')} as change, case when f.price > 0 then {pct('l.current_price - f.price', 'f.price')} end as change_pct, cast(a as date) as first_day, cast(b as date) as last_day
from listings l join g on l.product_id = g.product_id and l.seller_id = g.seller_id join f on l.product_id = f.product_id and l.seller_id = f.seller_id"""


@query(SUMMARY.format(where=""))
def price_summary(spark, d):
    return prices.summary(t.points(spark, d), t.listings(spark, d), "product_id", "seller_id")


@query(f""", p as (select * from points where captured_at between timestamp '1996-01-01' and timestamp '1997-12-31')
select product_id, seller_id, count(*) as n_points, {d2('min(price)')} as lowest, {d2('max(price)')} as highest, {dec(AVG)} as average from p group by all""")
def price_summary_range(spark, d):
    p = prices.between(t.points(spark, d), "1996-01-01", "1997-12-31")
    return prices.summary(p, t.latest(p, "product_id", "seller_id"), "product_id", "seller_id").select("product_id", "seller_id", "n_points", "lowest", "highest", "average")


@query(f""", {FIRST}, e as (select * from (select *, row_number() over (partition by product_id, seller_id order by captured_at desc, ord desc, line desc, price desc) as rn from points) where rn = 1),
g as (select product_id, seller_id, min(price) as lowest, max(price) as highest, {AVG} as avg_c from points group by all)
select g.product_id, g.seller_id, {d2('e.price')} as current, {d2('lowest')} as lowest, {d2('highest')} as highest, {dec('avg_c')} as average, {d2('e.price - f.price')} as change, case when f.price > 0 then {pct('e.price - f.price', 'f.price')} else 0.00 end as change_pct
from g join e on g.product_id = e.product_id and g.seller_id = e.seller_id join f on g.product_id = f.product_id and g.seller_id = f.seller_id""")
def price_panel_stats(spark, d):
    return prices.point_statistics(t.points(spark, d), "product_id", "seller_id")


@query(f"select product_id, {d2('min(price)')} as lowest, {d2('max(price)')} as highest, {dec(AVG)} as average from points group by product_id")
def product_history_stats(spark, d):
    return prices.point_statistics(t.points(spark, d), "product_id").select("product_id", "lowest", "highest", "average")


@query("select product_id, count(distinct seller_id) as total_listings, count(*) as total_points from points group by product_id")
def product_history_totals(spark, d):
    g = t.points(spark, d).groupBy("product_id", "seller_id").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("product_id").agg(F.count(F.lit(1)).alias("total_listings"), F.sum("n").alias("total_points"))


@query(f"select product_id, seller_id, cast(row_number() over (partition by product_id, seller_id order by {ORDER}) as integer) as position, cast(captured_at as date) as day, {d2('price')} as price from points")
def history_nested_flat(spark, d):
    w = Window.partitionBy("product_id", "seller_id").orderBy(*prices.ORDER)
    return t.points(spark, d).select("product_id", "seller_id", F.row_number().over(w).alias("position"), F.to_date("captured_at").alias("day"), F.col("price").cast("decimal(18,2)").alias("price"))


GUIDE = f""", part_listings as (select product_id, min(price) as current_lowest from (
    select *, row_number() over (partition by product_id order by captured_at desc, ord desc, line desc, price desc) as rn from points) where rn = 1 group by 1),
h as (select product_id, count(*) as n, min(price) as low, {AVG} as mean_c, cast(floor(epoch_us(max(captured_at)) / 86400000000 - epoch_us(min(captured_at)) / 86400000000) as bigint) + 1 as days from points where is_available group by 1),
gd as (select l.product_id,
  case when coalesce(n, 0) = 0 then 'insufficient_data' when current_lowest * 100 <= low * 102 then 'buy_now' when n >= 5 and {cents('current_lowest')} * 100 > mean_c * 103 then 'wait' else 'price_stable' end as suggestion,
  case when n >= 20 and days >= 30 then 'high' when n >= 5 and days >= 7 then 'medium' else 'low' end as confidence,
  {d2('current_lowest')} as current_lowest, {d2('low')} as low, {dec('mean_c')} as mean, coalesce(n, 0) as n_points, case when n > 0 then greatest(1, days) else 0 end as coverage_days
  from part_listings l left join h on l.product_id = h.product_id)
"""


def _guidance(spark, d):
    p = t.points(spark, d)
    return prices.guidance(p, t.latest(p, "product_id"))


@query(GUIDE + "select *, case when confidence = 'low' then 'limited observations or time coverage; ' else '' end || 'a rule over stored history, not a forecast' as limitations from gd")
def buy_guidance(spark, d):
    return prices.reasons(_guidance(spark, d))


#: Product alerts, alerts on the product's smallest seller and, for a third of the products, newer ones on its largest.
MINE = """, mine as (select * from alerts union all
  select alert_id + 1000000, product_id, (select max(seller_id) from points p where p.product_id = alerts.product_id), false, cast(target_price + 20000 as decimal(14,2)), true from alerts where alert_id % 3 = 0)"""


def my_alerts(spark, d):
    a = t.alerts(spark, d)
    last = t.points(spark, d).groupBy("product_id").agg(F.max("seller_id").alias("largest"))
    more = a.filter("alert_id % 3 = 0").join(last, "product_id", "left")
    more = more.select((F.col("alert_id") + 1000000).alias("alert_id"), "product_id", F.col("largest").alias("seller_id"), F.lit(False).alias("on_product"), (F.col("target_price") + 20000).cast("decimal(14,2)").alias("target_price"), F.lit(True).alias("is_active"))
    return a.unionByName(more)


#: The product's alert that counts, the price it is held against, and what follows.
PERSONAL = """, pa as (select m.*, l.current_price as own_price, l.is_available as avail, case when on_product then 2 when l.is_available then 1 else 0 end as prio
    from mine m left join listings l on m.product_id = l.product_id and m.seller_id = l.seller_id where m.is_active),
pb as (select * from (select *, row_number() over (partition by product_id order by prio desc, alert_id desc) as rn from pa) where rn = 1),
pj as (select gd.product_id, alert_id, target_price, case when on_product then current_lowest when avail then own_price end as ev from gd join pb on gd.product_id = pb.product_id),
ps as (select *, case when ev is null then 'insufficient_data' when ev <= target_price then 'buy_now' else 'wait' end as suggestion from pj)"""


@query(GUIDE + MINE + PERSONAL + f"""
select product_id, alert_id, {d2('target_price')} as target_price, {d2('ev')} as evaluated, {d2('case when ev is not null then greatest(0, ev - target_price) end')} as gap, {pct('case when ev is not null then greatest(0, ev - target_price) end', 'target_price')} as gap_pct,
  ev <= target_price as reached, suggestion from ps""")
def personalized_guidance(spark, d):
    return prices.personalise(_guidance(spark, d), my_alerts(spark, d), t.listings(spark, d))


def _comparison_sql(ids: str, currency: str) -> str:
    return f""", x as (select p.product_id, p.name, l.current_price, {currency} as currency, row_number() over (partition by p.product_id order by current_price, l.seller_id) as rn
  from products p join listings l on p.product_id = l.product_id where is_available and p.product_id in ({ids})),
c as (select *, list_position([{ids}], product_id) as place from x where rn = 1)
select first(product_id order by current_price, place) as cheapest_id, first(name order by current_price, place) as cheapest_name, {d2('min(current_price)')} as cheapest_price, min(currency) as currency,
  case when count(*) > 1 then {d2('max(current_price) - min(current_price)')} end as gap, case when count(*) > 1 then {pct('max(current_price) - min(current_price)', 'min(current_price)')} end as gap_pct
from c having count(distinct currency) = 1"""


@query(_comparison_sql("3, 5, 11", "'PKR'"))
def product_comparison(spark, d):
    return prices.compare(t.products(spark, d), t.listings(spark, d), [3, 5, 11])


@query(_comparison_sql("7, 4", "case when l.seller_id % 2 = 0 then 'PKR' else 'USD' end"))
def product_comparison_currencies(spark, d):
    mixed = t.listings(spark, d).withColumn("currency", F.when(F.col("seller_id") % 2 == 0, "PKR").otherwise("USD"))
    return prices.compare(t.products(spark, d), mixed, [7, 4])


LATEST = "(select *, row_number() over (partition by variant_id order by generated_at desc, forecast_id desc) as version from forecasts)"


@query(f"select variant_id, forecast_id, cast(generated_at as date) as generated_on, {d2('predicted_price')} as predicted_price from {LATEST} where version = 1")
def forecast_latest(spark, d):
    return prices.newest_forecast(t.forecasts(spark, d))


@query(f"select variant_id, forecast_id, cast(version as integer) as version, version = 1 as is_active from {LATEST}")
def forecast_versions(spark, d):
    return prices.forecast_versions(t.forecasts(spark, d))


@query(f""", h as (select cast(captured_at as date) as day, {d2('min(price)')} as low from points where is_available group by 1),
p as (select cast(generated_at as date) as day, {d2('min(predicted_price)')} as predicted from forecasts group by 1)
select coalesce(h.day, p.day) as day, low, predicted from h full join p on h.day = p.day""")
def forecast_vs_history_daily(spark, d):
    days = t.forecasts(spark, d).groupBy(F.to_date("generated_at").alias("day")).agg(F.min("predicted_price").cast("decimal(18,2)").alias("predicted"))
    return prices.with_forecast_days(prices.day_low(t.points(spark, d)), days)


@query("""select v as variant_id, array_to_string(list_filter([case when n <> 3 then 'horizon' end, case when days <> list_sort(days) then 'order' end, case when len(list_distinct(days)) <> n then 'repeats' end,
  case when least_day <= timestamp '1994-01-01' then 'future' end], lambda x: x is not null), ',') as broken
  from (select o_custkey as v, count(*) as n, list(o_orderdate order by o_orderkey) as days, min(o_orderdate) as least_day from orders where o_orderkey % 4 = 0 group by 1)""", adapters=False)
def forecast_contract_checks(spark, d):
    # One document a variant: the points of a forecast are as many as its horizon, not a history.
    o = t.forecasts(spark, d).filter("forecast_id % 4 = 0")
    sent = F.transform(F.array_sort(F.collect_list(F.struct("forecast_id", F.col("generated_at").alias("at")))), lambda x: F.struct(x["at"].alias("at")))
    docs = o.groupBy("variant_id").agg(sent.alias("points")).withColumns({"horizon": F.lit(3), "generated_at": F.lit("1994-01-01").cast("timestamp_ntz")})
    return prices.contract_breaches(docs).select("variant_id", F.array_join("broken", ",").alias("broken"))


@query("""select variant_id, forecast_id, case when generated_at <= before then 'rejected' when generated_at < newest then 'superseded' else 'published' end as outcome from (
  select i.*, greatest(h, max(generated_at) over (partition by i.variant_id order by forecast_id rows between unbounded preceding and 1 preceding)) as before,
    max(greatest(h, generated_at)) over (partition by i.variant_id) as newest
  from (select * from forecasts where forecast_id % 2 = 1) i left join (select variant_id, max(generated_at) as h from forecasts where forecast_id % 2 = 0 group by 1) x on i.variant_id = x.variant_id)""")
def forecast_publish(spark, d):
    f = t.forecasts(spark, d)
    return prices.publish(f.filter("forecast_id % 2 = 0"), f.filter("forecast_id % 2 = 1"))


@query(f"select p.product_id, f.forecast_id, cast(f.generated_at as date) as generated_on, {d2('f.predicted_price')} as predicted_price, case when f.forecast_id is null then 'no_forecast' else 'available' end as status from products p left join (select * from {LATEST} where version = 1) f on p.product_id = f.variant_id")
def forecast_or_none(spark, d):
    return prices.forecast_answer(t.products(spark, d), t.forecasts(spark, d))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("select cast(captured_at as date) as day, " + ", ".join(f"cast(min(case when platform = '{r}' then price end) as decimal(18,2)) as p{i}" for i, r in enumerate(REGIONS)) + " from points join sellers on points.seller_id = sellers.seller_id group by 1")
def history_pivot(spark, d):
    j = t.points(spark, d).join(t.sellers(spark, d).select("seller_id", "platform"), "seller_id")
    p = j.groupBy(F.to_date("captured_at").alias("day")).pivot("platform", list(REGIONS)).agg(F.min("price"))
    return p.select("day", *(F.col(f"`{r}`").cast("decimal(18,2)").alias(f"p{i}") for i, r in enumerate(REGIONS)))


@query(f"""select product_id, seller_id, position, cast(captured_at as date) as day, {d2('price')} as price from (
  select *, cast(row_number() over (partition by product_id, seller_id order by {ORDER}) as integer) as position from (
    select *, row_number() over (partition by product_id, seller_id order by captured_at desc, ord desc, line desc, price desc) as r from points) where r <= 30)""")
def competitor_timeline_top30(spark, d):
    return prices.recent(t.points(spark, d), 30, "product_id", "seller_id").select("product_id", "seller_id", "position", F.to_date("captured_at").alias("day"), F.col("price").cast("decimal(18,2)").alias("price"))


@query(f"select product_id, seller_id, {d2('current_price')} as current_price, is_available, cast(first_seen_at as date) as first_seen, cast(last_seen_at as date) as last_seen from listings")
def listing_snapshot_latest(spark, d):
    return t.listings(spark, d).select("product_id", "seller_id", F.col("current_price").cast("decimal(18,2)").alias("current_price"), "is_available", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"))


@query(f"""select l_orderkey as ord, l_linenumber as line, l_partkey as product_id, case when o > c then (2 * (o - c) * 100 + o) // (2 * o) else 0 end as discount from (
  select *, cast(round(l_extendedprice * 100) as bigint) as o, cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint) as c from lineitem)""", adapters=False)
def listing_discount(spark, d):
    li = t.parquet(spark, d, "lineitem")
    o, c = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return li.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), prices.discount(o.cast("decimal(18,0)"), c.cast("decimal(18,0)")).alias("discount"))


@query(f""", h as (select a.alert_id, a.target_price, p.* from alerts a join points p on a.product_id = p.product_id and (a.on_product or a.seller_id = p.seller_id) where a.is_active and p.price <= a.target_price),
r as (select *, row_number() over (partition by alert_id order by {ORDER}) as rn, count(*) over (partition by alert_id) as qualifying from h)
select alert_id, cast(captured_at as date) as triggered_on, {d2('price')} as price, qualifying from r where rn = 1""")
def alerts_triggered_once(spark, d):
    return alerts.first_triggers(t.alerts(spark, d), t.points(spark, d))


def _events(spark, d):
    return t.parquet(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


TRIGGER = "select user_id, arg_min(event_id, (ts, event_id)) as event_id, arg_min(value, (ts, event_id)) as value from events where value <= 5 group by 1"


@query(TRIGGER, adapters=False)
def captures_trigger_once(spark, d):
    return alerts.trigger_once(_events(spark, d), 5)


@query("""select event_id, user_id, value from (select *, lag(value >= 80, 1, false) over (partition by user_id order by ts, event_id) as was from events) where value >= 80 and not was""", adapters=False)
def risk_edges(spark, d):
    return alerts.rising_edges(_events(spark, d), 80)


@query("select event_id, user_id, value from (select *, lag(value) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> value", adapters=False)
def price_changes_only(spark, d):
    return prices.changes_only(_events(spark, d)).select("event_id", "user_id", "value")


@query("select user_id, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1", adapters=False)
def capture_dedup(spark, d):
    e = _events(spark, d)
    sent_twice = e.unionByName(e.filter("event_id % 7 = 0"))
    return sent_twice.dropDuplicates(["user_id", "ts"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("select strftime(time_bucket(interval '12 hours', ts), '%Y-%m-%d %H:%M:%S') as bucket, count(*) as n, max(event_id) as last_id from events group by 1", adapters=False)
def captures_12h(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "12 hours")
    g = _events(spark, d).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n", "last_id")


@query("""with e as (select *, case when event_id % 11 = 0 then ts - interval 1 hour else ts end as happened from events)
select user_id, arg_max(event_id, (happened, event_id)) as by_event_time, max(event_id) as by_arrival from e group by 1""", adapters=False)
def late_captures(spark, d):
    e = _events(spark, d).withColumn("happened", F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("interval 1 hour")).otherwise(F.col("ts")))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("happened", "event_id")).alias("by_event_time"), F.max("event_id").alias("by_arrival"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events", adapters=False)
def json_props(spark, d):
    return _events(spark, d).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query(f""", n as (select *, (row_number() over (partition by product_id order by {ORDER}) - 1) // 500 as page from points)
select product_id, page, cast(to_json({{'product_id': product_id, 'page': page, 'points': l}}) as varchar) as document
from (select product_id, page, list({{'day': strftime(captured_at, '%Y-%m-%d'), 'seller_id': seller_id, 'price': cast(cast(price as decimal(18,2)) as varchar)}} order by {ORDER}) as l from n group by product_id, page)""")
def json_document(spark, d):
    """History documents of at most 500 points, so that no product's history is one row."""
    n = F.row_number().over(Window.partitionBy("product_id").orderBy(*prices.ORDER))
    p = t.points(spark, d).withColumn("page", F.floor((n - 1) / 500).cast("long"))
    shown = F.struct(*prices.ORDER, F.struct(F.date_format("captured_at", "yyyy-MM-dd").alias("day"), "seller_id", F.col("price").cast("decimal(18,2)").cast("string").alias("price")).alias("x"))
    g = p.groupBy("product_id", "page").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["x"]).alias("points"))
    return g.select("product_id", "page", F.to_json(F.struct("product_id", "page", "points")).alias("document"))


@query("select page_id, list_extract(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/'), -1) as external_id, case when starts_with(url, '//') then 'https:' || url else url end as url from pages", adapters=False)
def url_external_id(spark, d):
    return t.parquet(spark, d, "pages").select("page_id", text.last_segment(F.col("url")).alias("external_id"), text.absolute_url(F.col("url")).alias("url"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, html like '%In Stock%' as in_stock, coalesce(try_cast(regexp_replace(regexp_extract(html, 'Rs\\.?\\s*([0-9,]+)', 1), '[^0-9.]', '', 'g') as double), 0) as price from pages", adapters=False)
def html_fields(spark, d):
    p = t.parquet(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.contains("html", F.lit("In Stock")).alias("in_stock"), text.price_number(F.regexp_extract("html", r"Rs\.?\s*([0-9,]+)", 1)).alias("price"))


@query("select c_custkey, coalesce(try_cast(regexp_replace('Rs ' || c_acctbal || ' only', '[^0-9.]', '', 'g') as double), 0) as price from customer", adapters=False)
def price_clean(spark, d):
    c = t.parquet(spark, d, "customer")
    return c.select("c_custkey", text.price_number(F.concat(F.lit("Rs "), F.col("c_acctbal").cast("string"), F.lit(" only"))).alias("price"))
