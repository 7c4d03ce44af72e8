"""Queries that run as streams over what is there and return their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts
from ..sources import tables as t
from ..streaming import captures, ingest, rules
from .price_queries import TRIGGER
from .registry import d2, pct, query


@query(TRIGGER, adapters=False)
def stream_alerts(spark, d):
    return captures.run_available(captures.fire_once(captures.read(spark, f"{d}/events.parquet"), 5))


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1", adapters=False)
def stream_snapshot(spark, d):
    return captures.run_available(captures.snapshot(captures.read(spark, f"{d}/events.parquet")), "complete")


@query("select event_id, user_id from events", adapters=False)
def stream_dedup(spark, d):
    return captures.run_available(captures.deduplicated(captures.read(spark, f"{d}/events.parquet"))).select("event_id", "user_id")


EVALUATED = f""", m as (select a.alert_id, a.target_price, p.* from alerts a join points p on a.product_id = p.product_id and (a.on_product or a.seller_id = p.seller_id) where a.is_active and KEPT),
r as (select alert_id, cast(max(captured_at) as date) as last_checked, bool_or(price <= target_price) as is_triggered, first(captured_at order by captured_at, ord, line, price) filter (price <= target_price) as fired_at,
  first(price order by captured_at, ord, line, price) filter (price <= target_price) as price from m group by 1)
select alert_id, last_checked, is_triggered, cast(fired_at as date) as triggered_on, {d2('price')} as price from r"""


@query(EVALUATED.replace("KEPT", "true"))
def alerts_evaluated(spark, d):
    return alerts.evaluated(t.alerts(spark, d), t.points(spark, d))


@query(EVALUATED.replace("KEPT", "true"))
def stream_alert_table(spark, d):
    """A stream of captures joined with the table of alerts."""
    stream = t.as_points(captures.read(spark, f"{d}/lineitem.parquet"))
    return captures.run_available(alerts.evaluated(t.alerts(spark, d), stream), "complete")


@query(EVALUATED.replace("KEPT", "p.seller_id % 3 = 0 and a.product_id % 2 = 0"))
def alerts_by_currency(spark, d):
    """Captures and alerts meet in one currency only."""
    foreign = t.points(spark, d).withColumn("currency", F.when(F.col("seller_id") % 3 == 0, "PKR").otherwise("USD"))
    mine = t.alerts(spark, d).withColumn("currency", F.when(F.col("product_id") % 2 == 0, "PKR").otherwise("EUR"))
    return alerts.evaluated(mine, foreign)


@query(f""", h as (select a.alert_id, p.* from alerts a join points p on a.product_id = p.product_id and (a.on_product or a.seller_id = p.seller_id) where a.is_active and p.is_available and p.price <= a.target_price)
select alert_id, cast(first(captured_at order by captured_at, ord, line, price) as date) as triggered_on, {d2('first(price order by captured_at, ord, line, price)')} as price, count(*) as qualifying from h group by 1""")
def alerts_triggered_available(spark, d):
    return alerts.first_triggers(t.alerts(spark, d), t.points(spark, d), available_only=True)


@query("select user_id, event_id, value from (select *, lag(value >= 80, 1, false) over (partition by user_id order by ts, event_id) as was from events) where value >= 80 and not was", adapters=False)
def stream_risk_edges(spark, d):
    return captures.run_available(captures.rising_edges(captures.read(spark, f"{d}/events.parquet"), 80))


@query("select user_id, event_id, value from (select *, lag(value) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> value", adapters=False)
def stream_price_changes(spark, d):
    return captures.run_available(captures.changes_only(captures.read(spark, f"{d}/events.parquet")))


@query("select 'events' as source, true as ok, (select count(*) from events) as n union all select 'lost', false, null union all select 'orders', true, (select count(*) from orders)", adapters=False)
def stream_isolated(spark, d):
    sources = {name: (lambda name=name: captures.read(spark, f"{d}/{name}.parquet").select(F.lit(1).alias("x"))) for name in ("events", "lost", "orders")}
    done = captures.run_isolated(sources)
    rows = [(k, not isinstance(v, Exception), None if isinstance(v, Exception) else v.count()) for k, v in done.items()]
    return spark.createDataFrame(rows, "source string, ok boolean, n long")


@query("""select c_custkey, array_to_string(list_filter([case when c_custkey % 10 = 0 then 'platform' end, case when c_custkey % 9 = 0 or c_acctbal <= 0 then 'price' end, case when c_custkey % 8 = 0 then 'currency' end,
  case when c_custkey % 7 = 0 then 'offset' end, case when c_custkey % 6 = 0 then 'time' end], lambda x: x is not null), ',') as broken from customer""", adapters=False)
def capture_contract(spark, d):
    from ..operators.merge import split_quarantine

    c, key = t.parquet(spark, d, "customer"), F.col("c_custkey")
    price = F.when(key % 9 == 0, "1.234").otherwise(F.col("c_acctbal").cast("decimal(14,2)").cast("string"))
    at = F.concat(F.when(key % 6 == 0, "2024-13-01T10:00:00").otherwise("2024-01-02T10:00:00"), F.when(key % 7 == 0, "").when(key % 2 == 0, "Z").otherwise("+05:00"))
    sent = c.select("c_custkey", F.when(key % 10 == 0, " ").otherwise("shop").alias("platform"), F.col("c_name").alias("title"), price.alias("price"), F.when(key % 8 == 0, "USD").otherwise(" pkr").alias("currency"), at.alias("scraped_at"))
    kept, broken = split_quarantine(sent, t.capture_rules())
    return kept.select("c_custkey", F.lit("").alias("broken")).unionByName(broken.select("c_custkey", F.array_join("broken", ",").alias("broken")))


def _rule_events(spark, d, read):
    """Captures, and changes of alerts and watches: their making, then one at each order of the customer. An F order
    stops, an O order starts again, a P order gives a new target or threshold."""
    lines, orders, customers, parts = (read(spark, f"{d}/{x}.parquet") for x in ("lineitem", "orders", "customer", "part"))
    c = t.as_points(lines).select("product_id", "seller_id", F.col("captured_at").alias("at"), "ord", "line", (F.col("price") * 100).cast("long").alias("cents"))
    begin, none = F.lit("1900-01-01").cast("timestamp"), F.lit(None)
    key = F.col("c_custkey")
    made = customers.select(F.lit("alert").alias("kind"), F.concat(F.lit("a"), key).alias("rule_id"), key.alias("product_id"), F.when(key % 2 == 1, key % 10).alias("seller_id"), begin.alias("at"), F.lit(0).alias("ord"), (F.col("c_acctbal") > 0).alias("is_active"), F.round(F.col("c_acctbal") * 200).cast("long").alias("level"), none.alias("own"))
    key, state = F.col("o_custkey"), F.col("o_orderstatus")
    kept = F.when(state == "F", False).when(state == "O", True)
    later = orders.select(F.lit("alert").alias("kind"), F.concat(F.lit("a"), key).alias("rule_id"), key.alias("product_id"), F.when(key % 2 == 1, key % 10).alias("seller_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ord"), kept.alias("is_active"), F.when(state == "P", F.round(F.col("o_totalprice") * 25).cast("long")).alias("level"), none.alias("own"))
    watched = parts.select(F.lit("watch").alias("kind"), F.concat(F.lit("w"), "p_partkey").alias("rule_id"), F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 10).alias("seller_id"), begin.alias("at"), F.lit(0).alias("ord"), F.lit(True).alias("is_active"), (500 + F.col("p_size") * 10).alias("level"), F.round(F.col("p_retailprice") * 3800).cast("long").alias("own"))
    again = orders.select(F.lit("watch").alias("kind"), F.concat(F.lit("w"), F.col("o_orderkey") % 2000).alias("rule_id"), (F.col("o_orderkey") % 2000).alias("product_id"), (F.col("o_orderkey") % 2000 % 10).alias("seller_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ord"), kept.alias("is_active"), F.when(state == "P", F.col("o_orderkey") % 40 * 100).alias("level"), none.alias("own"))
    return rules.events(c, made.unionByName(later).unionByName(watched).unionByName(again))


RULES = """, ch as (
  select 'alert' as kind, 'a' || c_custkey as rule_id, c_custkey as product_id, case when c_custkey % 2 = 1 then c_custkey % 10 end as sole, timestamp '1900-01-01' as "at", 0 as seq, c_acctbal > 0 as act, cast(round(c_acctbal * 200) as bigint) as lev, null as own from customer
  union all select 'alert', 'a' || o_custkey, o_custkey, case when o_custkey % 2 = 1 then o_custkey % 10 end, o_orderdate, o_orderkey, case o_orderstatus when 'F' then false when 'O' then true end, case when o_orderstatus = 'P' then cast(round(o_totalprice * 25) as bigint) end, null from orders
  union all select 'watch', 'w' || p_partkey, p_partkey, p_partkey % 10, timestamp '1900-01-01', 0, true, 500 + p_size * 10, cast(round(p_retailprice * 3800) as bigint) from part
  union all select 'watch', 'w' || (o_orderkey % 2000), o_orderkey % 2000, o_orderkey % 2000 % 10, o_orderdate, o_orderkey, case o_orderstatus when 'F' then false when 'O' then true end, case when o_orderstatus = 'P' then o_orderkey % 40 * 100 end, null from orders),
ver as (select * from (select kind, rule_id, product_id, sole, "at", last_value(act ignore nulls) over w as act, last_value(lev ignore nulls) over w as lev, last_value(own ignore nulls) over w as own, sum(case when act then 1 else 0 end) over w as armed,
    row_number() over (partition by rule_id, "at" order by seq desc) as rn from ch window w as (partition by rule_id order by "at", seq rows unbounded preceding)) where rn = 1),
rr as (select distinct rule_id, kind, product_id, sole from ch),
cap as (select r.rule_id, r.kind, p.product_id, p.seller_id, p.captured_at as "at", p.ord, p.line, cast(p.price * 100 as bigint) as cents from points p join rr r on p.product_id = r.product_id and (r.sole is null or r.sole = p.seller_id)),
live as (select cap.*, ver.lev, ver.own, ver.armed from cap asof join ver on cap.rule_id = ver.rule_id and cap."at" >= ver."at" where ver.act),
gp as (select *, cast(sign(own - cents) * ((2 * abs(own - cents) * 10000 + cents) // (2 * cents)) as bigint) as gap_bp from live where kind = 'watch' and own is not null and cents > 0),
ed as (select *, lag(gap_bp >= lev, 1, false) over (partition by rule_id, armed order by "at", ord, line) as was from gp)
select kind, rule_id, product_id, seller_id, "at", ord, line, cents, null as gap_bp from (select *, row_number() over (partition by rule_id, armed order by "at", ord, line) as rn from live where kind = 'alert' and cents <= lev) where rn = 1
union all select kind, rule_id, product_id, seller_id, "at", ord, line, cents, gap_bp from ed where gap_bp >= lev and not was"""


@query(RULES)
def rule_alerts(spark, d):
    """Alerts and watches under changing rules, from tables."""
    return rules.replayed(_rule_events(spark, d, lambda s, path: s.read.parquet(path)))


@query(RULES)
def stream_rule_alerts(spark, d):
    """The same as one stream of captures and changes with state by product."""
    return captures.run_available(rules.fired(_rule_events(spark, d, captures.read)))


def _ingested(spark, d):
    """Order lines as captures of five platforms, one listing a product on each, ingested as a stream."""
    k, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    text = lambda c: c.cast("string")
    sent = captures.read(spark, f"{d}/lineitem.parquet").select(
        (k * 10 + n).alias("capture_id"), F.concat(F.lit("P"), text(s % 5)).alias("platform"), F.concat(F.lit("e"), text(p)).alias("external_id"), F.when(k % 9 == 0, p + 1000000).otherwise(p).alias("product_id"),
        F.when(s % 3 == 0, F.concat(F.lit("x"), text(s))).alias("external_seller_id"), F.when(s % 11 != 0, F.concat(F.lit(" Supplier "), text(s % 50))).alias("seller_name"), F.when(k % 13 == 0, " ").otherwise("item").alias("title"),
        text(F.col("l_extendedprice").cast("decimal(14,2)")).alias("price"), F.when(k % 7 == 0, "USD").otherwise("PKR").alias("currency"), (F.col("l_returnflag") != "R").alias("is_available"),
        F.concat(text(F.trunc("l_shipdate", "month")), F.lit("T00:00:00Z")).alias("scraped_at"),
    )
    platforms = spark.range(5).select(F.concat(F.lit("P"), text(F.col("id"))).alias("platform"), (F.col("id") != 4).alias("is_active"))
    a, own = t.alerts(spark, d), t.own_products(spark, d)
    mine = a.select("alert_id", "product_id", F.when(~F.col("on_product"), F.concat(F.lit("P"), text(F.col("seller_id") % 5))).alias("platform"), F.when(~F.col("on_product"), F.concat(F.lit("e"), text(F.col("product_id")))).alias("external_id"), "target_price", "is_active")
    watches = own.select(F.col("product_id").alias("watch_id"), F.concat(F.lit("P"), text(F.col("product_id") % 5)).alias("platform"), F.concat(F.lit("e"), text(F.col("product_id"))).alias("external_id"), "selling_price", F.lit("5.00").cast("decimal(5,2)").alias("threshold"), (F.col("stock") % 3 != 0).alias("is_active"))
    done = ingest.Ingest(spark, captures.work_folder(spark), platforms, t.products(spark, d), mine, watches)
    done.run_available(sent)
    return done


SENT = """, snt as (select ord * 10 + line as capture_id, 'P' || (seller_id % 5) as platform, 'e' || product_id as external_id, product_id as own_id, case when ord % 9 = 0 then product_id + 1000000 else product_id end as product_id,
    coalesce('id:' || case when seller_id % 3 = 0 then 'x' || seller_id end, 'name:' || case when seller_id % 11 <> 0 then 'supplier ' || (seller_id % 50) end) as seller_key, case when seller_id % 11 <> 0 then 'Supplier ' || (seller_id % 50) end as seller_name,
    price, is_available, date_trunc('month', captured_at) as at_, concat_ws(',', case when ord % 13 = 0 then 'title' end, case when price <= 0 then 'price' end, case when ord % 7 = 0 then 'currency' end) as broken from points),
jd as (select snt.*, p.is_active as act, broken = '' as kept, platform <> 'P4' and coalesce(p.is_active, false) as sound from snt left join products p on snt.product_id = p.product_id),
oc as (select *, case when not kept then 'quarantined: ' || broken when platform = 'P4' then 'inactive_platform' when act is null then 'unknown_product' when not act then 'inactive_product'
    when row_number() over (partition by kept, platform, external_id, at_, sound order by capture_id) > 1 then 'duplicate' else 'accepted' end as outcome from jd),
ac as (select * from oc where outcome = 'accepted')"""


@query(SENT + f""", al as (select alert_id, target_price, on_product, product_id as pid, 'P' || (seller_id % 5) as pl from alerts where is_active),
hit as (select al.alert_id, ac.capture_id, row_number() over (partition by al.alert_id order by at_, capture_id) as rn from ac join al on ac.own_id = al.pid and (al.on_product and ac.product_id = al.pid or not al.on_product and ac.platform = al.pl) where ac.price <= al.target_price),
wt as (select ac.own_id as watch_id, ac.capture_id, at_, {pct('o.selling_price - ac.price', 'ac.price')} as gap from ac join own o on ac.own_id = o.product_id and ac.platform = 'P' || (o.product_id % 5) where o.stock % 3 <> 0 and ac.price > 0),
ri as (select *, lag(gap >= 5, 1, false) over (partition by watch_id order by at_, capture_id) as was from wt)
select 'outcome' as what, capture_id, outcome as detail from oc union all select 'alert', capture_id, cast(alert_id as varchar) from hit where rn = 1 union all select 'risk', capture_id, watch_id || ' ' || gap from ri where gap >= 5 and not was""")
def stream_ingest_events(spark, d):
    """What became of each capture, and which alerts and risks it set off."""
    done = _ingested(spark, d)
    out = done.table("outcomes").select(F.lit("outcome").alias("what"), "capture_id", F.col("outcome").alias("detail"))
    out = out.unionByName(done.table("quarantine").select(F.lit("outcome").alias("what"), "capture_id", F.concat(F.lit("quarantined: "), F.array_join("broken", ",")).alias("detail")))
    out = out.unionByName(done.table("alerts").select(F.lit("alert").alias("what"), "capture_id", F.col("alert_id").cast("string").alias("detail")))
    return out.unionByName(done.table("risks").select(F.lit("risk").alias("what"), "capture_id", F.concat_ws(" ", "watch_id", "gap_pct").alias("detail")))


@query(SENT + f""", se as (select platform as spl, seller_key as sk, arg_max(coalesce(seller_name, ''), (at_, capture_id)) as nm from ac where seller_key is not null group by all)
select platform, external_id, product_id, current_price, is_available, first_seen, last_seen, nullif(nm, '') as seller_name from (
  select platform, external_id, arg_max(product_id, (at_, capture_id)) as product_id, {d2('arg_max(price, (at_, capture_id))')} as current_price, arg_max(is_available, (at_, capture_id)) as is_available, cast(min(at_) as date) as first_seen, cast(max(at_) as date) as last_seen,
    arg_max(coalesce(seller_key, ''), (at_, capture_id)) as lk from ac group by 1, 2) left join se on platform = spl and lk = sk""")
def stream_ingest_listings(spark, d):
    """Listings as they stand after the stream, with their sellers' names."""
    done = _ingested(spark, d)
    sellers = done.present("sellers", "platform", "seller_key").select("platform", "seller_key", "seller_name")
    now = done.present("listings", "platform", "external_id").join(sellers, ["platform", "seller_key"], "left")
    return now.select("platform", "external_id", "product_id", F.col("current_price").cast("decimal(18,2)").alias("current_price"), "is_available", F.to_date("first_seen_at").alias("first_seen"), F.to_date("captured_at").alias("last_seen"), "seller_name")
