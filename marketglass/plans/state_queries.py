"""Queries on state changes: alerts, watchlists, status, deletions, read marks, sellers, captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state
from ..sources import tables as t
from .registry import query

#: Alerts of customers, several of a user for a product, and changes of every kind; every eleventh change is another user's.
CHANGES = """, al as (select c_custkey as alert_id, cast(c_nationkey as bigint) as user_id, c_custkey % 40 as product_id, case when c_custkey % 4 = 3 then (select min(l_suppkey) from lineitem where l_partkey = c_custkey % 40) end as seller_id, cast(1000 + c_custkey as decimal(14,2)) as target_price, c_acctbal > 4000 as is_active,
    case when c_custkey % 6 = 0 then date '2024-01-01' end as triggered_at from customer),
ch as (select c_custkey as change_id, case c_custkey % 3 when 0 then 'create' when 1 then 'update' else 'delete' end as kind, case when c_custkey % 3 > 0 then c_custkey end as alert_id, cast(case when c_custkey % 11 = 0 then 77 else c_nationkey end as bigint) as user_id,
    (c_custkey * 7) % 220 as product_id, cast(null as bigint) as seller_id, cast(500 + c_custkey as decimal(14,2)) as target_price, case when c_custkey % 6 = 1 then true end as is_active from customer),
act as (select distinct user_id, product_id, seller_id from al where is_active),
out_ as (select change_id, kind, case when not exists (select 1 from products p where p.is_active and p.product_id = n.product_id) then 'no_target'
      when rn > 1 or exists (select 1 from act where act.user_id = n.user_id and act.product_id = n.product_id and act.seller_id is not distinct from n.seller_id) then 'duplicate' else 'created' end as outcome
    from (select *, row_number() over (partition by user_id, product_id order by change_id) as rn from ch where kind = 'create') n
  union all select ch.change_id, kind, case when al.alert_id is null then 'not_found'
      when kind = 'update' and ch.is_active and not al.is_active and exists (select 1 from act where act.user_id = al.user_id and act.product_id = al.product_id and act.seller_id is not distinct from al.seller_id) then 'duplicate'
      when kind = 'delete' then 'deleted' else 'updated' end from ch left join al on ch.alert_id = al.alert_id and ch.user_id = al.user_id where kind <> 'create')
"""


def _changes(spark, d):
    c = t.parquet(spark, d, "customer")
    key = F.col("c_custkey")
    least = t.points(spark, d).groupBy(F.col("product_id").alias("lp")).agg(F.min("seller_id").alias("ls"))
    a = c.join(least, (key % 40) == F.col("lp"), "left")
    a = a.select(
        key.alias("alert_id"), F.col("c_nationkey").cast("long").alias("user_id"), (key % 40).alias("product_id"), F.when(key % 4 == 3, F.col("ls")).alias("seller_id"), (key + 1000).cast("decimal(14,2)").alias("target_price"),
        (F.col("c_acctbal") > 4000).alias("is_active"), F.when(key % 6 == 0, F.lit("2024-01-01").cast("date")).alias("triggered_at"),
    )
    kind = F.when(key % 3 == 0, "create").when(key % 3 == 1, "update").otherwise("delete")
    ch = c.select(
        key.alias("change_id"), kind.alias("kind"), F.when(key % 3 > 0, key).alias("alert_id"), F.when(key % 11 == 0, 77).otherwise(F.col("c_nationkey")).cast("long").alias("user_id"), ((key * 7) % 220).alias("product_id"),
        F.lit(None).cast("long").alias("seller_id"), (key + 500).cast("decimal(14,2)").alias("target_price"), F.when(key % 6 == 1, True).alias("is_active"),
    )
    return a, ch, state.alert_outcomes(a, ch, t.products(spark, d), t.listings(spark, d))


@query(CHANGES + "select * from out_")
def alert_changes(spark, d):
    return _changes(spark, d)[2]


@query(CHANGES + """select al.alert_id, al.user_id, al.product_id, al.seller_id, case when o.outcome = 'updated' then ch.target_price else al.target_price end as target_price,
  case when o.outcome = 'deleted' then false when o.outcome = 'updated' then coalesce(ch.is_active, al.is_active) else al.is_active end as is_active, case when o.outcome = 'updated' and ch.is_active then null else al.triggered_at end as triggered_at
  from al left join ch on ch.alert_id = al.alert_id left join out_ o on o.change_id = ch.change_id
union all select 1000000 + ch.change_id, ch.user_id, ch.product_id, ch.seller_id, ch.target_price, true, null from ch join out_ o on ch.change_id = o.change_id where o.outcome = 'created'""")
def alert_table_after(spark, d):
    a, ch, out = _changes(spark, d)
    return state.alerts_after(a, ch, out, 1_000_000)


@query(""", m as (select org_id, product_id, seller_id, product_id % 3 <> 0 as is_active from watch),
w as (select org_id, case when product_id % 5 = 0 then product_id + 1000000 else product_id end as product_id, seller_id, org_id * 1000000 + product_id * 100 + seller_id % 100 as change_id from watch where product_id % 2 = 0)
select w.org_id, w.product_id, w.seller_id, w.change_id, case when m.is_active or rn > 1 then 'duplicate' when m.is_active is null then 'created' else 'reactivated' end as outcome
from (select *, row_number() over (partition by org_id, product_id, seller_id order by change_id) as rn from w) w left join m on w.org_id = m.org_id and w.product_id = m.product_id and w.seller_id = m.seller_id""")
def watch_additions(spark, d):
    held = t.watchlist(spark, d)
    members = held.withColumn("is_active", F.col("product_id") % 3 != 0)
    wanted = held.filter("product_id % 2 = 0").withColumn("change_id", F.col("org_id") * 1000000 + F.col("product_id") * 100 + F.col("seller_id") % 100)
    wanted = wanted.withColumn("product_id", F.when(F.col("product_id") % 5 == 0, F.col("product_id") + 1000000).otherwise(F.col("product_id")))
    return state.joined(members, wanted, ["org_id", "product_id", "seller_id"])


@query("""select k as c_custkey, case when c.c_custkey is null then 'not_found' when k = 7 and not up then 'refused' when up = (c_acctbal > 0) then 'unchanged' else 'changed' end as outcome
from (select c_custkey * 2 as k, c_custkey % 2 = 0 as up from customer union all select 7, false) w left join customer c on c.c_custkey = w.k""", adapters=False)
def status_changes(spark, d):
    c = t.parquet(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"))
    wanted = c.select((F.col("c_custkey") * 2).alias("c_custkey"), (F.col("c_custkey") % 2 == 0).alias("is_active"))
    return state.set_status(c, wanted.unionByName(c.filter("c_custkey = 7").withColumn("is_active", F.lit(False))), "c_custkey", 7)


@query("""select 'listings' as kind, count(*) as n from listings where product_id % 10 <> 0 union all select 'history', count(*) from points where product_id % 10 <> 0 union all select 'alerts', count(*) from alerts where product_id % 10 <> 0
union all select 'sales', count(*) from sales union all select 'sales_without_product', count(*) from sales where product_id % 10 = 0
union all select 'sellers_that_may_go', count(*) from sellers where seller_id not in (select seller_id from listings where product_id % 10 <> 0)""")
def delete_cascades(spark, d):
    gone = t.products(spark, d).filter("product_id % 10 = 0").select("product_id")
    kept = state.cascade(t.listings(spark, d), gone, "product_id")
    loose = state.set_null(t.sales(spark, d), gone, "product_id")
    parts = {
        "listings": kept, "history": state.cascade(t.points(spark, d), gone, "product_id"), "alerts": state.cascade(t.alerts(spark, d), gone, "product_id"), "sales": loose,
        "sales_without_product": loose.filter("product_id is null"), "sellers_that_may_go": state.restricted(t.sellers(spark, d), kept, "seller_id"),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()))


@query("""select user_id, count(*) filter (not was and hit) as marked, count(*) filter (not was and not hit) as unread from (
  select user_id, event_id % 3 = 0 as was, user_id % 4 = 0 or (event_id % 5 = 0 and user_id % 2 = 1) as hit from events where event_type = 'error') group by 1""", adapters=False)
def notification_marks(spark, d):
    e = t.parquet(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("notification_id"), "user_id", (F.col("event_id") % 3 == 0).alias("is_read"))
    every = e.filter("user_id % 4 = 0").select("user_id", F.lit(None).cast("long").alias("notification_id"))
    one = e.filter("notification_id % 5 = 0").select(F.when(F.col("user_id") % 2 == 1, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), "notification_id")
    return state.read_marks(e, every.unionByName(one)).groupBy("user_id").agg(F.count_if("marked").alias("marked"), F.count_if(~F.col("is_read")).alias("unread"))


SELLERS = """with s as (select s_suppkey as seller_id, cast(s_nationkey as varchar) as platform, case when s_suppkey % 3 = 0 then 'x' || s_suppkey else '' end as external_id, s_name as seller_name from supplier),
i as (select o_orderkey as item_id, cast(s_nationkey as varchar) as platform, case when o_orderkey % 2 = 0 then 'x' || s_suppkey end as external_id, '  ' || upper(case when o_orderkey % 5 = 0 then 'Nobody' else s_name end) || ' ' as seller_name from orders join supplier on o_orderkey % 10 = s_suppkey),
r as (select item_id, coalesce(s1, s2) as seller_id, case when s1 is not null then 'external_id' when s2 is not null then 'name' else 'new' end as matched_by from i
  left join (select platform as p1, external_id as e1, min(seller_id) as s1 from s where external_id <> '' group by all) a on i.platform = p1 and i.external_id = e1
  left join (select platform as p2, lower(seller_name) as n2, min(seller_id) as s2 from s group by all) b on i.platform = p2 and lower(trim(i.seller_name)) = n2)
"""


def _seller_items(spark, d):
    s, o = t.parquet(spark, d, "supplier"), t.parquet(spark, d, "orders")
    sellers = s.select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").cast("string").alias("platform"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))).otherwise("").alias("external_id"), F.col("s_name").alias("seller_name"))
    j = o.join(s, o.o_orderkey % 10 == s.s_suppkey)
    name = F.concat(F.lit("  "), F.upper(F.when(F.col("o_orderkey") % 5 == 0, "Nobody").otherwise(F.col("s_name"))), F.lit(" "))
    items = j.select(F.col("o_orderkey").alias("item_id"), F.col("s_nationkey").cast("string").alias("platform"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))).alias("external_id"), name.alias("seller_name"))
    return sellers, items, state.resolve_sellers(items, sellers)


@query(SELLERS + "select * from r", adapters=False)
def seller_resolve_two_phase(spark, d):
    return _seller_items(spark, d)[2]


@query(SELLERS + """select s.seller_id, s.platform, coalesce(e, s.external_id) as external_id, coalesce(n, s.seller_name) as seller_name from s left join (
  select r.seller_id, last(trim(i.seller_name) order by r.item_id) as n, last(i.external_id order by r.item_id) filter (i.external_id <> '') as e from r join i on r.item_id = i.item_id where r.seller_id is not null group by 1) x on s.seller_id = x.seller_id""", adapters=False)
def seller_table_after(spark, d):
    sellers, items, found = _seller_items(spark, d)
    return state.seller_after(sellers, items, found)


LEGACY = """with i as (select o_orderkey as item_id, o_orderpriority as platform, 'e' || (o_orderkey % 7000) as external_id, 'model ' || (o_custkey % 90) as model, case o_orderkey % 4 when 0 then nullif('N/A', 'N/A') when 1 then 'red' when 2 then null else 'blue' end as color from orders),
known as (select distinct 'e' || l_suppkey as external_id from lineitem), had_p as (select '1-URGENT' as platform), had_m as (select 'model ' || n_nationkey as model from nation), had_v as (select 'model ' || n_nationkey as model, case when n_nationkey % 2 = 0 then 'red' end as color from nation),
a as (select i.*, k.external_id is not null or row_number() over (partition by i.external_id order by item_id) > 1 as upd from i left join known k on i.external_id = k.external_id),
n as (select *, row_number() over (partition by platform order by item_id) as rp, row_number() over (partition by model order by item_id) as rm, row_number() over (partition by model, color order by item_id) as rv from a where not upd)
select item_id, 'updated' as action, false as new_platform, false as new_category, false as new_product, false as new_variant from a where upd
union all select item_id, 'created', rp = 1 and platform not in (select platform from had_p), item_id = (select min(item_id) from n), rm = 1 and model not in (select model from had_m), rv = 1 and not exists (select 1 from had_v h where h.model = n.model and h.color is not distinct from n.color) from n"""


@query(LEGACY, adapters=False)
def legacy_ingest_plan(spark, d):
    o, n = t.parquet(spark, d, "orders"), t.parquet(spark, d, "nation")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    color = F.element_at(F.array(F.lit("N/A"), F.lit("red"), F.lit(""), F.lit("blue")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    items = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("platform"), text("e", F.col("o_orderkey") % 7000).alias("external_id"), text("model ", F.col("o_custkey") % 90).alias("model"), color.alias("color"))
    listed = t.parquet(spark, d, "lineitem").select(text("e", F.col("l_suppkey")).alias("external_id"))
    platforms = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("platform")).distinct()
    models = n.select(text("model ", F.col("n_nationkey")).alias("model"), F.when(F.col("n_nationkey") % 2 == 0, "red").alias("color"))
    categories = t.parquet(spark, d, "part").select(F.lower("p_type").alias("slug"))
    return state.legacy_ingest(items, listed, platforms, models, models, categories)


@query(""", c as (select ord * 10 + line as capture_id, (select max(platform) from sellers s where s.seller_id = points.seller_id) as platform, case when ord % 9 = 0 then product_id + 1000000 else product_id end as product_id, seller_id, date_trunc('month', captured_at) as captured_at, case when ord % 7 = 0 then 'USD' else 'PKR' end as currency from points where ord % 2 = 1),
h as (select distinct product_id, seller_id, date_trunc('month', captured_at) as captured_at from points where ord % 2 = 0),
j as (select c.*, p.is_active as act, h.product_id is not null as had from c left join products p on c.product_id = p.product_id left join h on c.product_id = h.product_id and c.seller_id = h.seller_id and c.captured_at = h.captured_at),
k as (select *, coalesce(platform <> 'ASIA', false) and coalesce(act, false) and currency = 'PKR' as sound from j)
select capture_id, case when coalesce(platform = 'ASIA', true) then 'inactive_platform' when act is null then 'unknown_product' when not act then 'inactive_product' when currency <> 'PKR' then 'currency' when had or row_number() over (partition by product_id, seller_id, captured_at, sound order by capture_id) > 1 then 'duplicate' else 'accepted' end as outcome from k""")
def capture_chain(spark, d):
    p = t.points(spark, d).withColumn("captured_at", F.date_trunc("month", "captured_at"))
    s = t.sellers(spark, d).select("seller_id", "platform")
    c = p.filter("ord % 2 = 1").join(s, "seller_id", "left")
    c = c.select((F.col("ord") * 10 + F.col("line")).alias("capture_id"), "platform", F.when(F.col("ord") % 9 == 0, F.col("product_id") + 1000000).otherwise(F.col("product_id")).alias("product_id"), "seller_id", "captured_at", F.when(F.col("ord") % 7 == 0, "USD").otherwise("PKR").alias("currency"))
    platforms = s.select("platform", (F.col("platform") != "ASIA").alias("is_active")).distinct()
    return state.capture_outcomes(c, platforms, t.products(spark, d), p.filter("ord % 2 = 0"))


@query(""", cp as (select product_id % 50 as org_id, product_id, 'S' || product_id as sku from own),
wn as (select o_orderkey as change_id, case when o_orderkey % 11 = 0 then 99 else o_custkey % 50 end as org_id, case when o_orderstatus <> 'O' then o_custkey end as product_id, case when o_orderkey % 13 <> 0 then 'S' || (o_orderkey % 3000) end as sku,
    case when o_orderkey % 3 <> 0 then o_orderkey % 2100 end as canonical_id, case when o_orderkey % 17 = 0 then 'USD' when o_orderkey % 5 = 0 then null else 'PKR' end as currency from orders),
ck as (select wn.*, case when wn.product_id is not null and not exists (select 1 from cp where cp.org_id = wn.org_id and cp.product_id = wn.product_id) then 'not_found'
    when coalesce(wn.currency, case when wn.product_id is null then 'none' else 'PKR' end) <> 'PKR' then 'currency'
    when canonical_id is not null and not exists (select 1 from products p where p.product_id = wn.canonical_id and p.is_active) then 'unknown_catalog_product'
    when exists (select 1 from cp where cp.org_id = wn.org_id and cp.sku = wn.sku and cp.product_id is distinct from wn.product_id) then 'sku_taken' end as early from wn),
ok as (select *, coalesce(product_id, -change_id) as who, first_value(coalesce(product_id, -change_id)) over (partition by org_id, sku order by change_id) as f from ck where early is null)
select change_id, early as outcome, sku from ck where early is not null
union all select change_id, case when sku is not null and f <> who then 'sku_taken' when product_id is null then 'created' else 'updated' end, sku from ok""")
def organisation_products_saved(spark, d):
    """Changes of organisations' own products, one an order: O orders make a product, others change that of the customer's number."""
    own, o = t.own_products(spark, d), t.parquet(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    have = own.select((F.col("product_id") % 50).alias("org_id"), "product_id", F.concat(F.lit("s"), F.col("product_id").cast("string")).alias("sku"))
    named = F.concat(F.lit(" s"), (k % 3000).cast("string"), F.lit(" "))
    wanted = o.select(
        k.alias("change_id"), F.when(k % 11 == 0, 99).otherwise(c % 50).alias("org_id"), F.when(F.col("o_orderstatus") != "O", c).alias("product_id"), F.when(k % 13 == 0, " ").otherwise(named).alias("sku"),
        F.when(k % 3 != 0, k % 2100).alias("canonical_id"), F.when(k % 17 == 0, "USD").when(k % 5 != 0, "PKR").alias("currency"),
    )
    return state.saved_products(have, wanted, t.products(spark, d))
