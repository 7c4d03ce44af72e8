"""Queries on inventory, anomalies, demand and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, demand, graph, inventory, recommend
from ..sources import tables as t
from ..sources.shared import materialize
from .registry import query

#: The first line of an order is a delivery of three times its quantity, the others are sales.
MOVES = """, mv as (select product_id, sale_date as day, source_row, quantity from sales),
dl as (select product_id, day, 3 * quantity as quantity from mv where source_row = 1), sl as (select product_id, day, quantity from mv where source_row > 1),
dy as (select product_id, day, sum(d) as delivered, sum(s) as demanded from (select product_id, day, quantity as d, 0 as s from dl union all select product_id, day, 0, quantity from sl) group by all),
rn as (select dy.*, coalesce(o.stock, 0) + sum(delivered - demanded) over w as run from dy left join own o on dy.product_id = o.product_id window w as (partition by dy.product_id order by day)),
sh as (select *, greatest(0, -min(run) over (partition by product_id order by day)) as short from rn),
bk as (select product_id, day, cast(delivered as bigint) as delivered, cast(demanded as bigint) as demanded, cast(run + short as bigint) as balance, cast(short - coalesce(lag(short) over (partition by product_id order by day), 0) as bigint) as lost from sh)"""


def _moves(spark, d):
    s = t.sales(spark, d).withColumnRenamed("sale_date", "day")
    delivered = s.filter("source_row = 1").select("product_id", "day", (3 * F.col("quantity")).alias("quantity"))
    return t.own_products(spark, d), delivered, s.filter("source_row > 1").select("product_id", "day", "quantity")


@query(MOVES + " select * from bk")
def stock_ledger(spark, d):
    return inventory.ledger(*_moves(spark, d))


@query(MOVES + """, so as (select product_id, day, sum(quantity) as sold from sl group by all),
ld as (select product_id, day, cast(sum(sold) over (partition by product_id order by day range between current row and interval 13 days following) as bigint) as demand from so),
pl as (select *, count(*) over (partition by product_id) as n, row_number() over (partition by product_id order by demand, day) as place from ld),
pt as (select product_id, n as demand_days, demand as reorder_point from pl where place = cast(ceil(n * 0.95) as bigint)),
lb as (select product_id, arg_max(balance, day) as balance, cast(sum(lost) as bigint) as lost from bk group by 1)
select lb.product_id, coalesce(demand_days, 0) as demand_days, coalesce(reorder_point, 0) as reorder_point, balance, lost, case when balance <= coalesce(reorder_point, 0) then greatest(0, 2 * coalesce(reorder_point, 0) - balance) else 0 end as order_quantity
from lb left join pt on lb.product_id = pt.product_id""")
def reorder_points(spark, d):
    opening, delivered, sold = _moves(spark, d)
    return inventory.reorder_points(inventory.ledger(opening, delivered, sold), sold)


@query(""", x as (select *, cast(price as double) as v from points),
md as (select product_id, v as median from (select *, row_number() over (partition by product_id order by v) as k, count(*) over (partition by product_id) as n from x) where k = cast(ceil(n * 0.5) as bigint)),
f as (select x.*, median, abs(v - median) as off from x join md on x.product_id = md.product_id),
sp as (select product_id, off as mad from (select *, row_number() over (partition by product_id order by off) as k, count(*) over (partition by product_id) as n from f) where k = cast(ceil(n * 0.5) as bigint))
select f.product_id, seller_id, ord, line, median, mad, round((v - median) / nullif(mad * 1.4826, 0), 6) as deviation from f join sp on f.product_id = sp.product_id where coalesce(abs((v - median) / nullif(mad * 1.4826, 0)) >= 2, off > 0)""")
def price_outliers(spark, d):
    found = anomalies.outliers(t.points(spark, d), limit=2.0)
    return found.select("product_id", "seller_id", "ord", "line", "median", "mad", F.round("deviation", 6).alias("deviation"))


@query()
def price_level_changes(spark, d):
    return anomalies.change_points(t.points(spark, d), width="month")


@query()
def demand_forecast(spark, d):
    return demand.forecast(t.sales(spark, d))


@query()
def recommended_products(spark, d):
    weights = materialize(recommend.tastes(t.sales(spark, d)))
    return recommend.recommended(recommend.fit(weights), weights)


ROUNDS = 6
#: The rounds one by one, as SQL has no loop that sums.
TRUST = """, e as materialized (select org_id as b, seller_id as s, cast(sum(quantity) as double) as w from (select org_id, seller_id, quantity from pairs where quantity > 0) group by all),
so as materialized (select b, s, w / sum(w) over (partition by s) as so, w / sum(w) over (partition by b) as bo from e), nn as (select count(*) as n from sellers),
r0 as materialized (select seller_id, 1.0::double / n as t, exists (select 1 from e where e.s = seller_id) as linked from sellers, nn)""" + "".join(
    f""", b{k} as materialized (select b, sum(t * so) as h from so join r{k} on s = seller_id group by 1), g{k} as materialized (select s, sum(h * bo) as g from so join b{k} using (b) group by 1),
r{k + 1} as materialized (select seller_id, 0.15 / n + 0.85 * (select coalesce(sum(t), 0) from r{k} where not linked) / n + 0.85 * coalesce(g, 0) as t, linked from r{k} left join g{k} on s = seller_id, nn)"""
    for k in range(ROUNDS)
)


@query(""", pairs as (select o_custkey as org_id, l_suppkey as seller_id, cast(l_quantity as integer) as quantity from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and l_suppkey % 7 <> 0)""" + TRUST + f" select seller_id, round(t, 9) as trust from r{ROUNDS}")
def seller_trust(spark, d):
    """Six rounds of scores over fulfilled orders; sellers whose id is divisible by seven have no buyers."""
    li, o = t.parquet(spark, d, "lineitem").filter("l_suppkey % 7 <> 0"), t.parquet(spark, d, "orders").filter("o_orderstatus = 'F'")
    pairs = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("buyer_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_quantity").cast("int").alias("weight"))
    return graph.trust(pairs, t.sellers(spark, d), tolerance=0.0, rounds=ROUNDS).select("seller_id", F.round("trust", 9).alias("trust"))


@query()
def dense_buyers(spark, d):
    s = t.sales(spark, d).select(F.col("org_id").alias("user_id"), "product_id")
    return graph.dense_block(s)[0]
