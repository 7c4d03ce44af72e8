"""Queries on the catalog, administration views and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts, assistant, catalog, matching, merge, prices
from ..sources import tables as t
from .price_queries import GUIDE, MINE, PERSONAL, my_alerts
from .registry import d2, query


def _offers(spark, d):
    return t.listings(spark, d).join(t.sellers(spark, d), "seller_id")


CARDS = """, offers as (select l.*, s.platform, s.rating from listings l join sellers s on l.seller_id = s.seller_id),
cards as (select p.*, cast(x.lowest as decimal(18,2)) as lowest_price, x.best_rating, coalesce(x.offers, 0) as offers, coalesce(x.platforms, '') as platforms
  from products p left join (select product_id, min(case when is_available then current_price end) as lowest, max(rating) as best_rating, count(*) filter (is_available) as offers, string_agg(distinct platform, ',' order by platform) as platforms from offers group by 1) x on p.product_id = x.product_id),
found as (select c.* from cards c where is_active and (name ilike '%ring%' or brand ilike '%ring%') and exists (select 1 from offers o where o.product_id = c.product_id and current_price between 20000 and 60000 and rating >= 15 and is_available))
"""
SHOWN = "product_id, name, brand, lowest_price, best_rating, offers, platforms"


def _found(spark, d):
    return catalog.search(t.products(spark, d), _offers(spark, d), term=" ring ", min_price=20000, max_price=60000, min_rating=15, available=True)


@query(CARDS + f"select {SHOWN} from cards")
def catalog_cards(spark, d):
    return catalog.cards(t.products(spark, d), _offers(spark, d)).select(*SHOWN.split(", "))


@query(CARDS + f"select {SHOWN} from found order by lower(name), product_id limit 20 offset 20")
def catalog_search_page(spark, d):
    # Captures are reduced to products of the name before they become listings, and cards are made for one page's rows.
    named = t.products(spark, d).filter(catalog.every([F.col("is_active"), *catalog.contains_any(" ring ", "name", "brand")]))
    captures = t.points(spark, d).join(named.select("product_id"), "product_id", "left_semi")
    offers = t.latest(captures, "product_id", "seller_id").join(t.sellers(spark, d), "seller_id")
    found = catalog.search(named, offers, min_price=20000, max_price=60000, min_rating=15, available=True)
    shown = catalog.page(found, [*catalog.ORDERS["name_asc"](), F.col("product_id")], 2, 20)
    return catalog.cards(shown, offers.join(shown.select("product_id"), "product_id", "left_semi")).select(*SHOWN.split(", "))


@query(CARDS + "select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from found")
def catalog_search_count(spark, d):
    return catalog.page_totals(_found(spark, d), 20)


@query(CARDS + "select product_id, lowest_price from cards where is_active order by lowest_price asc nulls last, product_id limit 50")
def catalog_sort_price_nulls_last(spark, d):
    shown = catalog.cards(t.products(spark, d).filter("is_active"), _offers(spark, d))
    return catalog.page(shown, [*catalog.ORDERS["price_asc"](), F.col("product_id")], 1, 50).select("product_id", "lowest_price")


@query(CARDS + "select product_id, best_rating from cards where is_active order by best_rating desc nulls last, product_id limit 50")
def catalog_sort_rating_desc(spark, d):
    shown = catalog.cards(t.products(spark, d).filter("is_active"), _offers(spark, d))
    return catalog.page(shown, [*catalog.ORDERS["rating_desc"](), F.col("product_id")], 1, 50).select("product_id", "best_rating")


def _sorted(spark, d, order):
    shown = catalog.cards(t.products(spark, d).filter("is_active"), _offers(spark, d))
    return catalog.page(shown, [*catalog.ORDERS[order](), F.col("product_id")], 1, 50)


@query(CARDS + "select product_id, name from cards where is_active order by lower(name) desc, product_id limit 50")
def catalog_sort_name_desc(spark, d):
    return _sorted(spark, d, "name_desc").select("product_id", "name")


@query(CARDS + "select product_id, lowest_price from cards where is_active order by lowest_price desc nulls last, product_id limit 50")
def catalog_sort_price_desc(spark, d):
    return _sorted(spark, d, "price_desc").select("product_id", "lowest_price")


@query(CARDS + "select product_id, offers from cards where is_active order by product_id desc limit 50")
def catalog_sort_newest(spark, d):
    return _sorted(spark, d, "newest").select("product_id", "offers")


@query(f"select product_id, seller_id, {d2('current_price')} as current_price, cast(row_number() over (partition by product_id order by current_price, seller_id) as integer) as place from listings where is_available")
def product_listings_available(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("product_id").orderBy("current_price", "seller_id")
    return t.listings(spark, d).filter("is_available").select("product_id", "seller_id", F.col("current_price").cast("decimal(18,2)").alias("current_price"), F.row_number().over(w).alias("place"))


@query(f""", pp as (select product_id, name, case when product_id % 7 <> 0 then brand end as brand, category, is_active from products), br as (select distinct brand as code, 'Brand ' || brand as label from products where brand <> 'Brand#13'), ca as (select distinct category as code, lower(category) as label from products)
select p.product_id, name, br.label as brand, ca.label as category, p.is_active, count(l.seller_id) as listings, count(*) filter (l.is_available) as available, {d2('min(current_price)')} as lowest
from pp p left join br on p.brand = br.code left join ca on p.category = ca.code left join listings l on p.product_id = l.product_id group by all""")
def admin_products(spark, d):
    """Products with their brand's and category's labels; those without a brand, or of an unknown one, stay."""
    g = t.listings(spark, d).groupBy("product_id").agg(F.count(F.lit(1)).alias("listings"), F.count_if("is_available").alias("available"), F.min("current_price").alias("lowest"))
    every = t.products(spark, d)
    brands = every.filter("brand <> 'Brand#13'").select("brand", F.concat(F.lit("Brand "), "brand").alias("brand_label")).distinct()
    categories = every.select("category", F.lower("category").alias("category_label")).distinct()
    p = every.withColumn("brand", F.when(F.col("product_id") % 7 != 0, F.col("brand")))
    j = p.join(brands, "brand", "left").join(categories, "category", "left").join(g, "product_id", "left")
    return j.select("product_id", "name", F.col("brand_label").alias("brand"), F.col("category_label").alias("category"), "is_active", F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("available", F.lit(0)).alias("available"), F.col("lowest").cast("decimal(18,2)").alias("lowest"))


LISTING_COLUMNS = "product_id, seller_id, product_name, brand, category, product_active, seller_name, country, platform, rating, current_price, is_available, first_seen, last_seen, days_seen"
LISTING_COLUMNS += ", external_id, title, product_url, platform_code, product_model, variant_id, variant_sku, ram_gb, storage_gb, color, seller_is_verified, original_price, currency, review_count, warranty"


@query(f"""select l.product_id, l.seller_id, p.name as product_name, p.brand, p.category, p.is_active as product_active, s.seller_name, s.country, s.platform, s.rating, {d2('l.current_price')} as current_price, l.is_available,
  cast(first_seen_at as date) as first_seen, cast(last_seen_at as date) as last_seen, date_diff('day', cast(first_seen_at as date), cast(last_seen_at as date)) as days_seen,
  l.product_id || '-' || l.seller_id as external_id, concat_ws(' by ', p.name, s.seller_name) as title, 'https://market.example/' || replace(lower(s.platform), ' ', '-') || '/' || l.product_id || '-' || l.seller_id as product_url, replace(lower(s.platform), ' ', '-') as platform_code,
  p.brand || '/' || p.storage_gb as product_model, p.product_id * 10 as variant_id, 'SKU-' || lpad(cast(p.product_id as varchar), 8, '0') as variant_sku, p.storage_gb % 16 as ram_gb, p.storage_gb, case when p.storage_gb % 3 = 0 then 'black' end as color,
  s.rating >= 40 as seller_is_verified, case when h.top > l.current_price then {d2('h.top')} end as original_price, 'PKR' as currency, h.n as review_count, case when p.storage_gb >= 25 then '1 year' end as warranty
from listings l join products p on l.product_id = p.product_id left join sellers s on l.seller_id = s.seller_id join (select product_id, seller_id, count(*) as n, max(price) as top from points group by all) h on h.product_id = l.product_id and h.seller_id = l.seller_id
where s.seller_name ilike '%7%' or p.name ilike '%7%'""")
def admin_listings(spark, d):
    """The administration's view of listings: listing, platform, product, variant and seller side by side."""
    history = t.points(spark, d).groupBy("product_id", "seller_id").agg(F.count(F.lit(1)).alias("review_count"), F.max("price").alias("top"))
    j = t.listings(spark, d).join(t.products(spark, d).withColumnsRenamed({"is_active": "product_active", "name": "product_name"}), "product_id").join(t.sellers(spark, d), "seller_id", "left")
    j = j.filter(catalog.every(catalog.contains_any("7", "seller_name", "product_name"))).join(history, ["product_id", "seller_id"])
    text = lambda c: F.col(c).cast("string")
    gb, code = F.col("storage_gb"), F.replace(F.lower("platform"), F.lit(" "), F.lit("-"))
    j = j.withColumns({"external_id": F.concat_ws("-", text("product_id"), text("seller_id")), "platform_code": code, "title": F.concat_ws(" by ", "product_name", "seller_name")})
    j = j.withColumns({
        "first_seen": F.to_date("first_seen_at"), "last_seen": F.to_date("last_seen_at"), "product_url": F.concat(F.lit("https://market.example/"), "platform_code", F.lit("/"), "external_id"), "product_model": F.concat("brand", F.lit("/"), text("storage_gb")),
        "variant_id": F.col("product_id") * 10, "variant_sku": F.concat(F.lit("SKU-"), F.lpad(text("product_id"), 8, "0")), "ram_gb": gb % 16, "color": F.when(gb % 3 == 0, "black"), "seller_is_verified": F.col("rating") >= 40,
        "original_price": F.when(F.col("top") > F.col("current_price"), F.col("top").cast("decimal(18,2)")), "currency": F.lit("PKR"), "warranty": F.when(gb >= 25, "1 year"),
    })
    j = j.withColumn("current_price", F.col("current_price").cast("decimal(18,2)"))
    return j.withColumn("days_seen", F.date_diff("last_seen", "first_seen").cast("long")).select(*LISTING_COLUMNS.split(", "))


@query("""select (select count(*) from customer) as users, (select count(*) from customer where c_acctbal >= 0) as active_users, (select count(*) from products) as products, (select count(*) from products where is_active) as active_products,
(select count(*) from listings) as listings, (select count(*) from listings where is_available) as available, (select count(*) from alerts) as alerts, (select count(*) from alerts where is_active) as active_alerts,
(select count(*) from customer where c_mktsegment = 'FURNITURE') as consumers, (select count(*) from customer where c_mktsegment = 'MACHINERY') as merchants, (select count(*) from customer where c_mktsegment = 'BUILDING') as admins,
(select count(distinct a.alert_id) from alerts a join points p on a.product_id = p.product_id and (a.on_product or a.seller_id = p.seller_id) where a.is_active and p.price <= a.target_price) as triggered_alerts""")
def admin_dashboard(spark, d):
    one = lambda df, name, **tests: df.agg(F.count(F.lit(1)).alias(name), *(F.count_if(x).alias(k) for k, x in tests.items()))
    role = lambda r: F.col("c_mktsegment") == r
    a = t.alerts(spark, d)
    parts = [
        one(t.parquet(spark, d, "customer"), "users", active_users=F.col("c_acctbal") >= 0, consumers=role("FURNITURE"), merchants=role("MACHINERY"), admins=role("BUILDING")),
        one(t.products(spark, d), "products", active_products=F.col("is_active")), one(t.listings(spark, d), "listings", available=F.col("is_available")),
        one(a, "alerts", active_alerts=F.col("is_active")), one(alerts.first_triggers(a, t.points(spark, d)), "triggered_alerts"),
    ]
    out = parts[0]
    for p in parts[1:]:  # single rows
        out = out.crossJoin(p)
    return out


@query("select 'products' as kind, count(*) as n from products union all select 'listings', count(*) from listings union all select 'history', count(*) from points union all select 'sellers', count(*) from sellers")
def seed_counts(spark, d):
    parts = {"products": t.products(spark, d), "listings": t.listings(spark, d), "history": t.points(spark, d), "sellers": t.sellers(spark, d)}
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()))


@query("select o_orderpriority as role, count(distinct c_custkey) as users from customer join orders on c_custkey = o_custkey where c_acctbal >= 0 group by 1", adapters=False)
def users_by_bridge_role(spark, d):
    """Users of each role, by way of a table that holds (user, role) pairs, some of them more than once."""
    c, o = t.parquet(spark, d, "customer"), t.parquet(spark, d, "orders")
    held = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("role")).distinct()
    return held.join(c.filter("c_acctbal >= 0"), "c_custkey").groupBy("role").agg(F.count(F.lit(1)).alias("users"))


@query("select c_mktsegment as role, count(distinct c_custkey) as users from customer join nation on c_nationkey = n_nationkey where c_acctbal >= 0 group by 1", adapters=False)
def admin_users_by_role(spark, d):
    c, n = t.parquet(spark, d, "customer"), t.parquet(spark, d, "nation")
    return c.filter("c_acctbal >= 0").join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("role")).agg(F.countDistinct("c_custkey").alias("users"))


@query("select c_custkey as org_id from customer where c_custkey = 42 or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')", adapters=False)
def access_orgs(spark, d):
    c, o = t.parquet(spark, d, "customer"), t.parquet(spark, d, "orders")
    member = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(member.unionByName(c.filter("c_custkey = 42").select("c_custkey")), "c_custkey", "left_semi").select(F.col("c_custkey").alias("org_id"))


@query("""with v as (select distinct case when p_size % 2 = 0 then upper(p_brand) else p_brand end as value, 'brand' as kind from part union select distinct lower(p_type), 'category' from part union select r_name, 'platform' from region)
select value, kind, cast(row_number() over (partition by kind order by lower(value), value) as integer) as place from v""", adapters=False)
def reference_lists(spark, d):
    """Names as lists show them: without regard to case, then as written."""
    p, r = t.parquet(spark, d, "part"), t.parquet(spark, d, "region")
    brand = F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    kind = lambda df, c, k: df.select(c.alias("value"), F.lit(k).alias("kind"))
    return catalog.listed(kind(p, brand, "brand").unionByName(kind(p, F.lower("p_type"), "category")).unionByName(kind(r, F.col("r_name"), "platform")), "value", "kind")


@query("select a.n_nationkey as id, a.n_name as name, b.n_name as parent from nation a left join nation b on a.n_nationkey // 5 - 1 = b.n_nationkey", adapters=False)
def category_parent(spark, d):
    n = t.parquet(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.floor(F.col("n_nationkey") / 5) - 1).cast("int").alias("parent_id"))
    b = n.select(F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("parent"))
    return a.join(b, "parent_id", "left").select("id", "name", "parent")


@query(""", p as (select product_id, name, case when product_id % 7 <> 0 then brand end as brand, category from products where is_active)
select product_id, cast(rank as integer) as rank, other_id, same from (
  select a.product_id, b.product_id as other_id, a.brand = b.brand as same, row_number() over (partition by a.product_id order by case when a.brand is null or b.brand is null then 0 when a.brand = b.brand then 1 else 2 end, b.name, b.product_id) as rank
  from p a join p b on a.category = b.category and a.product_id <> b.product_id) where rank <= 4""")
def similar_products(spark, d):
    p = t.products(spark, d)
    return catalog.similar(p.withColumn("brand", F.when(F.col("product_id") % 7 != 0, F.col("brand"))))


@query("select product_id, s from (select product_id, regexp_replace(trim(regexp_replace(lower(name || ' - ' || brand || '!'), '[^a-z0-9]+', ' ', 'g')), ' +', ' ', 'g') as s from products)")
def normalize_ascii(spark, d):
    return t.products(spark, d).select("product_id", text.normalize_ascii(F.concat("name", F.lit(" - "), "brand", F.lit("!"))).alias("s"))


@query("""select product_id, base || case when r > 1 then '-' || r else '' end as slug from (select product_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as base, row_number() over (partition by name order by product_id) as r from products)""")
def slugify_unique(spark, d):
    from pyspark.sql.window import Window

    p = t.products(spark, d).withColumn("base", text.slug_base(F.col("name")))
    r = F.row_number().over(Window.partitionBy("base").orderBy("product_id"))
    return p.withColumn("r", r).select("product_id", F.concat("base", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("slug"))


@query("""select product_id, cast(case product_id % 4 when 0 then 8 when 1 then case when storage_gb <= 32 then storage_gb end when 2 then 12 end as integer) as ram,
  cast(case product_id % 4 when 0 then 256 when 1 then case when storage_gb > 32 then storage_gb when storage_gb * 16 >= 32 then storage_gb * 16 end when 2 then 1024 end as integer) as storage from products""")
def memory_extract(spark, d):
    """Titles with explicit marks, with two bare sizes, with terabytes, and without a size."""
    size = F.col("storage_gb")
    bare = F.concat("name", F.lit(" "), size.cast("string"), F.lit(" GB / "), (size * 16).cast("string"), F.lit("gb"))
    kinds = F.array(F.concat("name", F.lit(" 512gb 256 gb rom, 8GB RAM")), bare, F.concat("name", F.lit(" 1TB 12gb")), F.col("name"))
    ram, rom = text.memory(F.element_at(kinds, (F.col("product_id") % 4 + 1).cast("int")))
    return t.products(spark, d).select("product_id", ram.alias("ram"), rom.alias("storage"))


@query("""with v as (select distinct split_part(p_name, ' ', 1) as v from part), s as (select p_partkey, regexp_replace(lower(split_part(p_name, ' ', 1) || '-' || case p_partkey % 3 when 0 then 'Small' when 1 then p_type else '' end), '[^a-z0-9]+', '', 'g') as title from part)
select p_partkey as item_id, case when count(v) = 1 then min(v) end as value from s left join v on contains(title, v) group by 1""", adapters=False)
def unique_catalog_value(spark, d):
    p = t.parquet(spark, d, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    more = F.when(F.col("p_partkey") % 3 == 0, "Small").when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise("")
    return catalog.unique_value(p.select(F.col("p_partkey").alias("item_id"), F.concat(word, F.lit("-"), more).alias("title")), p.select(word.alias("value")))


@query("select o_orderkey, c_custkey from orders left join customer on nullif(upper(trim(' cust-' || o_custkey || ' ')), '') = 'CUST-' || c_custkey", adapters=False)
def sku_lookup(spark, d):
    o, c = t.parquet(spark, d, "orders"), t.parquet(spark, d, "customer")
    a = o.select("o_orderkey", text.sku(F.concat(F.lit(" cust-"), F.col("o_custkey").cast("string"), F.lit(" "))).alias("sku"))
    b = c.select("c_custkey", F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("sku"))
    return a.join(b, "sku", "left").select("o_orderkey", "c_custkey")


@query("select c_custkey, case when regexp_matches(s, '^[=+\\-@]') then '''' || s else s end as safe from (select c_custkey, case c_custkey % 4 when 0 then '=' when 1 then '-' when 2 then '@' else '' end || c_name as s from customer)", adapters=False)
def report_safe_text(spark, d):
    c = t.parquet(spark, d, "customer")
    mark = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", text.spreadsheet_safe(F.concat(mark, F.col("c_name"))).alias("safe"))


@query("""select distinct unnest(case when p_partkey % 2 = 0 then ['ram', p_type] else ['storage', p_brand] end) as key from part""", adapters=False)
def spec_key_union(spark, d):
    p = t.parquet(spark, d, "part")
    even = F.create_map(F.lit("ram"), F.lit("1"), F.col("p_type"), F.lit("1"))
    odd = F.create_map(F.lit("storage"), F.lit("1"), F.col("p_brand"), F.lit("1"))
    return catalog.spec_keys(p.select(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("spec")))


INTENT_SQL = "case " + " ".join(f"when {' or '.join(f'contains(m, {chr(39)}{p}{chr(39)})' for p in phrases)} then '{name}'" for name, phrases in assistant.INTENTS) + " else 'product_search' end"
STOP = ", ".join(f"'{w}'" for w in assistant.STOP_WORDS)


@query(f"select conv_id, turn, {INTENT_SQL} as intent from (select *, ' ' || lower(trim(text)) || case turn % 3 when 0 then ' price' when 1 then ' vs ' else '' end || ' ' as m from conversations where role = 'user')", adapters=False)
def assistant_intent(spark, d):
    c = t.parquet(spark, d, "conversations").filter("role = 'user'")
    tail = F.when(F.col("turn") % 3 == 0, " price").when(F.col("turn") % 3 == 1, " vs ").otherwise("")
    return c.select("conv_id", "turn", assistant.intent(F.concat(F.trim("text"), tail, F.lit("."))).alias("intent"))


TERMS = f"list_slice(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: len(w) >= 2 and w not in ({STOP})), 1, 8)"


@query(f"select conv_id, turn, array_to_string({TERMS}, ' ') as terms from conversations where role = 'user'", adapters=False)
def assistant_terms(spark, d):
    c = t.parquet(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(assistant.search_terms(F.col("text"), assistant.STOP_WORDS), " ").alias("terms"))


#: Messages made of product names and phrases of each intent; every fifth names nothing, and has context ids.
ASKED = """, msgs as (select product_id as message_id, case when product_id % 5 = 0 then 'show me the price' else 'what of the ' || split_part(name, ' ', 1) || case when product_id % 2 = 0 then ' ' || split_part(name, ' ', 2) else '' end end
  || case product_id % 7 when 0 then ' vs ' when 1 then ' history ' when 2 then ' buy now ' when 3 then ' suggest ' when 4 then ' alert 12,500.50' when 5 then ' cheapest ' else '' end as text,
  [cast(product_id as varchar), 'x1', cast(product_id + 1 as varchar)] as context_ids from products),
terms as (select distinct message_id, unnest(""" + TERMS + """) as term from msgs),
hits as (select distinct m.message_id, p.product_id, p.name from terms m join products p on p.is_active and contains(lower(p.name), m.term)),
ranked as (select *, row_number() over (partition by message_id order by name, product_id) as rank from hits),
ent as (select * from ranked where rank <= 5 union all
  select message_id, product_id, name, row_number() over (partition by message_id order by name, product_id) from (
    select distinct m.message_id, p.product_id, p.name from (select message_id, unnest(context_ids) as c from msgs where message_id not in (select message_id from ranked)) m join products p on p.is_active and regexp_full_match(m.c, '[0-9]+') and p.product_id = try_cast(m.c as bigint)))
"""


def _asked(spark, d):
    p = t.products(spark, d)
    word = lambda k: F.split_part("name", F.lit(" "), F.lit(k))
    named = F.concat(F.lit("what of the "), word(1), F.when(F.col("product_id") % 2 == 0, F.concat(F.lit(" "), word(2))).otherwise(""))
    tail = F.element_at(F.array(*(F.lit(x) for x in (" vs ", " history ", " buy now ", " suggest ", " alert 12,500.50", " cheapest ", ""))), (F.col("product_id") % 7 + 1).cast("int"))
    text_ = F.concat(F.when(F.col("product_id") % 5 == 0, "show me the price").otherwise(named), tail)
    ids = F.array(F.col("product_id").cast("string"), F.lit("x1"), (F.col("product_id") + 1).cast("string"))
    m = p.select(F.col("product_id").alias("message_id"), text_.alias("text"), ids.alias("context_ids"))
    return m, assistant.resolved(m, assistant.entities(m, p), p)


@query(ASKED + "select message_id, cast(rank as integer) as rank, product_id, name from ent")
def assistant_entities(spark, d):
    return _asked(spark, d)[1]


SIGNAL_SQL = "case coalesce(ps.suggestion, gd.suggestion, 'insufficient_data') " + " ".join(f"when '{k}' then '{v}'" for k, v in assistant.SIGNALS.items()) + " end"
ANSWER_SQL = "case " + " ".join(f"when {' or '.join(f'contains(x, {chr(39)}{p}{chr(39)})' for p in phrases)} then '{name}'" for name, phrases in assistant.INTENTS) + " else 'product_search' end"


@query(ASKED + GUIDE + MINE + PERSONAL + f""", i as (select message_id, {ANSWER_SQL} as intent from (select message_id, ' ' || lower(trim(text)) || ' ' as x from msgs)),
fl as (select product_id, min(case when is_available then current_price end) as lowest, count(*) as listings from listings group by 1),
fh as (select product_id, min(price) as low, count(*) as points from points group by 1),
al as (select distinct product_id from alerts where is_active),
sim as (select product_id, string_agg(other, ', ' order by rank) as others from (
  select a.product_id, b.name as other, row_number() over (partition by a.product_id order by case when a.brand = b.brand then 1 else 2 end, b.name, b.product_id) as rank
  from products a join products b on a.category = b.category and a.product_id <> b.product_id where a.is_active and b.is_active) where rank <= 4 group by 1),
per as (select message_id, count(*) as n, min(product_id) filter (rank = 1) as product_id, min(e.name) filter (rank = 1) as name, string_agg(e.name, ', ' order by rank) as names from ent e group by 1),
cmp as (select message_id, first(name order by lowest, rank) as best, min(lowest) as lo, max(lowest) as hi from (select e.*, fl.lowest from ent e join fl on e.product_id = fl.product_id where rank <= 3 and lowest is not null) group by 1)
select i.message_id, i.intent, case when per.product_id is null then 'No active product matches.'
  when i.intent = 'comparison' then case when per.n < 2 then 'Only one product was found. Name a second one to compare.' when cmp.best is null then 'None of these products has an available offer.'
    else cmp.best || ' has the lowest offer, PKR ' || {d2('cmp.lo')} || '; the gap is PKR ' || {d2('cmp.hi - cmp.lo')} || '.' end
  when i.intent = 'price_history' then per.name || ' has ' || coalesce(points, 0) || ' stored prices of ' || coalesce(listings, 0) || ' listings; the low is ' || coalesce('PKR ' || {d2('fh.low')}, 'not available') || '.'
  when i.intent = 'recommendation' then case when others is null then 'No alternatives to ' || per.name || ' are stored.' else 'Alternatives to ' || per.name || ': ' || others || '.' end
  when i.intent = 'set_price_alert' then case when al.product_id is not null then 'An active alert for ' || per.name || ' exists.' else 'Alert for ' || per.name || ' at PKR 12500.50.' end
  when i.intent = 'lowest_price' then case when lowest is null then 'No available offer of ' || per.name || ' is stored.' else 'The lowest offer of ' || per.name || ' is PKR ' || {d2('lowest')} || '.' end
  when i.intent = 'buy_or_wait' then {SIGNAL_SQL} || ' for ' || per.name || case when ps.product_id is null then '. Create a price alert to personalize this signal' else '. Your saved price target is applied' end || '. Confidence is ' || coalesce(gd.confidence, 'low') || '.'
  else 'Found ' || names || '.' end as answer
from i left join per on i.message_id = per.message_id left join cmp on i.message_id = cmp.message_id left join fl on per.product_id = fl.product_id left join fh on per.product_id = fh.product_id
  left join al on per.product_id = al.product_id left join sim on per.product_id = sim.product_id left join gd on per.product_id = gd.product_id left join ps on per.product_id = ps.product_id""")
def assistant_answers(spark, d):
    m, found = _asked(spark, d)
    p, listings, points = t.products(spark, d), t.listings(spark, d), t.points(spark, d)
    facts = listings.groupBy("product_id").agg(F.min(F.when(F.col("is_available"), F.col("current_price"))).alias("lowest"), F.count(F.lit(1)).alias("listings"))
    facts = facts.join(points.groupBy("product_id").agg(F.min("price").alias("low"), F.count(F.lit(1)).alias("points")), "product_id", "full")
    general = prices.guidance(points, t.latest(points, "product_id"))
    own = prices.personalise(general, my_alerts(spark, d), listings).select("product_id", F.col("suggestion").alias("own"))
    guided = general.join(own, "product_id", "left").select("product_id", F.coalesce("own", "suggestion").alias("suggestion"), "confidence", F.col("own").isNotNull().alias("personal"))
    others = catalog.similar(p).join(p.select(F.col("product_id").alias("other_id"), F.col("name").alias("other")), "other_id").select("product_id", "rank", "other")
    return assistant.answers(m, found, facts.join(guided, "product_id", "left"), others, t.alerts(spark, d).filter("is_active"))


@query(ASKED + f""", c as (select message_id % 50 as conv_id, case when message_id % 50 % 2 = 0 then 'New shopping conversation' else 'Mine' end as title from msgs group by all),
mm as (select m.message_id % 50 as conv_id, m.message_id, m.text, {ANSWER_SQL.replace('contains(x,', "contains(' ' || lower(trim(m.text)) || ' ',")} as intent,
  (select min(name) from ent e where e.message_id = m.message_id and rank = 1) as name, (select string_agg(product_id, ',' order by rank) from ent e where e.message_id = m.message_id) as ids from msgs m),
g as (select conv_id, first(coalesce(name, left(text, 80)) order by message_id) as t, last(coalesce(ids, '') order by message_id) as ids, last(intent order by message_id) as intent from mm group by 1)
select c.conv_id, case when title like 'New%' then t else title end as title, ids as product_ids, intent as last_intent, 'kept' as budget from c join g on c.conv_id = g.conv_id""")
def assistant_turns(spark, d):
    m, found = _asked(spark, d)
    m = m.withColumn("conv_id", F.col("message_id") % 50)
    context = F.create_map(F.lit("budget"), F.lit("kept"), F.lit("last_intent"), F.lit("old"))
    c = m.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 2 == 0, "New shopping conversation").otherwise("Mine").alias("title"), context.alias("context"))
    done = assistant.turns(c, m, found)
    return done.select("conv_id", "title", *(F.col("context")[k].alias(k) for k in ("product_ids", "last_intent", "budget")))


@query(r"""select c_custkey, array_to_string(list_transform(string_split(replace(c_mktsegment || '_rate_x', '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as label,
  case when n >= 1000000 then format('{:.1f}M', n / 1e6) when n >= 1000 then cast(floor(n / 1e3 + 0.5) as bigint) || 'K' else regexp_replace(cast(n as varchar), '\.0$', '') end as short,
  left(c_name, 255) as file, c_name[:120] as cut from (select *, cast(c_custkey * c_custkey * 7 as double) as n from customer)""", adapters=False)
def display_labels(spark, d):
    c = t.parquet(spark, d, "customer")
    n = F.col("c_custkey") * F.col("c_custkey") * 7
    return c.select("c_custkey", text.label(F.concat("c_mktsegment", F.lit("_rate_x"))).alias("label"), text.compact_number(n).alias("short"), text.file_name(F.concat(F.lit("up/load/"), "c_name", F.lit(" "))).alias("file"), F.left("c_name", F.lit(120)).alias("cut"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then cast(cast(o_totalprice as decimal(14,2)) as decimal(18,2)) else nullif(cast(o_custkey as decimal(18,2)), 0) end as target,
  case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) else '' end as ids from orders""", adapters=False)
def target_prices(spark, d):
    o = t.parquet(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, "alert me").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("item 7 at Rs. "), F.format_number(F.col("o_totalprice").cast("decimal(14,2)"), 2)))
    said = said.otherwise(F.concat(F.lit("from 12 down to pkr"), F.col("o_custkey").cast("string"), F.lit(" please")))
    ids = text.whole_ids(F.array(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("1x"), F.lit("-4"), F.lit("")))
    return o.select("o_orderkey", text.target_price(said).alias("target"), F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query("select p_partkey, case when p_partkey % 2 = 0 then p_size || 'GB RAM, 256GB' else '' end as variant from part", adapters=False)
def variant_pattern(spark, d):
    p = t.parquet(spark, d, "part")
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (dual) ("), F.col("p_size").cast("string"), F.lit("GB RAM, 256GB) Rs 9"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.variant(title).alias("variant"))


@query("select conv_id, turn, last_value(case when length(text) % 3 = 0 then length(text) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as context from conversations", adapters=False)
def assistant_context(spark, d):
    c = t.parquet(spark, d, "conversations").withColumn("named", F.when(F.length("text") % 3 == 0, F.length("text")).cast("long"))
    return assistant.carry_context(c, "named").select("conv_id", "turn", "context")


@query()
def match_products(spark, d):
    """Every product as an item: even ones name their model in the title, a third send no brand."""
    p = t.products(spark, d).withColumn("model", F.concat(F.lit("mx"), F.col("product_id") % 1000))
    title = F.concat_ws(" ", "name", "brand", F.when(F.col("product_id") % 2 == 0, F.col("model")), F.concat(F.col("storage_gb").cast("string"), F.lit("gb")))
    items = p.select(F.col("product_id").alias("item_id"), title.alias("title"), F.when(F.col("product_id") % 3 != 0, F.col("brand")).alias("brand"))
    return matching.match(items, p.filter("is_active").select("product_id", "name", "brand", "model", "storage_gb"))


@query("select event_id, user_id from events where event_type = 'error' and event_id % 3 <> 0 order by ts desc, event_id desc limit 50 offset 50", adapters=False)
def notifications_page(spark, d):
    e = t.parquet(spark, d, "events").filter("event_type = 'error' and event_id % 3 <> 0")
    return catalog.page(e, [F.col("ts").desc(), F.col("event_id").desc()], 2, 50).select("event_id", "user_id")


@query("select user_id, count(*) as total, count(*) filter (event_id % 3 <> 0) as unread from events where event_type = 'error' group by 1", adapters=False)
def unread_counts(spark, d):
    e = t.parquet(spark, d, "events").filter("event_type = 'error'")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_id") % 3 != 0).alias("unread"))


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 4", adapters=False)
def recent_alerts(spark, d):
    return catalog.page(t.parquet(spark, d, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 1, 4).select("event_id", "user_id", "event_type")


@query("select p.product_id, count(*) as candidates from products p join products q on lower(p.brand) = lower(q.brand) and q.is_active group by 1")
def brand_blocked_candidates(spark, d):
    p = t.products(spark, d)
    per_brand = p.filter("is_active").groupBy(F.lower("brand").alias("b")).agg(F.count(F.lit(1)).alias("candidates"))
    return p.join(per_brand, F.lower("brand") == F.col("b")).select("product_id", "candidates")


@query("select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 0 as allowed from customer", adapters=False)
def role_access(spark, d):
    c = t.parquet(spark, d, "customer")
    disjoint = ~F.arrays_overlap(F.array("c_mktsegment"), F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    return c.select("c_custkey", (~disjoint & (F.col("c_acctbal") >= 0)).alias("allowed"))


@query("select alert_id, case when on_product then 'Product ' else 'Listing ' end || product_id || ': target PKR ' || format('{:,.2f}', cast(target_price as double)) as message from alerts where is_active")
def alert_messages(spark, d):
    a = t.alerts(spark, d).filter("is_active")
    return a.select("alert_id", F.concat(F.when(F.col("on_product"), "Product ").otherwise("Listing "), F.col("product_id").cast("string"), F.lit(": target PKR "), F.format_number("target_price", 2)).alias("message"))


@query("select product_id, seller_id, extra from (select c_mktsegment as seller_id, c_nationkey as product_id, count(*) - 1 as extra from customer where c_acctbal > 0 group by all) where extra > 0", adapters=False)
def alert_duplicates(spark, d):
    c = t.parquet(spark, d, "customer").select(F.col("c_nationkey").alias("product_id"), F.col("c_mktsegment").alias("seller_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return alerts.duplicates(c)


@query("""select 'price_non_negative' as rule, count(*) filter (price < 0) as failures from points
union all select 'capture_once', (select coalesce(sum(n - 1), 0) from (select count(*) as n from points group by product_id, seller_id, captured_at))
union all select 'current_price_non_negative', (select count(*) filter (current_price < 0) from listings)
union all select 'rating_range', (select count(*) filter (not rating between 0 and 50) from sellers)
union all select 'source_row_positive', (select count(*) filter (source_row < 1) from sales) union all select 'quantity_positive', (select count(*) filter (quantity <= 0) from sales) union all select 'revenue_non_negative', (select count(*) filter (revenue < 0) from sales)
union all select 'one_target', (select count(*) filter (not (on_product and seller_id is null or not on_product and seller_id is not null)) from alerts) union all select 'target_positive', (select count(*) filter (target_price <= 0) from alerts)
union all select 'ram_positive', (select count(*) filter (storage_gb <= 0) from products) union all select 'selling_price_non_negative', (select count(*) filter (selling_price < 0) from own) union all select 'stock_non_negative', (select count(*) filter (stock < 0) from own)""")
def dq_violations(spark, d):
    """The tables' constraints: a null passes a check, and a key held n times breaks uniqueness n - 1 times."""
    col = F.col
    checks = [
        (t.points(spark, d), {"price_non_negative": col("price") >= 0}),
        (t.listings(spark, d), {"current_price_non_negative": col("current_price") >= 0}),
        (t.sellers(spark, d), {"rating_range": col("rating").between(0, 50)}),
        (t.sales(spark, d), {"source_row_positive": col("source_row") >= 1, "quantity_positive": col("quantity") > 0, "revenue_non_negative": col("revenue") >= 0}),
        (t.alerts(spark, d), {"one_target": col("on_product") == col("seller_id").isNull(), "target_positive": col("target_price") > 0}),
        (t.products(spark, d), {"ram_positive": col("storage_gb") > 0}),
        (t.own_products(spark, d), {"selling_price_non_negative": col("selling_price") >= 0, "stock_non_negative": col("stock") >= 0}),
    ]
    broken = [merge.violations(df, {k: F.coalesce(v, F.lit(True)) for k, v in rules.items()}) for df, rules in checks]
    return reduce(DataFrame.unionByName, [*broken, merge.repeats(t.points(spark, d), ["product_id", "seller_id", "captured_at"], "capture_once")])


@query(f""", nw as (select product_id, seller_id, current_price + 1 as current_price, last_seen_at as seen from listings where product_id % 3 = 0
union all select product_id + 1000000, seller_id, current_price, last_seen_at from listings where product_id % 3 = 1)
select product_id, seller_id, {d2("coalesce(nw.current_price, l.current_price)")} as current_price, cast(coalesce(l.first_seen_at, nw.seen) as date) as first_seen,
  case when l.current_price is null then 'inserted' when nw.current_price is null then 'kept' else 'updated' end as action from listings l full join nw using (product_id, seller_id)""")
def upsert_listings(spark, d):
    old = t.listings(spark, d).select("product_id", "seller_id", "current_price", "first_seen_at")
    full = t.listings(spark, d)
    new = full.filter("product_id % 3 = 0").select("product_id", "seller_id", (F.col("current_price") + 1).cast("decimal(14,2)").alias("current_price"), F.col("last_seen_at").alias("first_seen_at"))
    more = full.filter("product_id % 3 = 1").select((F.col("product_id") + 1000000).alias("product_id"), "seller_id", "current_price", F.col("last_seen_at").alias("first_seen_at"))
    out = merge.upsert(old, new.unionByName(more), ["product_id", "seller_id"], keep=["first_seen_at"])
    return out.select("product_id", "seller_id", F.col("current_price").cast("decimal(18,2)").alias("current_price"), F.to_date("first_seen_at").alias("first_seen"), "action")


@query("select n_name as slug from nation where not exists (select 1 from nation e where e.n_nationkey % 2 = 0 and e.n_name = nation.n_name)", adapters=False)
def seed_insert_missing(spark, d):
    n = t.parquet(spark, d, "nation").select(F.col("n_name").alias("slug"), "n_nationkey")
    return merge.missing(n, n.filter("n_nationkey % 2 = 0").select("slug"), ["slug"]).select("slug")


@query("select c_custkey, min(s_suppkey) as seller_id from customer left join supplier on lower(trim(s_name)) = lower(trim(' SUPPLIER#' || lpad(cast(c_custkey % 150 as varchar), 9, '0'))) group by 1", adapters=False)
def seller_resolve(spark, d):
    c, s = t.parquet(spark, d, "customer"), t.parquet(spark, d, "supplier")
    a = c.select("c_custkey", F.lower(F.trim(F.concat(F.lit(" SUPPLIER#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")))).alias("k"))
    b = s.groupBy(F.lower(F.trim("s_name")).alias("k")).agg(F.min("s_suppkey").alias("seller_id"))
    return a.join(b, "k", "left").select("c_custkey", "seller_id")
