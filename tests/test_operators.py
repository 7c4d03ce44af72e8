"""Operators on small tables made here."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marketglass.functions import money, text
from marketglass.operators import catalog, competitors, matching, merge, prices, sales
from marketglass.sources import market, tables
from marketglass.streaming import captures


def one(spark, **columns):
    df = spark.range(1)
    return df.select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("title", "ram", "storage"), [("Phone 8GB RAM 256GB", 8, 256), ("Phone 6gb/128gb", 6, 128), ("Tab 1TB", None, 1024), ("Laptop 16 GB RAM 512 GB ROM", 16, 512), ("cable", None, None), ("32gb stick", 32, None)])
def test_memory(spark, title, ram, storage):
    a, b = text.memory(F.lit(title))
    assert tuple(one(spark, a=a, b=b)) == (ram, storage)


@pytest.mark.parametrize(("a", "b"), [("galaxy s24 ultra", "galaxy s23"), ("", "x"), ("same", "same"), ("abcd", "bcde"), ("pro max", "max pro")])
def test_similarity_is_the_matching_blocks_ratio(spark, a, b):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([(a, b)], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s"))
    assert df.first().s == pytest.approx(SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


def test_text(spark):
    df = spark.createDataFrame([("Café Ünïque  X-1",), (None,), ("///",)], "s string")
    assert [r.n for r in df.select(text.normalize(F.col("s")).alias("n")).collect()] == ["cafe unique x 1", "", ""]
    r = one(spark, p=text.price_number(F.lit("Rs 1,234.50")), q=text.price_number(F.lit("n/a")), z=text.price_number(F.lit("1.2.3")), s=text.spreadsheet_safe(F.lit("=1+1")), k=text.sku(F.lit("  ")), b=text.slug_base(F.lit("!!")))
    assert tuple(r) == (1234.5, 0.0, 0.0, "'=1+1", None, "organization")


@pytest.mark.parametrize(("raw", "want"), [("12.34", D("12.34")), ("12.345", None), ("-1", None), ("abc", None), (" 7 ", D("7.00")), ("", None), (None, None)])
def test_price(spark, raw, want):
    assert one(spark, p=money.parsed_price(F.lit(raw).cast("string"))).p == want


@pytest.mark.parametrize(("raw", "ok"), [("2024-02-29", True), ("2023-02-29", False), ("2024-1-5", False), ("2026", False), (None, False)])
def test_date(spark, raw, ok):
    assert (one(spark, x=money.parsed_date(F.lit(raw).cast("string"))).x is not None) == ok


def test_rounding(spark):
    r = one(spark, up=money.half_up(F.lit("2.345").cast("decimal(10,3)")), even=money.half_even(F.lit("2.345").cast("decimal(10,3)")), none=money.percent(F.lit(1), F.lit(0)))
    assert tuple(r) == (D("2.35"), D("2.34"), None)


def test_sales_golden(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 2, D("200.00")), (1, "2024-01-02", 1, D("100.00")), (2, "2024-01-02", 3, D("200.00"))], "product_id long, sale_date string, quantity int, revenue decimal(14,2)")
    r = sales.summary(df).first()
    assert (r.revenue, r.units, r.records, r.products, r.asp) == (D("500.00"), 6, 3, 2, D("83.33"))
    empty = sales.summary(df.limit(0)).first()
    assert (empty.revenue, empty.units, empty.asp) == (D("0.00"), 0, D("0.00"))


def test_csv_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SKU,sale_date,quantity,unit_price\n"a\nb",2024-01-01,2,10.00\n,,,\nx,01/02/2024,1.5,-3\n')
    got = sales.validate(sales.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert [r.errors for r in got] == ["", "sale_date,quantity,unit_price"] and got[0].v_currency == "PKR"
    for bad in (["sku", "sku", "sale_date", "quantity", "unit_price"], ["sku"], ["sku", "sale_date", "quantity", "unit_price", "extra"]):
        with pytest.raises(ValueError, match="headers"):
            sales.check_headers(bad)


def test_guidance_rules(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    points = [(1, 1, day(n), 0, n, D("100.00"), True) for n in range(6)] + [(2, 1, day(n), 0, n, D("100.00") if n else D("90.00"), True) for n in range(6)] + [(3, 1, day(0), 0, 0, D("1.00"), False)]
    p = spark.createDataFrame(points, "product_id long, seller_id long, captured_at timestamp, ord long, line long, price decimal(14,2), is_available boolean")
    now = spark.createDataFrame([(1, D("102.00")), (2, D("105.00")), (3, D("1.00"))], "product_id long, current_price decimal(14,2)")
    got = {r.product_id: (r.suggestion, r.coverage_days) for r in prices.guidance(p, now).collect()}
    assert got == {1: ("buy_now", 6), 2: ("wait", 6), 3: ("insufficient_data", 0)}


def test_inverted_ranges_are_refused(spark, folder):
    with pytest.raises(ValueError):
        prices.between(tables.points(spark, folder), "2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        catalog.search(tables.products(spark, folder), None, min_price=2, max_price=1)
    with pytest.raises(ValueError):
        catalog.page(tables.products(spark, folder), [F.col("name")], 0, 10)
    with pytest.raises(ValueError):
        prices.compare(None, None, [1, 1])


def test_gap_against_a_free_listing(spark):
    df = spark.createDataFrame([(D("5.00"), D("0.00")), (None, D("2.00")), (D("2.00"), D("2.00"))], "own decimal(14,2), other decimal(14,2)")
    gap, pct, position, risk = competitors.level(F.col("own"), F.col("other"), 5.0)
    assert [tuple(r) for r in df.select(pct, position, risk).collect()] == [(None, "above_competitor", "medium"), (None, "unknown", "medium"), (D("0.00"), "matched", "low")]


def test_matching(spark):
    variants = spark.createDataFrame([(1, "galaxy s24 ultra", "Samsung", 256), (2, "galaxy s24 ultra", "Samsung", 512), (3, "iphone 15", "Apple", 128)], "product_id long, name string, brand string, storage_gb int")
    items = spark.createDataFrame([(1, "Samsung Galaxy S24 Ultra 12gb ram 256gb", "samsung"), (2, "Apple iPhone 15 128GB", "apple"), (3, "garden hose", None), (4, "Galaxy S24 Ultra", "samsung")], "item_id long, title string, brand string")
    got = {r.item_id: (r.product_id, r.status) for r in matching.match(items, variants).collect()}
    assert got == {1: (1, "matched"), 2: (3, "matched"), 3: (None, "unmatched"), 4: (1, "ambiguous")}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, first int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "k long, v string, first int")
    got = sorted(map(tuple, merge.upsert(old, new, ["k"], ["first"]).collect()))
    assert got == [(1, "a", 10, "kept"), (2, "B", 20, "updated"), (3, "c", 30, "inserted")]
    good, bad = merge.split_quarantine(old, {"small": F.col("first") < 15})
    assert good.count() == 1 and bad.first().broken == ["small"]


def test_market_pages(spark, tmp_path):
    for n in (1, 2):
        items = [{"itemId": f"{n}-{k}", "name": "x", "price": "Rs 10"} for k in range(3)]
        (tmp_path / f"{n}.json").write_text(json.dumps({"mods": {"listItems": items}, "mainInfo": {"totalResults": 6, "pageSize": 3}}))
    spark.dataSource.register(market.MarketPages)
    df = spark.read.format("market_pages").option("address", f"file://{tmp_path}/{{page}}.json").option("pages", 3).load()
    assert sorted(r.page for r in df.filter("error is null").collect()) == [1, 2]
    items = tables.market_items(df.filter("body is not null"))
    assert items.count() == 6 and items.first().pages == 3


def test_exports(spark, tmp_path):
    market.export_report(spark.createDataFrame([("=a", 1), ("b", 2)], "s string, n int"), str(tmp_path / "r"))
    assert sorted(r.s for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()) == ["'=a", "b"]
    market.append(spark.range(2), str(tmp_path / "h"))
    market.append(spark.range(3), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 5


def test_captures_json(spark, tmp_path):
    good = {"platform": "p", "external_id": "1", "product_id": 1, "seller_name": "s", "price": 12.5, "currency": "PKR", "is_available": True, "scraped_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps(good) + "\nnot json\n")
    got = tables.captures_json(spark, str(tmp_path))
    assert got.count() == 2 and got.filter("external_id is not null").first().price == D("12.50")


def test_stream_fires_once_over_restarts(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    import datetime as dt

    def put(name, rows):
        full = [(i, dt.datetime(2024, 1, 1, 0, i), u, "view", float(v), None) for i, u, v in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    source = str(tmp_path / "in" / "[ab]")
    put("a", [(1, 7, 9), (2, 7, 4), (3, 8, 9)])
    read = lambda: spark.readStream.schema(schema).parquet(source)
    first = captures.run_available(captures.fire_once(read(), 5), folder=str(tmp_path / "w"))
    assert [tuple(r) for r in first.collect()] == [(7, 2, 4.0)]
    put("b", [(4, 7, 3), (5, 8, 2)])
    both = captures.run_available(captures.fire_once(read(), 5), folder=str(tmp_path / "w"))
    assert sorted(map(tuple, both.collect())) == [(7, 2, 4.0), (8, 5, 2.0)]


def test_stream_buckets(spark, folder):
    out = captures.run_available(captures.buckets(captures.read(spark, f"{folder}/events.parquet")), "complete")
    assert sum(r.n for r in out.collect()) == spark.read.parquet(f"{folder}/events.parquet").count()


def test_shares_half_between_two_basis_points_equal_their_sql(spark):
    import duckdb

    from marketglass.operators import competitors
    from marketglass.plans.business_queries import SHARES

    # Own price d - k and another's k give the share k / d; these denominators fall half between basis points.
    cents = [((d - k) * m, k * m) for d in (32, 160, 800, 4000, 20000) for k in range(1, d, 2 + d // 32 * 2) for m in (1, 7, 30)]
    cents += [(1, 99_999_999_999), (99_999_999_999, 1), (0, 5), (5, 0)]
    duck = duckdb.connect()
    duck.execute("create table own (product_id bigint, selling_price decimal(14,2)); create table listings (product_id bigint, seller_id bigint, current_price decimal(14,2)); create table watch as select 1 as org_id, n as product_id, 2 as seller_id from range(%d) r(n)" % len(cents))
    for n, (a, b) in enumerate(cents):
        duck.execute(f"insert into own values ({n}, {a / 100:.2f}); insert into listings values ({n}, 2, {b / 100:.2f})")
    money = lambda column: F.col(column).cast("decimal(14,2)").alias(column)
    own = spark.createDataFrame([(n, f"{a / 100:.2f}") for n, (a, b) in enumerate(cents)], "product_id long, selling_price string").select("product_id", money("selling_price"))
    listings = spark.createDataFrame([(n, 2, f"{b / 100:.2f}") for n, (a, b) in enumerate(cents)], "product_id long, seller_id long, current_price string").select("product_id", "seller_id", money("current_price"))
    watch = spark.createDataFrame([(1, n, 2) for n in range(len(cents))], "org_id long, product_id long, seller_id long")
    got = {r.product_id: r.share_bp for r in competitors.market_share(watch, own, listings).collect()}
    assert got == {p: s for _, p, s in duck.execute(SHARES).fetchall()}
    assert all(got[n] == (20_000 * b + a + b) // (2 * (a + b)) for n, (a, b) in enumerate(cents) if a and b)


def test_upsert_of_ids_beyond_a_million_equals_its_sql(spark, folder, tmp_path):
    """Products whose ids differ by the query's million: the capture that would be inserted updates a listing that is there."""
    import duckdb

    from marketglass import plans

    duck, lines = duckdb.connect(), f"{folder}/lineitem.parquet"
    duck.execute(f"create view lineitem as select * from '{lines}' union all select * replace (l_partkey + 1000000 as l_partkey) from '{lines}' where l_partkey % 2 = 0")
    (tmp_path / "lineitem.parquet").mkdir()
    duck.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet/a.parquet' (format parquet)")
    for t in ("part", "supplier", "nation", "region", "customer", "orders"):
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    names = ["product_id", "seller_id", "current_price", "first_seen", "action"]
    want = duck.execute(f"select {', '.join(names)} from ({plans.SQL['upsert_listings']})").fetchall()
    got = [tuple(r) for r in plans.QUERIES["upsert_listings"](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got) == sorted(want)
    assert any(p > 1000000 and action == "updated" for p, *_, action in got)


def test_similar_products_rank_no_product_by_itself(spark):
    """Firsts are chosen by category and brand, so nothing is sorted by product; one without a brand takes its category's first."""
    rows = [(k, f"n{k:02}", (None, "a", "b")[k % 3], "c", True) for k in range(30)]
    found = catalog.similar(spark.createDataFrame(rows, "product_id long, name string, brand string, category string, is_active boolean"))
    assert "windowspecdefinition(product_id" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.product_id, r["rank"]): (r.other_id, r.same) for r in found.collect()}
    for p, name, brand, *_ in rows:
        order = sorted((0 if brand is None or b is None else 1 if b == brand else 2, n, q) for q, n, b, *_ in rows if q != p)[:4]
        assert [got[p, k + 1][0] for k in range(4)] == [q for *_, q in order]
