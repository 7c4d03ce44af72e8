"""Rules of guidance, comparison, state changes, sources and sinks, case by case."""

import datetime
import json
import threading
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from marketglass.functions import text
from marketglass.operators import assistant, catalog, prices, sales, state
from marketglass.sources import market, tables
from marketglass.streaming import captures

LISTING = "product_id long, seller_id long, current_price decimal(14,2), is_available boolean"


def D(x):
    return Decimal(str(x))


def test_comparison(spark):
    products = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "product_id long, name string")
    rows = [(1, 1, D(100), True), (1, 2, D(90), False), (2, 1, D(100), True), (3, 1, D(150), True), (4, 1, D(50), False)]
    listings = spark.createDataFrame(rows, LISTING)
    r = prices.compare(products, listings, [2, 1, 3]).first()
    # A tie goes to the first named; the gap is in percent of the cheapest.
    assert (r.cheapest_id, r.cheapest_price, r.gap, r.gap_pct) == (2, D("100.00"), D("50.00"), D("50.00"))
    r = prices.compare(products, listings, [3, 4]).first()
    assert (r.cheapest_id, r.gap, r.gap_pct) == (3, None, None)
    money = listings.withColumn("currency", F.when(F.col("product_id") == 3, "USD").otherwise("PKR"))
    assert prices.compare(products, money, [1, 3]).count() == 0
    assert prices.compare(products, money, [1, 2]).first().currency == "PKR"
    assert prices.compare(products, listings, [1, 99]).count() == 0
    with pytest.raises(ValueError):
        prices.compare(products, listings, [1, 1])


def test_personal_guidance(spark):
    guided = spark.createDataFrame([(k, D(80)) for k in (1, 2, 3, 4)], "product_id long, current_lowest decimal(18,2)")
    listings = spark.createDataFrame([(1, 1, D(80), True), (2, 1, D(95), True), (2, 2, D(80), False), (3, 1, D(90), False)], LISTING)
    alerts = spark.createDataFrame(
        [(1, 1, None, True, D(85), True), (2, 1, 1, False, D(10), True), (3, 2, 1, False, D(90), True), (4, 2, 2, False, D(99), True), (5, 3, 1, False, D(99), True), (6, 4, None, True, D(99), False)],
        "alert_id long, product_id long, seller_id long, on_product boolean, target_price decimal(14,2), is_active boolean",
    )
    got = {r.product_id: r for r in prices.personalise(guided, alerts, listings).collect()}
    assert (got[1].alert_id, got[1].suggestion, got[1].gap) == (1, "buy_now", D("0.00"))
    # The newest alert's listing is unavailable, so the older one's counts, with that listing's own price.
    assert (got[2].alert_id, got[2].evaluated, got[2].gap, got[2].gap_pct, got[2].suggestion) == (3, D("95.00"), D("5.00"), D("5.56"), "wait")
    assert (got[3].evaluated, got[3].gap, got[3].reached, got[3].suggestion) == (None, None, None, "insufficient_data")
    assert 4 not in got


def test_publishing_refuses_older_documents(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    held = spark.createDataFrame([(1, day(5))], "variant_id long, generated_at timestamp")
    sent = spark.createDataFrame([(1, 10, day(5)), (1, 11, day(7)), (1, 12, day(6)), (1, 13, day(9)), (2, 14, day(1)), (2, 15, day(1))], "variant_id long, forecast_id long, generated_at timestamp")
    assert {r.forecast_id: r.outcome for r in prices.publish(held, sent).collect()} == {10: "rejected", 11: "superseded", 12: "rejected", 13: "published", 14: "published", 15: "rejected"}


def test_forecast_contract(spark, tmp_path):
    point = lambda d, p=1: {"at": f"2024-02-{d:02d}T00:00:00Z", "price": p}
    docs = {"good": ([1, 2, 3], 3), "unsorted": ([2, 1, 3], 3), "short": ([1, 2], 3), "repeated": ([1, 1, 2], 3)}
    for k, (name, (days, horizon)) in enumerate(docs.items()):
        (tmp_path / f"{name}.json").write_text(json.dumps({"variant_id": k, "generated_at": "2024-01-31T00:00:00Z", "horizon": horizon, "points": [point(d) for d in days]}))
    (tmp_path / "past.json").write_text(json.dumps({"variant_id": 9, "generated_at": "2024-02-02T00:00:00Z", "horizon": 1, "points": [point(1)]}))
    got = {r.variant_id: r.broken for r in prices.contract_breaches(tables.forecast_documents(spark, str(tmp_path))).collect()}
    assert got == {0: [], 1: ["order"], 2: ["horizon"], 3: ["repeats"], 9: ["future"]}


def test_captures_in_quarantine(spark, tmp_path):
    good = {"capture_id": 1, "platform": "p", "title": "t", "price": "10.50", "currency": "PKR", "scraped_at": "2024-01-02T03:04:05+05:00"}
    bad = [dict(good, capture_id=2, scraped_at="2024-01-02T03:04:05"), dict(good, capture_id=3, price="-1"), dict(good, capture_id=4, price="1.005", title=" "), {"capture_id": 5}]
    (tmp_path / "in.json").write_text("\n".join(json.dumps(x) for x in [good, *bad]))
    kept, broken = tables.sent_captures(spark, str(tmp_path))
    assert [r.capture_id for r in kept.collect()] == [1]
    got = {r.capture_id: r.broken for r in broken.collect()}
    assert got == {2: ["offset"], 3: ["price"], 4: ["title", "price"], 5: ["platform", "title", "price", "currency", "offset", "time"]}
    _, stream = tables.sent_captures(spark, str(tmp_path), stream=True)
    assert captures.run_available(stream).count() == 4


def test_similar_products_without_a_brand(spark):
    p = spark.createDataFrame([(1, "a", "x", "c"), (2, "b", None, "c"), (3, "d", "x", "c"), (4, "e", None, "c"), (5, "f", "y", "c")], "product_id long, name string, brand string, category string").withColumn("is_active", F.lit(True))
    got = {}
    for r in sorted(catalog.similar(p).collect(), key=lambda r: (r.product_id, r.rank)):
        got.setdefault(r.product_id, []).append(r.other_id)
    assert got == {1: [2, 4, 3, 5], 2: [1, 3, 4, 5], 3: [2, 4, 1, 5], 4: [1, 2, 3, 5], 5: [2, 4, 1, 3]}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.slug_base(F.lit("  Café Ünïon & Söhne "))) == "cafe-union-sohne" and one(text.slug_base(F.lit("!!"))) == "organization"
    assert one(text.target_price(F.lit("from 12 to PKR 110,000.50 please"))) == D("110000.50") and one(text.target_price(F.lit("none"))) is None and one(text.target_price(F.lit("rs 0"))) is None
    assert one(text.whole_ids(F.array(F.lit("12"), F.lit("x"), F.lit("-1"), F.lit("9" * 30)))) == [12]
    assert one(text.label(F.lit("ram_size in_gb"))) == "Ram Size In Gb"
    assert [one(text.compact_number(F.lit(x))) for x in (1_250_000.0, 12_500.0, 999.0, 12.5, None)] == ["1.3M", "13K", "999", "12.5", ""]
    assert [one(text.file_name(F.lit(x))) for x in ("/a/b/c.csv", "", None, "x" * 300)] == ["c.csv", "sales-import.csv", "sales-import.csv", "x" * 255]
    assert one(text.variant(F.lit("Phone (dual) (8GB RAM, 256GB)"))) == "8GB RAM, 256GB"


def test_import_files_have_bounds(spark, tmp_path):
    head = "sku,sale_date,quantity,unit_price\n"
    small = tmp_path / "small.csv"
    small.write_text("﻿" + head + "a,2024-01-01,1,2\n,,,\nb,2024-01-02,3,4\n")
    assert [(r.sku, r.source_row) for r in sales.read_csv(spark, str(small)).collect()] == [("a", 2), ("b", 4)]
    many = tmp_path / "many.csv"
    many.write_text(head + "a,2024-01-01,1,2\n" * 5001)
    with pytest.raises(ValueError, match="rows"):
        sales.read_csv(spark, str(many))
    large = tmp_path / "large.csv"
    large.write_text(head + "a" * (2 * 1024 * 1024))
    with pytest.raises(ValueError, match="bytes"):
        sales.read_csv(spark, str(large))


class Answers(BaseHTTPRequestHandler):
    bodies: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(500 if body["n"] == 2 else 200)
        self.end_headers()
        Answers.bodies.append(body["n"])

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"mainInfo": {"totalResults": 85, "pageSize": 40}, "mods": {"listItems": []}}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def address():
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rows_are_pushed_and_failures_told(spark, address):
    rows = spark.range(5).select(F.col("id").alias("n"))
    got = {json.loads(r.body)["n"]: r.error for r in market.push_each(rows, address).collect()}
    assert sorted(Answers.bodies) == [0, 1, 2, 3, 4] and [k for k, e in got.items() if e] == [2]
    assert all(r.error for r in market.push_each(rows.limit(1), "http://127.0.0.1:1").collect())


def test_pages_are_counted_from_the_first(spark, address):
    spark.dataSource.register(market.MarketPages)
    assert spark.read.format("market_pages").option("address", address + "/?page={page}").option("pages", "auto").load().count() == 3
    lost = spark.read.format("market_pages").option("address", "http://127.0.0.1:1/{page}").option("pages", "auto").load().collect()
    assert len(lost) == 1 and lost[0].error


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("=1", 5.0), ("b", 20.0)], "name string, gap_pct double")
    market.export_report(report, f"{tmp_path}/r", "json", threshold=10)
    assert [r.name for r in spark.read.json(f"{tmp_path}/r").collect()] == ["b"]
    with pytest.raises(ValueError):
        market.export_report(report, f"{tmp_path}/p", "pdf")


def test_reactivation_arms_an_alert_again(spark):
    kinds = "alert_id long, user_id long, product_id long, seller_id long, target_price decimal(14,2), is_active boolean, triggered_at date"
    day = datetime.date(2024, 1, 1)
    a = spark.createDataFrame([(1, 1, 5, None, D(10), False, day), (2, 1, 6, None, D(10), True, day), (3, 1, 6, None, D(10), False, None)], kinds)
    ch = spark.createDataFrame([(1, "update", 1, 1, 0, None, None, True), (2, "update", 3, 1, 0, None, D(7), True), (3, "delete", 2, 2, 0, None, None, None), (4, "create", None, 1, 6, None, D(3), None), (5, "create", None, 1, 9, None, D(3), None), (6, "create", None, 1, 7, None, D(3), None)],
        "change_id long, kind string, alert_id long, user_id long, product_id long, seller_id long, target_price decimal(14,2), is_active boolean")
    p = spark.createDataFrame([(6, True), (7, True), (9, False)], "product_id long, is_active boolean")
    out = state.alert_outcomes(a, ch, p, spark.createDataFrame([], LISTING))
    assert {r.change_id: r.outcome for r in out.collect()} == {1: "updated", 2: "duplicate", 3: "not_found", 4: "duplicate", 5: "no_target", 6: "created"}
    after = {r.alert_id: r for r in state.alerts_after(a, ch, out, 100).collect()}
    assert after[1].is_active and after[1].triggered_at is None and after[1].target_price == D("10.00")
    assert after[2].is_active and after[2].triggered_at == day and not after[3].is_active and after[106].target_price == D("3.00")


def test_streams_keep_levels_over_restarts(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(k, datetime.datetime(2024, 1, 1, 0, k), 1, float(x)) for k, x in v], "event_id long, ts timestamp, user_id long, value double")
    kinds = "event_id long, ts timestamp, user_id long, value double"
    for step, want, rising in (((1, 90), (2, 95), (3, 10)), [1], True), (((4, 10), (5, 99)), [1, 5], True), (((6, 99), (7, 1)), [1, 5], True):
        rows(*step).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = captures.run_available(captures.rising_edges(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in"), 80), folder=f"{tmp_path}/w")
        assert sorted(r.event_id for r in got.collect()) == want
    again = captures.run_available(captures.changes_only(spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")))
    assert sorted(r.event_id for r in again.collect()) == [1, 2, 3, 5, 7]


def test_entities_fall_back_to_the_context(spark):
    p = spark.createDataFrame([(1, "Galaxy A55", True), (2, "Galaxy S9", True), (3, "Pixel", False)], "product_id long, name string, is_active boolean")
    m = spark.createDataFrame([(1, "compare galaxy phones", ["2"]), (2, "what is the price", ["2", "x", "3"]), (3, "pixel", [])], "message_id long, text string, context_ids array<string>")
    found = assistant.resolved(m, assistant.entities(m, p), p)
    assert sorted((r.message_id, r.rank, r.product_id) for r in found.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2)]


def test_ranks_are_whole_under_any_plan(spark):
    """Other columns selected, many rows, ties: each rank is given once."""
    from marketglass.operators import sales

    n = 400_000
    df = spark.range(n, numPartitions=8).selectExpr("id as product_id", "cast(id * 7919 % 1000 as decimal(18,2)) as revenue", "id % 7 as units", "cast(1 as decimal(18,2)) as asp", "id % 3 as records")
    r = sales.share_rank_order(df).select("rank", "product_id", "revenue", "units", "asp", "records")
    got = r.selectExpr("count(*)", "count(distinct rank)", "min(rank)", "max(rank)").first()
    assert tuple(got) == (n, n, 1, n)
    best = r.filter("rank <= 3").orderBy("rank").select("product_id").collect()
    want = df.orderBy(*[c for c in (df.revenue.desc(), df.units.desc(), df.product_id)]).limit(3).collect()
    assert [x.product_id for x in best] == [x.product_id for x in want]


def test_shares_count_watched_listings_only_and_levels_go_by_percent(spark):
    from decimal import Decimal

    from marketglass.operators import competitors

    watch = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (2, 10, 1), (1, 11, 1), (1, 12, 9), (3, 13, 1)], "org_id long, product_id long, seller_id long")
    price = "product_id long, seller_id long, current_price decimal(14,2), is_available boolean"
    listings = spark.createDataFrame([(10, 1, Decimal("100.00"), True), (10, 2, Decimal("50.00"), True), (10, 3, Decimal("1.00"), True), (11, 1, Decimal("0.00"), True), (13, 1, Decimal("500.00"), False)], price)
    own = spark.createDataFrame([(10, Decimal("100.00")), (11, Decimal("7.00")), (12, Decimal("5.00")), (13, Decimal("500.01"))], "product_id long, selling_price decimal(14,2)")
    got = {(r.org_id, r.product_id): r.share_bp for r in competitors.market_share(watch, own, listings).collect()}
    assert got == {(1, 10): 2500, (2, 10): 5000, (1, 11): 10000, (3, 13): 5000}
    found = {(r.org_id, r.product_id, r.seller_id): (r.risk, r.position) for r in competitors.gaps(watch, own, listings).collect()}
    assert found[3, 13, 1] == ("low", "above_competitor")
    assert found[1, 11, 1] == ("medium", "above_competitor")


def test_pairs_of_products_taken_together_are_whole_and_bounded(monkeypatch):
    """Rules and captures of several products in one call: every pair once, in pieces."""
    import numpy as np

    from marketglass.streaming import rules as r

    monkeypatch.setattr(r, "PAIRS", 10)
    pieces = list(r._pieces({7: [0, 1, 2, 3, 4], 9: [5]}, {7: np.array([2, 0, 5]), 9: np.array([1])}))
    assert all(len(a) < 20 for a, _ in pieces) and len(pieces) > 1
    assert sorted((int(n), int(c)) for a, b in pieces for n, c in zip(a, b)) == sorted([(n, c) for n in range(5) for c in (0, 2, 5)] + [(5, 1)])


def test_messages_that_share_a_term_are_dealt_out(spark):
    p = spark.createDataFrame([(k, f"phone {k % 7}" if k % 3 else "phone", k % 5 != 0) for k in range(60)], "product_id long, name string, is_active boolean")
    m = spark.createDataFrame([(k, "show phone" if k % 4 else f"phone 1{k}") for k in range(400)], "message_id long, text string")
    found = assistant.entities(m, p)
    want = sorted(((r.name, r.product_id) for r in p.filter("is_active").collect()))[:5]
    got = {}
    for r in found.collect():
        got.setdefault(r.message_id, []).append((r.rank, r.name, r.product_id))
    assert len(got) == 400 and all(sorted(v) == [(n + 1, *x) for n, x in enumerate(want)] for v in got.values())
    assert found.select(F.spark_partition_id().alias("part")).distinct().count() > 1
