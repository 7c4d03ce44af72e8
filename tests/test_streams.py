"""Streams with state: restarts, changing rules, and ingestion that is stopped in mid-batch, against batch answers."""

import random
import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketglass.streaming import captures, ingest, rules


def at(k):
    return datetime(2026, 7, 1, tzinfo=timezone.utc).replace(tzinfo=None) + timedelta(hours=k)


CHANGE = "kind string, rule_id string, product_id long, seller_id long, at timestamp, ord long, is_active boolean, level long, own long"
SHOWN = "product_id long, seller_id long, at timestamp, ord long, line int, cents long"


def made(seed, hours=60):
    rng = random.Random(seed)
    seen = [(rng.randrange(3), rng.randrange(3), at(rng.randrange(hours)), n, n % 3, rng.randrange(0, 900)) for n in range(300)]
    changes = []
    for r in range(12):
        kind = rng.choice(["alert", "watch"])
        product, seller = rng.randrange(3), rng.choice([None, rng.randrange(3)]) if kind == "alert" else rng.randrange(3)
        changes.append((kind, f"r{r}", product, seller, at(0), 0, rng.random() < 0.8, rng.randrange(100, 800), rng.choice([None, 500, 800]) if kind == "watch" else None))
        for n in range(rng.randrange(8)):
            what = rng.randrange(4)
            changes.append((kind, f"r{r}", product, seller, at(rng.randrange(hours)), n + 1, [True, False, None, None][what], rng.randrange(100, 800) if what == 2 else None, 400 if what == 3 and kind == "watch" else None))
    return seen, changes


def key(rows):
    return sorted((r.kind, r.rule_id, r.seller_id, r.ord, r.line, r.cents, r.gap_bp) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_changing_rules_as_a_stream_with_restarts(spark, tmp_path, seed):
    seen, changes = made(seed)
    merged = rules.events(spark.createDataFrame(seen, SHOWN), spark.createDataFrame(changes, CHANGE))
    want = key(rules.replayed(merged).collect())
    assert {w[0] for w in want} == {"alert", "watch"}
    source = str(tmp_path / "in")
    for n, (low, high) in enumerate([(0, 20), (20, 21), (21, 60)]):
        merged.filter((F.col("at") >= F.lit(at(low))) & (F.col("at") < F.lit(at(high)))).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rules.EVENT).parquet(source)
        done = captures.run_available(rules.fired(stream), folder=str(tmp_path / "out"))
    assert key(done.collect()) == want


def test_replay_equals_a_plain_loop(spark):
    seen, changes = made(9)
    merged = rules.events(spark.createDataFrame(seen, SHOWN), spark.createDataFrame(changes, CHANGE))
    out = []
    for r in sorted({c[1] for c in changes}):
        mine = [c for c in changes if c[1] == r]
        kind, _, product, seller = mine[0][:4]
        active = level = own = last = None
        fired = False
        steps = [(c[4], 0, c[5], -1, c) for c in mine] + [(s[2], 1, s[3], s[4], s) for s in seen if s[0] == product and seller in (None, s[1])]
        for _, what, _, _, x in sorted(steps, key=lambda x: x[:4]):
            if what == 0:
                active = x[6] if x[6] is not None else active
                level = x[7] if x[7] is not None else level
                own = x[8] if x[8] is not None else own
                if x[6]:
                    fired, last = False, None
            elif active and level is not None and kind == "alert" and not fired and x[5] <= level:
                fired = True
                out.append((kind, r, x[1], x[3], x[4], x[5], None))
            elif active and level is not None and kind == "watch" and own is not None and x[5] > 0:
                gap = int((Decimal(own - x[5]) * 10000 / x[5]).quantize(Decimal(1), rounding="ROUND_HALF_UP"))
                if gap >= level and not last:
                    out.append((kind, r, x[1], x[3], x[4], x[5], gap))
                last = gap >= level
    assert key(rules.replayed(merged).collect()) == sorted(out)


def test_levels_expire(spark, tmp_path):
    source = str(tmp_path / "in")
    change = spark.createDataFrame([("watch", "w", 1, 1, at(0), 0, True, 100, 500)], CHANGE)
    fired = []
    for n in range(2):
        shown = spark.createDataFrame([(1, 1, at(n + 1), n, 0, 100)], SHOWN)
        rules.events(shown, change.filter(F.lit(n == 0))).coalesce(1).write.mode("append").parquet(source)
        stream = rules.fired(spark.readStream.schema(rules.EVENT).parquet(source), forget_ms=1)
        fired.append(captures.run_available(stream, folder=str(tmp_path / "out")).count())
    assert fired == [1, 2]


def sent(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        seller = rng.choice([("s1", "Ann"), ("s1", "Ann B"), (None, " Bob "), ("", "bob"), (None, None)])
        product = rng.choice([1, 1, 2, 3, 9])
        rows.append((k, rng.choice(["a", "b", "b", "off"]), f"e{product}", product, *seller, rng.choice(["item", "item", " "]), rng.choice(["5.00", "7.50", "12.00", "1.234"]), rng.choice(["PKR", "pkr ", "USD"]), rng.random() < 0.5, at(k // 2 % 40).isoformat() + "Z"))
    return rows


def tables(spark):
    platforms = spark.createDataFrame([("a", True), ("b", True), ("off", False)], "platform string, is_active boolean")
    products = spark.createDataFrame([(1, True), (2, True), (3, False)], "product_id long, is_active boolean")
    alerts = spark.createDataFrame([(1, 1, None, None, Decimal("6"), True), (2, 2, "b", "e2", Decimal("8"), True), (3, 1, None, None, Decimal("1"), True), (4, 1, None, None, Decimal("99"), False)], "alert_id long, product_id long, platform string, external_id string, target_price decimal(14,2), is_active boolean")
    watches = spark.createDataFrame([(1, "b", "e1", Decimal("8"), Decimal("5"), True), (2, "a", "e2", None, Decimal("5"), True), (3, "a", "e1", Decimal("8"), Decimal("70"), True)], "watch_id long, platform string, external_id string, selling_price decimal(14,2), threshold decimal(5,2), is_active boolean")
    return platforms, products, alerts, watches


def content(done):
    show = lambda df: sorted(map(tuple, df.drop("batch").collect()), key=str)
    return {name: show(done.table(name)) for name in ("outcomes", "quarantine", "history", "alerts", "risks")} | {"sellers": show(done.present("sellers", "platform", "seller_key")), "listings": show(done.present("listings", "platform", "external_id"))}


def test_ingestion_stopped_at_any_table_gives_the_batch_answer(spark, tmp_path):
    rows = sent(80, 4)
    whole = ingest.Ingest(spark, str(tmp_path / "whole"), *tables(spark))
    whole.batch(spark.createDataFrame(rows, ingest.SENT), 0)
    want = content(whole)
    assert want["alerts"] and want["risks"] and {r[12] for r in want["outcomes"]} == {"accepted", "duplicate", "inactive_platform", "unknown_product", "inactive_product"}
    # Captures of one time come in one file, so that what repeats is told in the same order.
    source, broken = str(tmp_path / "in"), iter(["outcomes", "sellers", "risks", "ledger", None])
    for low in range(0, 80, 20):
        spark.createDataFrame(rows[low : low + 20], ingest.SENT).coalesce(1).write.mode("append").parquet(source)
        stop = next(broken)

        def fail(name, stop=stop):
            if name == stop:
                raise RuntimeError(f"stopped before {name}")

        stream = spark.readStream.schema(ingest.SENT).parquet(source)
        with pytest.raises(Exception, match="stopped before"):
            ingest.Ingest(spark, str(tmp_path / "out"), *tables(spark), fail=fail).run_available(stream)
        done = ingest.Ingest(spark, str(tmp_path / "out"), *tables(spark))
        done.run_available(spark.readStream.schema(ingest.SENT).parquet(source))
        # A batch that is handed over again changes nothing.
        done.batch(spark.createDataFrame(rows, ingest.SENT), max(done.committed()))
    got = content(done)
    assert len(done.committed()) == 4
    assert got == want
    ledger = done.table("ledger").agg(F.sum("accepted"), F.sum("rejected"), F.sum("quarantined")).first()
    assert sum(ledger) == 80


def test_start_every_and_isolated_sources(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    got = []
    query = captures.start_every(stream(), lambda df, n: got.append((n, df.count())), str(tmp_path / "run"), "1 hour")
    for _ in range(300):
        if got:
            break
        time.sleep(0.1)
    query.stop()
    assert got == [(0, 5)]
    done = captures.run_isolated({"one": stream, "lost": lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "no") + "where"), "two": stream})
    assert done["one"].count() == done["two"].count() == 5
    assert isinstance(done["lost"], Exception)


def test_fire_once_equals_a_plain_loop_over_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(u, at(k), k * 10 + u, float(rng.randrange(10)), rng.random() < 0.2) for k in range(60) for u in range(4)] + [(1, at(61), 999, None, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, value double, armed boolean")
    want, fired = [], {}
    for u, _, e, v, arm in sorted(rows, key=lambda r: (r[1], r[2])):
        fired[u] = fired.get(u, False) and not arm
        if not fired[u] and v is not None and v <= 2:
            fired[u] = True
            want.append((u, e, v))
    source = str(tmp_path / "in")
    for low, high in ((0, 25), (25, 26), (26, 70)):
        df.filter((F.col("ts") >= F.lit(at(low))) & (F.col("ts") < F.lit(at(high)))).coalesce(1).write.mode("append").parquet(source)
        done = captures.run_available(captures.fire_once(spark.readStream.schema(df.schema).parquet(source), 2, "armed"), folder=str(tmp_path / "out"))
    assert sorted(map(tuple, done.collect())) == sorted(want)


def test_an_alert_that_has_triggered_is_checked_only(spark):
    from marketglass.operators import alerts

    table = spark.createDataFrame([(1, 5, None, True, Decimal("9"), True, True), (2, 5, None, True, Decimal("9"), True, None)], "alert_id long, product_id long, seller_id long, on_product boolean, target_price decimal(14,2), is_active boolean, is_triggered boolean")
    points = spark.createDataFrame([(5, 1, at(3), 1, 1, Decimal("8"), True)], "product_id long, seller_id long, captured_at timestamp, ord long, line int, price decimal(14,2), is_available boolean")
    got = {r.alert_id: (r.is_triggered, r.last_checked is not None) for r in alerts.evaluated(table, points).collect()}
    assert got == {1: (False, True), 2: (True, True)}


def test_the_first_batch_reads_its_captures_once_and_deals_out_broken_ones(spark, tmp_path):
    rows = sent(80, 4) + [(None,) * 11] * 5
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    done = ingest.Ingest(spark, str(tmp_path / "out"), *tables(spark))
    done.batch(spark.createDataFrame(rows, ingest.SENT).mapInPandas(counted, ingest.SENT), 0)
    assert read.value == 85
    assert done.table("outcomes").count() + done.table("quarantine").count() == 85
    lost = done.table("quarantine").filter("platform is null").collect()
    assert [r.broken for r in lost] == [["platform", "title", "price", "currency", "offset", "time"]] * 5
    as_sent = {(r.capture_id, r.price, r.scraped_at) for r in done.table("quarantine").filter("platform is not null").collect()}
    assert as_sent and as_sent <= {(r[0], r[7], r[10]) for r in rows}


def test_a_batch_parses_each_capture_once_and_writes_no_history_of_its_own(spark, tmp_path):
    rows = sent(80, 4) + [(500 + k, "a", "e1", 1, f"s{k % 7}", f"S{k}", "item", "5.00", "PKR", True, at(50 + k // 9).isoformat() + "Z") for k in range(60)]
    df = spark.createDataFrame(rows, ingest.SENT)
    done = ingest.Ingest(spark, str(tmp_path / "out"), *tables(spark))
    plan = done.checked(df, 0, False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_to_timestamp") + plan.count("gettimestamp") + plan.count("cast(scraped_at") <= 1
    done.batch(df, 0)
    assert not (tmp_path / "out" / "history").exists()
    accepted = done.table("outcomes").filter("outcome = 'accepted'").select(*ingest.names("history")).collect()
    assert accepted and sorted(map(tuple, done.table("history").drop("batch").collect())) == sorted(map(tuple, accepted))
    want = {}
    for r in sorted(done.table("outcomes").filter("outcome = 'accepted' and seller_key is not null").collect(), key=lambda r: (r.captured_at, r.capture_id)):
        want[r.platform, r.seller_key] = (r.seller_name.strip(), r.external_seller_id, r.captured_at, r.capture_id)
    assert {(r.platform, r.seller_key): (r.seller_name, r.external_seller_id, r.captured_at, r.capture_id) for r in done.table("sellers").collect()} == want
