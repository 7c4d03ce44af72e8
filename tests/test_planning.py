"""Inventory, anomalies, demand, recommendations and graphs against plain loops and planted cases."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketglass.operators import anomalies, demand, graph, inventory, recommend

DAY = datetime.date(2026, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_ledger_equals_a_plain_loop(spark):
    rng = random.Random(1)
    moves = [(rng.randrange(3), day(rng.randrange(40)), rng.choice([None, 0, 1, 5, 9]), rng.random() < 0.4) for _ in range(200)]
    schema = "product_id long, day date, quantity int"
    part = lambda kind: spark.createDataFrame([m[:3] for m in moves if m[3] == kind], schema)
    opening = spark.createDataFrame([(0, 10), (1, None)], "product_id long, stock int")
    want = []
    for p in range(3):
        stock = {0: 10}.get(p, 0)
        for d in sorted({m[1] for m in moves if m[0] == p}):
            got, asked = (sum(m[2] or 0 for m in moves if m[0] == p and m[1] == d and m[3] == kind) for kind in (True, False))
            stock += got
            sold = min(stock, asked)
            stock -= sold
            want.append((p, d, got, asked, stock, asked - sold))
    book = inventory.ledger(opening, part(True), part(False))
    assert sorted(map(tuple, book.collect())) == sorted(want)
    found = inventory.reorder_points(book, part(False), lead_days=5, service=0.9).collect()
    for r in found:
        days = sorted({m[1] for m in moves if m[0] == r.product_id and not m[3]})
        demands = sorted(sum(m[2] or 0 for m in moves if m[0] == r.product_id and not m[3] and 0 <= (m[1] - d).days < 5) for d in days)
        assert r.demand_days == len(days) and r.reorder_point == demands[-(-len(days) * 9 // 10) - 1]
        assert r.order_quantity == (max(0, 2 * r.reorder_point - r.balance) if r.balance <= r.reorder_point else 0)


def plain_segments(x, penalty):
    best, last = [-penalty], [0]
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    for t in range(1, len(x) + 1):
        options = [best[s] + cost(s, t) + penalty for s in range(t)]
        best.append(min(options))
        last.append(int(np.argmin(options)))
    out, t = [], len(x)
    while t:
        t = last[t]
        out.append(t)
    return out[-2::-1]


def test_segments_equal_the_search_without_pruning():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 120):
        for jumps in (0, 1, 3):
            x = rng.normal(0, 1, n) + 6 * (np.arange(n)[:, None] >= rng.integers(0, n, jumps)[None]).sum(1)
            assert anomalies.segments(x, 8.0) == plain_segments(x, 8.0)
    assert anomalies.segments(np.r_[np.zeros(30), np.full(20, 9.0), np.full(10, 3.0)] + rng.normal(0, 0.5, 60), 8.0) == [30, 50]


def test_planted_jumps_and_outliers(spark):
    rng = random.Random(3)
    rows = [(p, datetime.datetime(2025, 1, 6) + datetime.timedelta(days=k), (100.0 if k < 210 or p else 160.0) * rng.uniform(0.98, 1.02)) for p in range(2) for k in range(420)]
    rows += [(2, datetime.datetime(2025, 1, 6), 5.0), (3, None, None), (0, datetime.datetime(2025, 3, 5), 0.0)]
    df = spark.createDataFrame(rows, "product_id long, captured_at timestamp, price double")
    (r,) = anomalies.change_points(df, strength=6.0).collect()
    assert r.product_id == 0 and r.changed_on == datetime.date(2025, 8, 4) and abs(r.before - 100) < 1 and abs(r.after - 160) < 2
    odd = spark.createDataFrame([(1, float(v)) for v in (10, 11, 9, 10, 12, 90, 8)] + [(2, 5.0)] * 3 + [(2, 6.0), (3, None), (4, 1.0)], "product_id long, price double")
    got = {(r.product_id, r.price, r.median, r.mad, r.deviation and round(r.deviation, 3)) for r in anomalies.outliers(odd).collect()}
    assert got == {(1, 90.0, 10.0, 1.0, round(80 / 1.4826, 3)), (2, 6.0, 5.0, 0.0, None)}
    assert anomalies.change_points(df.limit(0)).count() == anomalies.outliers(odd.limit(0)).count() == 0


def plain_path(x, s, horizon):
    """Forecasts of one series by a loop over its values."""
    out = []
    if s.method == "naive":
        return [[v] * horizon for v in x]
    if s.method == "croston":
        size = gap = None
        since = 0
        for v in x:
            since += 1
            if v > 0:
                size, gap = (v, since) if size is None else (size + s.level * (v - size), gap + s.level * (since - gap))
                since = 0
            out.append([0.0 if size is None else size / gap] * horizon)
        return out
    level, trend, season = x[0], 0.0, [0.0] * 12
    for k, v in enumerate(x):
        if k:
            before = level
            level = s.level * (v - season[k % 12]) + (1 - s.level) * (level + trend)
            trend = s.trend * (level - before) + (1 - s.trend) * trend
        if s.season:
            season[k % 12] += s.season * (v - level - season[k % 12])
        out.append([max(0.0, level + h * trend + (season[(k + h) % 12] if s.season else 0.0)) for h in range(1, horizon + 1)])
    return out


def test_smoothing_equals_plain_loops():
    rng = np.random.default_rng(4)
    x = rng.poisson(3, (7, 40)).astype(float) * (rng.random((7, 40)) < [[0.1], [0.3], [1], [1], [0], [0.9], [0.5]])
    for s in demand.SETTINGS:
        made = demand.paths(x, s, 3)
        for k in range(len(x)):
            assert np.allclose(made[k], plain_path(x[k].tolist(), s, 3))
            errors = [abs(x[k][t + h] - made[k][t][h - 1]) for t in range(40 - 3 - 12, 40 - 3) for h in (1, 2, 3)]
            assert np.isclose(demand.error(x, made, 12)[k], np.mean(errors))


def test_forecasts_beat_the_naive_one_on_planted_demand(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p in range(12):
        for k in range(72):
            q = [20 + k + 15 * np.sin(k * np.pi / 6), 12 if k % 5 == 0 else 0, 30][p % 3] + rng.normal(0, 2 if p % 3 != 1 else 0)
            rows.append((p, datetime.date(2019 + k // 12, k % 12 + 1, 9), int(max(0, round(q)))))
    sales = spark.createDataFrame([*rows, (99, None, 5), (98, datetime.date(2024, 12, 1), None)], "product_id long, sale_date date, quantity int")
    got = {(r.product_id, r.step): r for r in demand.forecast(sales).collect()}
    assert {k[0] for k in got} == {*range(12), 98} and {k[1] for k in got} == {1, 2, 3}
    assert all(r.error <= r.naive_error for r in got.values())
    assert got[0, 1].month == datetime.date(2025, 1, 1) and got[0, 3].month == datetime.date(2025, 3, 1)
    assert {got[p, 1].method for p in (0, 3, 6, 9)} <= {"trend", "season"}
    assert np.mean([got[p, 1].error for p in range(12)]) < 0.8 * np.mean([got[p, 1].naive_error for p in range(12)])
    assert got[98, 1].demand == 0.0
    short = demand.forecast(sales.filter("month(sale_date) = 3 and year(sale_date) = 2020")).collect()
    assert {(r.method, r.error) for r in short} == {("naive", 0.0)}
    assert demand.forecast(sales.limit(0)).count() == 0


def test_recommendations_equal_brute_force_over_the_factors(spark):
    rng = random.Random(6)
    rows = [(u, 100 * (u % 3) + rng.randrange(20), rng.randrange(1, 5)) for u in range(60) for _ in range(12)]
    rows += [(500, p, 1) for p in range(300)] * 3 + [(501, None, 1), (None, 5, 1), (502, 5, 0)]
    weights = recommend.tastes(spark.createDataFrame(rows, "org_id long, product_id long, quantity int"))
    assert weights.filter("org_id = 500").count() == 300
    model = recommend.fit(weights, rank=6, rounds=6)
    got = recommend.recommended(model, weights, 5).collect()
    user, item = ({r.id: np.array(r.features) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    known = {(r.org_id, r.product_id) for r in weights.collect()}
    for u, f in user.items():
        scores = sorted((float(f @ g) for g in item.values()), reverse=True)[:5]
        mine = sorted((r for r in got if r.org_id == u), key=lambda r: r["rank"])
        assert np.allclose([r.score for r in mine], scores, atol=1e-4)
        assert all(r.bought == ((u, r.product_id) in known) for r in mine)
    inside = [r.product_id // 100 == r.org_id % 3 for r in got if r.org_id < 60]
    assert sum(inside) > 0.95 * len(inside)


def test_trust_equals_a_dense_solution(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(15), rng.randrange(8), rng.randrange(4)) for _ in range(80)] + [(None, 1, 1), (3, 77, 2)]
    df = spark.createDataFrame(pairs, "buyer_id long, seller_id long, weight int")
    sellers = spark.createDataFrame([(k,) for k in range(10)] + [(None,)], "seller_id long")
    w = np.zeros((15, 10))
    for b, s, x in pairs:
        if b is not None and s < 10:
            w[b, s] += x
    step = np.zeros((10, 10))
    for s in range(10):
        step[s] = 0.1 if not w[:, s].sum() else sum(w[b, s] / w[:, s].sum() * w[b] / w[b].sum() for b in range(15) if w[b].sum())
    want = np.linalg.solve(np.eye(10) - 0.85 * step.T, np.full(10, 0.015))
    got = {r.seller_id: r.trust for r in graph.trust(df, sellers, tolerance=1e-8).collect()}
    assert np.allclose([got[k] for k in range(10)], want, atol=1e-6) and abs(sum(got.values()) - 1) < 1e-6
    assert graph.trust(df, sellers.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [8, 9])
def test_a_planted_block_comes_out_and_the_bound_holds(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(300), rng.randrange(200)) for _ in range(1200)} | {(u, 7) for u in range(300)}
    block = {(1000 + u, 500 + p) for u in range(12) for p in range(10)}
    rows = [*pairs, *block, *list(block)[:20], (None, 3)]
    found, told = graph.dense_block(spark.createDataFrame(rows, "user_id long, product_id long"))
    got = {(r.side, r.id) for r in found.collect()}
    assert {("user", 1000 + u) for u in range(12)} | {("product", 500 + p) for p in range(10)} == got
    # No subset is denser than the bound allows: one node after the other, the lightest first, finds half the best at least.
    users = {}
    for _, p in pairs | block:
        users[p] = users.get(p, 0) + 1
    left = {e: 1 / np.log2(5 + users[e[1]]) for e in pairs | block}
    best = 0.0
    while left:
        weight = {}
        for (u, p), x in left.items():
            weight["u", u] = weight.get(("u", u), 0) + x
            weight["p", p] = weight.get(("p", p), 0) + x
        best = max(best, sum(left.values()) / len(weight))
        low = min(weight, key=weight.get)
        left = {e: x for e, x in left.items() if low not in (("u", e[0]), ("p", e[1]))}
    assert max(d for _, d in told) >= best / 2.2 and len(told) < 25
    assert graph.dense_block(spark.createDataFrame([], "user_id long, product_id long"))[0].count() == 0


def test_recommendations_by_blocks(spark):
    """Blocks smaller than k and many of them give each customer's best, and tasks go by blocks, not by shuffle partitions."""
    rng = random.Random(8)
    weights = recommend.tastes(spark.createDataFrame([(u, rng.randrange(90), rng.randrange(1, 5)) for u in range(50) for _ in range(9)], "org_id long, product_id long, quantity int"))
    model = recommend.fit(weights, rank=4, rounds=3)
    found = recommend.recommended(model, weights, 5, block=3)
    got = {(r.org_id, r["rank"]): r.score for r in found.collect()}
    user, item = ({r.id: np.array(r.features) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    for u, f in user.items():
        assert np.allclose([got[u, k] for k in range(1, 6)], sorted((float(f @ g) for g in item.values()), reverse=True)[:5], atol=1e-5)
    assert len(got) == 5 * len(user)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert recommend.fit(weights, rank=4, rounds=1).userFactors.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_factors_by_pieces_equal_plain_rounds(spark):
    """Pieces go by the number of weights, not by cores, a customer with more than a piece has one alone, and what comes
    out is the factorization that plain loops give."""
    rng = random.Random(9)
    rows = [(u, rng.randrange(40), rng.randrange(1, 5)) for u in range(80) for _ in range(7)] + [(200, p, 1 + p % 3) for p in range(40)]
    weights = recommend.tastes(spark.createDataFrame(rows, "org_id long, product_id long, quantity int"))
    for table, longest in ((recommend._pieces(weights, "org_id", "product_id", 3, 24), 40), (recommend._pieces(weights, "product_id", "org_id", 3, 24), 24)):
        sizes = [(len(r.ids) // 4, len(r.weights) // 4) for r in spark.read.parquet(table.path).collect()]
        assert (1, 40) in sizes or longest == 24
        assert sum(n for _, n in sizes) == weights.count() and len(sizes) > 2 * spark.sparkContext.defaultParallelism
        assert all(n <= 24 or ids == 1 for ids, n in sizes) and max(n for _, n in sizes) <= longest
    model = recommend.fit(weights, rank=4, rounds=3, strength=10.0, piece=16)
    assert len(model.users.files) > 2 * spark.sparkContext.defaultParallelism
    got_users, got_items = ({r.id: r.features for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    w = {(r.org_id, r.product_id): r.weight for r in weights.collect()}
    assert set(got_users) == {u for u, _ in w} and set(got_items) == {p for _, p in w}

    def solve(ids, others, pairs):
        gram = sum(np.outer(x, x) for x in others.values())
        out = {}
        for i in ids:
            mine = [(others[o], 10.0 * v) for (t, o), v in pairs.items() if t == i]
            a = gram + sum(c * np.outer(x, x) for x, c in mine) + 0.05 * len(mine) * np.eye(4)
            out[i] = np.linalg.solve(a, sum((1 + c) * x for x, c in mine))
        return out

    users = {u: recommend._started(np.array([u]), 4, 7)[0] for u in got_users}
    for _ in range(3):
        items = solve(got_items, users, {(p, u): v for (u, p), v in w.items()})
        users = solve(got_users, items, w)
    assert all(np.allclose(got_users[u], x, rtol=1e-3, atol=1e-4) for u, x in users.items())
    assert all(np.allclose(got_items[p], x, rtol=1e-3, atol=1e-4) for p, x in items.items())


@pytest.mark.parametrize("most", [1, 7, 1 << 16])
def test_targets_with_more_weights_than_fit_at_once(most):
    rng = np.random.default_rng(10)
    counts = np.array([1, 1, 3, 20, 20, 50])
    x, w, gram = rng.normal(size=(95, 3)).astype(np.float32), rng.normal(size=95).astype(np.float32), np.eye(3)
    found, at = recommend._solved(counts, x, w, gram, 2.0, 0.1, most), 0
    for n, mine in zip(counts, found):
        y, c, liked = x[at : at + n].astype(float), 2.0 * np.abs(w[at : at + n].astype(float)), w[at : at + n] > 0
        assert np.allclose(mine, np.linalg.solve(gram + (y.T * c) @ y + 0.1 * liked.sum() * np.eye(3), y.T @ ((1 + c) * liked)))
        at += n


def test_best_among_products_of_equal_length(spark):
    """No bound rules anything out, blocks hold many ties, and few products are fewer than asked for."""
    rows = [(u, p, 1) for u in range(30) for p in range(70)]
    weights = recommend.tastes(spark.createDataFrame(rows, "org_id long, product_id long, quantity int"))
    model = recommend.fit(weights, rank=4, rounds=2)
    user, item = ({r.id: np.array(r.features) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    got = recommend.recommended(model, weights, 5, block=50).collect()
    for u, f in user.items():
        mine = sorted((r["rank"], r.score) for r in got if r.org_id == u)
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, s in mine], sorted((float(f @ g) for g in item.values()), reverse=True)[:5], atol=1e-5)
    few = recommend.tastes(spark.createDataFrame([(u, p, 1) for u in range(4) for p in range(3)], "org_id long, product_id long, quantity int"))
    assert recommend.recommended(recommend.fit(few, rank=2, rounds=1), few, 5).count() == 12
