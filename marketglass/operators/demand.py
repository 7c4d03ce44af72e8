"""Demand forecasts: exponential smoothing with trend and season, and Croston's method for rare sales, chosen by back-test.

Sales are summed by product and month; a product's series is one array, as long as the calendar. Series are smoothed many
at once in numpy, for all settings; each product takes the setting of the least error from rolling origins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Setting(NamedTuple):
    """A method and its rates: of level, trend and season."""

    method: str
    level: float = 0.0
    trend: float = 0.0
    season: float = 0.0


SETTINGS = (
    Setting("naive"),
    *(Setting("smooth", a) for a in (0.1, 0.3, 0.6)),
    *(Setting("trend", a, b) for a in (0.1, 0.3) for b in (0.05, 0.2)),
    *(Setting("season", a, 0.05, c) for a in (0.1, 0.3) for c in (0.1, 0.3)),
    *(Setting("croston", a) for a in (0.1, 0.2)),
)
YEAR = 12


def paths(x: np.ndarray, s: Setting, horizon: int) -> np.ndarray:
    """Forecasts made after each period: [series, period, step]. x: [series, period].

    Level and trend begin with the first value and 0, seasons with 0; Croston's size and interval with the first sale.
    Forecasts are never below 0.
    """
    n, t = x.shape
    out = np.zeros((n, t, horizon))
    steps = np.arange(1, horizon + 1)
    if s.method == "naive":
        return np.repeat(x[:, :, None], horizon, 2)
    if s.method == "croston":
        size, gap, since = np.zeros(n), np.ones(n), np.zeros(n)
        known = np.zeros(n, bool)
        for k in range(t):
            since += 1
            sold = x[:, k] > 0
            size = np.where(sold, np.where(known, size + s.level * (x[:, k] - size), x[:, k]), size)
            gap = np.where(sold, np.where(known, gap + s.level * (since - gap), since), gap)
            known |= sold
            since[sold] = 0
            out[:, k] = (size / gap)[:, None]
        return out
    level, trend, season = x[:, 0].copy(), np.zeros(n), np.zeros((n, YEAR))
    for k in range(t):
        m = k % YEAR
        if k:
            before = level
            level = s.level * (x[:, k] - season[:, m]) + (1 - s.level) * (level + trend)
            trend = s.trend * (level - before) + (1 - s.trend) * trend
        if s.season:
            season[:, m] += s.season * (x[:, k] - level - season[:, m])
        out[:, k] = level[:, None] + trend[:, None] * steps + (season[:, (k + steps) % YEAR] if s.season else 0.0)
    return np.maximum(out, 0.0)


def error(x: np.ndarray, made: np.ndarray, origins: int) -> np.ndarray:
    """Mean absolute error of each series, over the last `origins` periods from which all steps can be held against sales."""
    t, horizon = x.shape[1], made.shape[2]
    at = np.arange(max(0, t - horizon - origins), max(0, t - horizon))
    if not len(at):
        return np.zeros(len(x))
    real = np.stack([x[:, at + h] for h in range(1, horizon + 1)], 2)
    return np.abs(real - made[:, at]).mean((1, 2))


def series(sales: DataFrame) -> DataFrame:
    """product_id, first (month of all sales' beginning) and demand, an array with a value for each month up to the last of all sales.

    Two months (one small row) are fetched; null dates take no part.
    """
    month = F.year("sale_date") * 12 + F.month("sale_date") - 1
    x = sales.filter(F.col("sale_date").isNotNull()).select("product_id", month.alias("m"), F.coalesce(F.col("quantity"), F.lit(0)).cast("double").alias("q"))
    low, high = x.agg(F.min("m"), F.max("m")).first()
    if low is None:
        return x.select("product_id", F.lit(0).alias("first"), F.array(F.lit(0.0)).alias("demand")).limit(0)
    sums = x.groupBy("product_id", "m").agg(F.sum("q").alias("q"))
    by_month = F.map_from_entries(F.collect_list(F.struct("m", "q")))
    return sums.groupBy("product_id").agg(by_month.alias("x")).select("product_id", F.lit(low).alias("first"), F.transform(F.sequence(F.lit(low), F.lit(high)), lambda m: F.coalesce(F.try_element_at("x", m), F.lit(0.0))).alias("demand"))


def forecast(sales: DataFrame, horizon: int = 3, origins: int = 12, settings: tuple[Setting, ...] = SETTINGS) -> DataFrame:
    """product_id, method, step (1 to horizon), month (first day), demand, error, naive_error of every product with a sale.

    error: mean absolute error of the setting taken, from rolling origins; naive_error: that of repeating the last month.
    Ties go to the earlier setting. With a history too short for a back-test all errors are 0, so the first setting is taken.
    """
    whole = series(sales)
    kind = whole.schema["product_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                made = [paths(x, s, horizon) for s in settings]
                errors = np.stack([error(x, m, origins) for m in made])
                best = errors.argmin(0)
                rows = np.arange(len(x))
                last = np.stack([m[:, -1] for m in made])[best, rows]
                naive = error(x, paths(x, Setting("naive"), horizon), origins)
                again = np.repeat(rows, horizon)
                step = np.tile(np.arange(1, horizon + 1), len(x)).astype(np.int32)
                first = part.column(1).to_numpy()[again] + x.shape[1] - 1 + step
                columns = [part.column(0).take(pa.array(again)), pa.array([settings[k].method for k in best[again]], pa.string()), pa.array(step), pa.array(first.astype(np.int32)), pa.array(last.ravel()), pa.array(errors[best, rows][again]), pa.array(naive[again])]
                yield pa.RecordBatch.from_arrays(columns, ["product_id", "method", "step", "month", "demand", "error", "naive_error"])

    out = whole.mapInArrow(run, f"product_id {kind}, method string, step int, month int, demand double, error double, naive_error double")
    return out.withColumn("month", F.make_date((F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, F.lit(1)))
