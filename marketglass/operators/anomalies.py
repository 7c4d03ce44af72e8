"""Market anomalies: captures far from their product's usual price, and times at which a product's price level changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Normal deviations of one median absolute deviation.
SCALE = 1.4826


def outliers(points: DataFrame, key: str = "product_id", value: str = "price", limit: float = 3.5, accuracy: int = 100_000) -> DataFrame:
    """points with median, mad (median absolute deviation) and deviation, of those that lie `limit` deviations or more off.

    Medians are the lower middle values by mergeable quantile sketches, exact below `accuracy` rows of a key and off by
    at most 1 / accuracy of the rows beyond; they combine before the shuffle, so no key meets in one task whole. The key's
    medians are joined back. Nulls take no part; where the deviation is 0, any other value is off and its deviation null.
    """
    x = points.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    v = F.col(value).cast("double")
    middle = lambda c: F.percentile_approx(c, 0.5, accuracy)
    centred = x.join(x.groupBy(key).agg(middle(v).alias("median")), key).withColumn("_off", F.abs(v - F.col("median")))
    spread = centred.groupBy(key).agg(middle(F.col("_off")).alias("mad"))
    out = centred.join(spread, key).withColumn("deviation", F.try_divide(v - F.col("median"), F.col("mad") * SCALE))
    return out.filter(F.coalesce(F.abs("deviation") >= limit, F.col("_off") > 0)).drop("_off")


def segments(x: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments after the first, of the piecewise constant fit with the least squared error plus a penalty
    a segment. Exact, by dynamic programming over the last change; candidates that can't win any more are pruned."""
    n = len(x)
    s, q = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(x * x))
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    last = np.zeros(n + 1, np.int64)
    left = np.array([0])
    for t in range(1, n + 1):
        cost = best[left] + (q[t] - q[left]) - (s[t] - s[left]) ** 2 / (t - left)
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k] + penalty, left[k]
        left = np.append(left[cost <= best[t] + 1e-9], t)
    out: list[int] = []
    t = n
    while t > 0:
        t = int(last[t])
        out.append(t)
    return out[-2::-1]


def noise(x: np.ndarray) -> float:
    """Standard deviation of the noise, from the median of absolute steps: few jumps don't change it."""
    return float(np.median(np.abs(np.diff(x)))) * SCALE / np.sqrt(2) if len(x) > 1 else 0.0


def change_points(points: DataFrame, key: str = "product_id", value: str = "price", time: str = "captured_at", width: str = "week", strength: float = 3.0) -> DataFrame:
    """key, changed_on (first day of the period), before, after: changes in the level of each key's price.

    Prices are averaged by period (week or month) first, so a series has at most as many values as the calendar has
    periods. On logarithms of these, segments are fitted exactly, with a penalty of `strength` * noise variance * log(n) a
    segment. before and after are the mean prices of the periods beside the change. Prices of 0 or less take no part;
    series of fewer than four periods, and steady ones, have no change.
    """
    p = points.filter(F.col(value) > 0)
    means = p.groupBy(key, F.to_date(F.date_trunc(width, time)).alias("at")).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    series = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("s")).select(F.col(key), F.col("s.at").alias("at"), F.col("s.mean").alias("mean"))
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, before, after = [], [], [], []
            for k, (days, means) in enumerate(zip(batch.column(1), batch.column(2))):
                x = np.log(means.values.to_numpy())
                if len(x) < 4:
                    continue
                cuts = segments(x, strength * max(noise(x) ** 2, 1e-12) * np.log(len(x)))
                bounds = [0, *cuts, len(x)]
                for i, c in enumerate(cuts):
                    rows.append(k)
                    at.append(days.values[c].as_py())
                    before.append(float(np.exp(x[bounds[i] : c].mean())))
                    after.append(float(np.exp(x[c : bounds[i + 2]].mean())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.date32()), pa.array(before, pa.float64()), pa.array(after, pa.float64())], [key, "changed_on", "before", "after"])

    return series.mapInArrow(run, f"{key} {kind}, changed_on date, before double, after double")
