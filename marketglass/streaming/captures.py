"""Captures as a stream: deduplication, price alerts that fire once, the latest snapshot, fixed buckets."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where the session names none and all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="marketglass-")
    return f"{top}/stream/{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures (event_id, ts, user_id, event_type, value, props) of Parquet files, as they come."""
    # A pattern, as the stream source takes single files only by one.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def deduplicated(captures: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Captures without repeats of a user and time; repeats later than `delay` after the newest are let through."""
    timed = captures.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "ts"])


def fire_once(captures: DataFrame, target: float, rearmed: str | None = None) -> DataFrame:
    """Per user, the first capture at or below target; a true value in column `rearmed` arms the alert again.

    State is one flag a user. Only captures at or below the target, or that arm, reach Python. Within a micro-batch captures
    are taken by time; one that comes in a later batch can't fire an alert that has fired, though its time is earlier.
    """
    hit = F.coalesce(F.col("value") <= target, F.lit(False))
    arms = F.coalesce(F.col(rearmed).cast("boolean"), F.lit(False)) if rearmed is not None else F.lit(False)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        # A stretch begins where the alert is armed; the first hit of each fires, but for what fired before this batch.
        stretch = pdf["_arms"].cumsum()
        hits = pdf[pdf["_hit"]]
        first = hits[~stretch[pdf["_hit"]].duplicated()]
        if state.exists and state.get[0]:
            first = first[stretch[pdf["_hit"]][~stretch[pdf["_hit"]].duplicated()] > 0]
        last = stretch.iloc[-1]
        state.update((bool((stretch[pdf["_hit"]] == last).any() or last == 0 and state.exists and state.get[0]),))
        yield first[["user_id", "event_id", "value"]]

    slim = captures.select("user_id", "ts", "event_id", "value", hit.alias("_hit"), arms.alias("_arms")).filter("_hit or _arms")
    return slim.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, value double", "fired boolean", "append", GroupStateTimeout.NoTimeout)


def _after_last(captures: DataFrame, state_of, fires, state_type: str) -> DataFrame:
    """Captures that fire given the user's state before them; the state is that of the user's last capture.

    Within a micro-batch captures are taken by time. state_of and fires take whole columns.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        now = state_of(pdf["value"])
        before = now.shift(1).astype(object)
        before.iloc[0] = state.get[0] if state.exists else None
        state.update((now.iloc[-1].item(),))
        yield pdf[fires(before, now).to_numpy(bool)][["user_id", "event_id", "value"]]

    return captures.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, value double", state_type, "append", GroupStateTimeout.NoTimeout)


def rising_edges(captures: DataFrame, threshold: float) -> DataFrame:
    """Captures at which a user's level becomes high (value at or above threshold); the state is the last level."""
    return _after_last(captures, lambda v: v >= threshold, lambda before, now: now & ~before.eq(True), "high boolean")


def changes_only(captures: DataFrame) -> DataFrame:
    """Captures whose value differs from the user's last, and each user's first; the state is the last value."""
    return _after_last(captures, lambda v: v, lambda before, now: before.isna() | (before != now), "value double")


def run_isolated(sources: dict[str, Callable[[], DataFrame]], mode: str = "append") -> dict[str, DataFrame | Exception]:
    """Runs the sources' streams beside each other, each in a folder of its own; what fails is given as its error and
    neither stops the others nor holds them up."""
    out: dict[str, DataFrame | Exception] = {}

    def run(source: Callable[[], DataFrame]) -> DataFrame:
        return run_available(source(), mode)

    with ThreadPoolExecutor(max(1, len(sources))) as pool:
        for name, job in {name: pool.submit(run, source) for name, source in sources.items()}.items():
            try:
                out[name] = job.result()
            except Exception as error:  # noqa: BLE001
                logging.getLogger(__name__).warning("source %s: %s", name, error)
                out[name] = error
    return out


def snapshot(captures: DataFrame) -> DataFrame:
    """Each user's latest capture by event time, whatever order captures come in."""
    last = F.max(F.struct("ts", "event_id", "value")).alias("x")
    return captures.groupBy("user_id").agg(last).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.value").alias("value"))


def buckets(captures: DataFrame, width: str = "12 hours", delay: str = "1 day") -> DataFrame:
    timed = captures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


#: A state store that holds maps; and no batches without data, which a state that expires would ask for without end.
OPTIONS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream under OPTIONS; the session's own settings come back once it has begun."""
    before = {k: spark.conf.get(k, None) for k in OPTIONS}
    for k, v in OPTIONS.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over what is there now and returns what it wrote. Running it again in the same folder goes on from its checkpoint."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = start(writer.format("parquet").option("path", out), spark)
    else:
        # The whole result of each batch goes to a folder of its own, so that a batch that is run again replaces its own only.
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    done = spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)
    if mode == "append":
        return done
    newest = done.agg(F.max("batch").alias("batch"))
    return done.join(F.broadcast(newest), "batch", "left_semi").drop("batch")


def start_every(stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, interval: str = "12 hours") -> StreamingQuery:
    """Starts the stream in micro-batches of that interval, each handed to the sink; it runs until the caller stops it."""
    return stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(processingTime=interval).foreachBatch(sink).start()
