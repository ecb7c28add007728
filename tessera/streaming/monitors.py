"""Bars, sessions, duplicates, interval joins and keyed monitors on streams of ticks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream of ticks; the stamp is cast, as watermarks reject zone-free ones."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("code"), "event_type", F.col("value").alias("price"))


def tick_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and count of each code and window; works on batch frames as well."""
    x = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    order = F.struct("ts", "event_id")
    return x.groupBy(F.window("ts", width, slide).alias("w"), "code").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks"))


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    x = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    return x.groupBy(F.session_window("ts", gap).alias("s"), "code").agg(F.count("*").alias("ticks"), F.sum("price").alias("total"))


def once_per_slot(ticks: DataFrame, slot: str = "1 day", grace: str = "10 minutes") -> DataFrame:
    """The first report of each code and slot; later ones within the grace are dropped."""
    x = ticks.withColumn("slot", F.window("ts", slot)["start"])
    return x.withWatermark("ts", grace).dropDuplicatesWithinWatermark(["code", "slot"]) if ticks.isStreaming else x.dropDuplicates(["code", "slot"])


def orders_after_signals(signals: DataFrame, orders: DataFrame, within: str = "1 hour") -> DataFrame:
    """Interval join of two streams of one code."""
    a = signals.select(F.col("code"), F.col("ts").alias("signal_ts"), F.col("event_id").alias("signal_id"))
    b = orders.select(F.col("code").alias("order_code"), F.col("ts").alias("order_ts"), F.col("event_id").alias("order_id"))
    if signals.isStreaming:
        a, b = a.withWatermark("signal_ts", within), b.withWatermark("order_ts", within)
    return a.join(b, F.expr(f"code = order_code AND order_ts >= signal_ts AND order_ts <= signal_ts + INTERVAL {within}"))


def trailing_peaks(ticks: DataFrame) -> DataFrame:
    """Running peak and number of ticks per code, kept as state between batches."""

    def update(key: tuple, frames, state: GroupState):
        peak, seen = state.get if state.exists else (float("-inf"), 0)
        last = None
        for f in frames:
            prices = f["price"].dropna()
            if len(prices):
                peak, seen, last = max(peak, float(prices.max())), seen + len(prices), float(prices.iloc[-1])
        state.update((peak, seen))
        if last is not None:
            yield pd.DataFrame({"code": [key[0]], "peak": [peak], "seen": [seen]})

    return ticks.groupBy("code").applyInPandasWithState(update, "code long, peak double, seen long", "peak double, seen long", "update", GroupStateTimeout.NoTimeout)


def pending_batches(ticks: DataFrame, threshold: int = 20) -> DataFrame:
    """Emits a code's pending count each time it reaches ``threshold``; the rest stays in the state."""

    def update(key: tuple, frames, state: GroupState):
        pending, done = state.get if state.exists else (0, 0)
        pending += sum(len(f) for f in frames)
        ready, pending = divmod(pending, threshold)
        state.update((pending, done + ready))
        if ready:
            yield pd.DataFrame({"code": [key[0]], "batches": [done + ready]})

    return ticks.groupBy("code").applyInPandasWithState(update, "code long, batches long", "pending long, done long", "update", GroupStateTimeout.NoTimeout)


def enriched_batches(ticks: DataFrame, read, keys: list[str], write) -> DataStreamWriter:
    """Each micro-batch joined with a table that ``read(session)`` gives anew, so its rows are at most one trigger old.

    ``write(frame, batch_id)`` gets the result. A static side that is read once keeps the files that it had at the start.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch.join(read(batch.sparkSession), keys, "left"), batch_id)

    return ticks.writeStream.foreachBatch(each)


def run_each(writer: DataStreamWriter, checkpoint: str, every: str) -> StreamingQuery:
    """Start a stream that is polled each ``every`` ("5 minutes" for positions, "30 minutes" for scans)."""
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what there is into a memory table, as tests and backfills do."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
