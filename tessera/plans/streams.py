"""Queries: tick bars, sliding and session windows, duplicates, interval joins, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources import panel as p
from tessera.streaming import monitors as m

_HOUR = "time_bucket(INTERVAL 1 HOUR, ts)"


@query("st1_tick_bars", f"SELECT {_HOUR} AS start, user_id AS code, round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY ts, event_id), 6) AS close, count(*) AS ticks FROM events GROUP BY 1, 2")
def st1(spark, sf_dir):
    """Tick to bar in tumbling windows."""
    x = m.tick_bars(p.ticks(spark, sf_dir))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "code", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "ticks")


@query("st2_sliding_counts", "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start, event_type FROM events) GROUP BY 1, 2")
def st2(spark, sf_dir):
    """Sliding windows of an hour every 15 minutes."""
    return p.ticks(spark, sf_dir).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("st3_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id AS code, min(ts) AS start, count(*) AS ticks FROM b GROUP BY user_id, s")
def st3(spark, sf_dir):
    """Session windows with a gap of two hours."""
    return m.sessions(p.ticks(spark, sf_dir), "2 hours").select("code", F.col("s.start").cast("timestamp_ntz").alias("start"), "ticks")


@query("st4_interval_join", "SELECT a.event_id AS signal_id, b.event_id AS order_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def st4(spark, sf_dir):
    """Orders within an hour of a signal of the same code."""
    t = p.ticks(spark, sf_dir)
    return m.orders_after_signals(t.filter("event_type = 'view'"), t.filter("event_type = 'purchase'"), "1 hour").select("signal_id", "order_id")


@query("st5_once_per_slot", "SELECT user_id AS code, CAST(ts AS DATE) AS day, count(*) > 0 AS reported FROM events GROUP BY 1, 2")
def st5(spark, sf_dir):
    """One report of each code and day."""
    return m.once_per_slot(p.ticks(spark, sf_dir)).select("code", F.to_date("slot").alias("day"), F.lit(True).alias("reported"))


@query("st6_running_peaks", "SELECT user_id AS code, max(value) AS peak, count(value) AS seen FROM events GROUP BY 1")
def st6(spark, sf_dir):
    """What the stateful peak monitor ends with."""
    return p.ticks(spark, sf_dir).groupBy("code").agg(F.max("price").alias("peak"), F.count("price").alias("seen"))
