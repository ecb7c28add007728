"""Typed state over restarts: peaks end by exits, closes and timers; marks and slots hold; old entries go."""

import datetime as dt
import time

import pytest

from tessera.streaming import stateful as s

START = dt.datetime(2024, 1, 1, 9)
SCHEMA = "event_id long, ts timestamp, code long, event_type string, price double"


@pytest.fixture
def feed(spark, tmp_path):
    s.use_rocksdb(spark)
    folder, ids = tmp_path / "in", iter(range(1, 10_000))

    def add(*rows):
        """Rows (code, type, price) as one file, a minute apart."""
        made = [(i, START + dt.timedelta(minutes=i), *r) for i, r in ((next(ids), r) for r in rows)]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    def run(make, name, mode="append"):
        """A new query from the checkpoint over what has come since; its rows and the state that it leaves. Timers keep such a query going, so it is stopped."""
        source = spark.readStream.schema(SCHEMA).parquet(str(folder))
        got = []
        query = (make(source).writeStream.foreachBatch(lambda f, i: got.extend(tuple(r) for r in f.collect())).outputMode(mode)
                 .option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="200 milliseconds").start())
        try:
            until = time.time() + 40
            while time.time() < until and query.isActive:
                seen = [p["numInputRows"] for p in query.recentProgress]
                if any(seen) and len(seen) > 1 + max(i for i, n in enumerate(seen) if n):
                    break
                time.sleep(0.1)
            assert any(seen), query.exception()
            left = [o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"]]
        finally:
            query.stop()
        return sorted(got, key=str), left[-1] if left else None

    return add, run


def test_positions_end(feed):
    add, run = feed
    monitor = lambda t: s.position_monitor(t, 0.1, "close", 3_600_000)
    add((1, "view", 10.0), (1, "view", 12.0), (2, "view", 5.0), (3, "view", 7.0), (3, "view", None))
    got, held = run(monitor, "ck", "update")
    assert got == [(1, "open", 12.0, 2), (2, "open", 5.0, 1), (3, "open", 7.0, 1)]
    add((1, "view", 11.0), (2, "close", None), (3, "view", 6.0))
    got, fewer = run(monitor, "ck", "update")  # a restart knows the peaks
    assert got == [(1, "open", 12.0, 3), (2, "closed", 5.0, 1), (3, "trailing", 7.0, 2)]
    assert fewer < held


def test_silent_positions_expire(feed):
    add, run = feed
    monitor = lambda t: s.position_monitor(t, 0.1, "close", 1)
    add((1, "view", 10.0), (1, "view", 12.0))
    got, left = run(monitor, "ck", "update")
    assert got == [(1, "expired", 12.0, 2), (1, "open", 12.0, 2)] and not left
    add((1, "view", 3.0))
    assert (1, "open", 3.0, 1) in run(monitor, "ck", "update")[0]  # a new position, not the old peak


def test_reviews_are_not_repeated(feed):
    add, run = feed
    reviews = lambda t: s.pending_reviews(t, 3, 60_000)
    add((1, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0))
    assert run(reviews, "ck")[0] == []
    add((1, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0))
    assert run(reviews, "ck")[0] == [(1, 1, 4, 3)]
    add(*[(1, "a", 1.0)] * 5)
    assert run(reviews, "ck")[0] == [(1, 5, 8, 3), (1, 9, 11, 3)]


def test_old_ids_go(feed):
    add, run = feed
    reviews = lambda t: s.pending_reviews(t, 3, 1_000)
    add((1, "a", 1.0), (1, "a", 1.0))
    run(reviews, "ck")
    time.sleep(1.5)
    add((1, "a", 1.0))
    assert run(reviews, "ck")[0] == []


def test_slots_are_reported_once(feed):
    add, run = feed
    slots = lambda t: s.reported_slots(t, "10 minutes", 60_000)
    add(*[(1, "a", 1.0)] * 12, (2, "a", 1.0))
    assert [(c, i) for c, _, i in run(slots, "ck")[0]] == [(1, 1), (1, 10), (2, 13)]
    add(*[(1, "a", 1.0)] * 8)
    assert [(c, i) for c, _, i in run(slots, "ck")[0]] == [(1, 20)]
