"""Streams over what there is equal their batch twins, but for windows that are still open."""

from tessera.sources import panel as p
from tessera.streaming import monitors as m

SF = "/root/testdata/sf0.001"


def test_hour_bars(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    m.run_available(m.tick_bars(m.tick_stream(spark, str(tmp_path / "in"))), "bars", str(tmp_path / "ck"))
    got = {(r.w.start, r.code): (r.open, r.close, r.ticks) for r in spark.table("bars").collect()}
    want = {(r.w.start, r.code): (r.open, r.close, r.ticks) for r in m.tick_bars(p.ticks(spark, SF)).collect()}
    assert len(got) > 0.9 * len(want)
    assert all(want[k] == v for k, v in got.items())


def test_stateful_monitors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    m.run_available(m.trailing_peaks(m.tick_stream(spark, str(tmp_path / "in"))), "peaks", str(tmp_path / "ck1"), "update")
    got = {}
    for r in spark.table("peaks").collect():
        got[r.code] = max(got.get(r.code, (0, 0)), (r.seen, r.peak))
    want = {r.code: (r.seen, r.peak) for r in p.ticks(spark, SF).groupBy("code").agg({"price": "max", "*": "count"}).toDF("code", "peak", "seen").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    m.run_available(m.pending_batches(m.tick_stream(spark, str(tmp_path / "in")), 5), "pending", str(tmp_path / "ck2"), "update")
    done = {}
    for r in spark.table("pending").collect():
        done[r.code] = max(done.get(r.code, 0), r.batches)
    assert done == {k: v[0] // 5 for k, v in want.items() if v[0] >= 5}


def stream(spark, folder, files=3):
    folder.mkdir()
    spark.read.parquet(f"{SF}/events.parquet").sort("ts").coalesce(1).write.mode("overwrite").parquet(str(folder / "all"))
    rows = spark.read.parquet(str(folder / "all"))
    for i in range(files):
        rows.filter(f"event_id % {files} = {i}").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return str(folder / "in")


def test_sessions_and_slots(spark, tmp_path):
    """Closed sessions are those of the batch; each code and slot comes once."""
    path = stream(spark, tmp_path / "s", 1)
    m.run_available(m.sessions(m.tick_stream(spark, path)), "sessions", str(tmp_path / "ck"))
    key = lambda r: (r.code, r.s.start, r.s.end, r.ticks)
    got, want = {key(r) for r in spark.table("sessions").collect()}, {key(r) for r in m.sessions(p.ticks(spark, SF)).collect()}
    assert got and got <= want and len(got) > 0.9 * len(want)
    m.run_available(m.once_per_slot(m.tick_stream(spark, path)), "slots", str(tmp_path / "ck2"))
    slots = [(r.code, r.slot) for r in spark.table("slots").collect()]
    assert len(slots) == len(set(slots)) and set(slots) == {(r.code, r.slot) for r in m.once_per_slot(p.ticks(spark, SF)).collect()}


def test_orders_after_signals(spark, tmp_path):
    path = stream(spark, tmp_path / "s", 1)
    parts = lambda t: (t.filter("event_id % 5 = 0"), t.filter("event_id % 5 <> 0"))
    m.run_available(m.orders_after_signals(*parts(m.tick_stream(spark, path))), "matched", str(tmp_path / "ck"))
    rows = lambda df: sorted((r.signal_id, r.order_id) for r in df.collect())
    assert rows(spark.table("matched")) == rows(m.orders_after_signals(*parts(p.ticks(spark, SF)))) != []


def test_fresh_names_each_trigger(spark, tmp_path):
    """The table is read again for each batch, on a trigger of its own."""
    path, seen = stream(spark, tmp_path / "s"), {}

    def read(session):
        return session.range(1000).selectExpr("id AS code", f"{len(seen)} AS version")

    def write(frame, batch_id):
        seen[batch_id] = (frame.count(), {r.version for r in frame.select("version").distinct().collect()})

    query = m.run_each(m.enriched_batches(m.tick_stream(spark, path), read, ["code"], write), str(tmp_path / "ck"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert sum(n for n, _ in seen.values()) == spark.read.parquet(path).count()
    assert [v - {None} for _, v in sorted(seen.items()) for v in [v[1]]] == [{i} for i in range(len(seen))]
