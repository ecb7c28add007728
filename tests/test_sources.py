"""Sources and sinks: round trips in each format, bounded reads, reports."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import factors
from tessera.sources import panel as p

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, tmp_path, kind):
    bars = p.bars(spark, SF).limit(200).select("code", "date", "close", "volume").cache()
    p.write_table(bars, str(tmp_path / kind), kind)
    back = p.read_table(spark, str(tmp_path / kind), bars.schema, kind)
    assert sorted(map(tuple, back.select(*bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    assert back.first().code.isdigit() and len(back.first().code) == 6
    bars.unpersist()


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("date,rule,hmm\n2024-01-02,bull,牛\n".encode("utf-8-sig"))
    r = p.read_table(spark, str(tmp_path / "a.csv"), "date date, rule string, hmm string", "csv").first()
    assert (str(r.date), r.rule, r.hmm) == ("2024-01-02", "bull", "牛")


def test_partitioned_write_prunes(spark, tmp_path):
    bars = p.bars(spark, SF)
    p.write_table(bars.select("code", "close", "date"), str(tmp_path / "b"), partition=["code"])
    plan = p.read_table(spark, str(tmp_path / "b")).filter("code = '000001'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(code" in plan


def test_report(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").orderBy("a")
    assert p.report_lines(df, "T") == "# T\n\n| a | b |\n|---|---|\n| 1 | x |\n| 2 |  |"


def test_padded_dates(spark):
    """A lead for the windows: factors from the first date on are those of the whole panel."""
    panel = spark.range(3 * 400).selectExpr("lpad(id % 3, 6, '0') AS code", "date_add(DATE '2020-01-01', CAST(id DIV 3 AS INT)) AS date", "100 + 10 * sin(id) AS close", "101 + 10 * sin(id) AS high", "99 + 10 * sin(id) AS low")
    names, first = ["mom_1", "vol_20d_atr"], "2020-10-01"
    cut = factors.padded(panel, names, first)
    assert cut.count() < panel.count()
    rows = lambda df: sorted(tuple(r) for r in factors.compute_factors(df, names).filter(f"date >= '{first}'").collect())
    assert rows(cut) == rows(panel) != []


def test_minute_bars(spark):
    """Edges of the bars, ties of time, rows that count nowhere, the newest n of a code."""
    ticks = spark.createDataFrame([("a", "2024-01-02 09:30:00", 1, 10.0), ("a", "2024-01-02 09:34:59.999", 2, 12.0), ("a", "2024-01-02 09:35:00", 4, 9.0), ("a", "2024-01-02 09:35:00", 3, 11.0), ("a", "2024-01-02 10:00:00", 5, 8.0),
                                   ("a", "2024-01-02 10:01:00", 6, None), ("a", None, 7, 1.0), (None, "2024-01-02 10:01:00", 8, 1.0), ("b", "2024-01-02 09:30:00", 9, 5.0)], "code string, ts string, event_id long, price double").withColumn("ts", F.col("ts").cast("timestamp"))
    made = p.minute_bars(ticks, [5, 30])
    bars = {(r.code, r.minutes, f"{r.start:%H:%M}"): (r.open, r.high, r.low, r.close, r.volume) for r in made.collect()}
    assert bars == {("a", 5, "09:30"): (10.0, 12.0, 10.0, 12.0, 2), ("a", 5, "09:35"): (11.0, 11.0, 9.0, 9.0, 2), ("a", 5, "10:00"): (8.0, 8.0, 8.0, 8.0, 1), ("b", 5, "09:30"): (5.0, 5.0, 5.0, 5.0, 1),
                    ("a", 30, "09:30"): (10.0, 12.0, 9.0, 9.0, 4), ("a", 30, "10:00"): (8.0, 8.0, 8.0, 8.0, 1), ("b", 30, "09:30"): (5.0, 5.0, 5.0, 5.0, 1)}
    last = p.tail(made, ["code", "minutes"], "start", 1)
    assert sorted((r.code, r.minutes, r.close) for r in last.collect()) == [("a", 5, 8.0), ("a", 30, 8.0), ("b", 5, 5.0), ("b", 30, 5.0)]
    two = p.tail(made, ["code", "minutes"], "start", F.when(F.col("minutes") == 5, 2).otherwise(1), 2)
    assert sorted((r.code, r.minutes, r.close) for r in two.collect()) == [("a", 5, 8.0), ("a", 5, 9.0), ("a", 30, 8.0), ("b", 5, 5.0), ("b", 30, 5.0)]
    assert "WindowGroupLimit" in two._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString() and p.minute_bars(ticks.limit(0), [5]).count() == 0


def test_spot_snapshot(spark):
    """Second source: exchange marks, hundred millions, no ratio; bad numbers are null, rows without a code go."""
    first = spark.createDataFrame([("1", "x", "10.5", 2e9), ("2", "y", "-", None), (None, "z", "1", 1.0)], "code string, name string, price string, market_value double")
    second = spark.createDataFrame([("sz000001", "x", "9", "20"), ("sh600003", "w", "7", "12.5"), ("bj830004", "v", "", "x"), (None, "u", "1", "1")], "symbol string, name string, zxj string, zsz string")
    rows = {r.code: (r.name, r.close, r.total_mv, r.circ_mv, r.pe, r.pb) for r in p.spot_snapshot(first, second).collect()}
    assert rows == {"000001": ("x", 10.5, 2e9, None, None, None), "000002": ("y", None, None, None, None, None), "600003": ("w", 7.0, 1.25e9, None, None, None), "830004": ("v", None, None, None, None, None)}
    reported = p.earnings(spark.createDataFrame([(1, "n", "12.5", "--")], "symbol int, short_name string, roe_weighted string, margin string")).first()
    assert (reported.code, reported.roe, reported.gross_margin, reported.industry) == ("000001", 12.5, None, None)
