"""What a task holds and what is shuffled: plans of the steps that grew faster than their input, at a small size."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera import registry, suite  # noqa: F401
from tessera.functions import columns as c
from tessera.operators import audit, backtest as bt, events, factors as fa, joins, models, signals
from tessera.plans import audits, events as events_plan, factors, trading
from tessera.sources import merge as mg
from tessera.sources import panel as p

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """windows by code are dealt over tasks that grow with the table, so that none holds more."""
    rows = p.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(p, "ROWS_A_TASK", 100)
    assert p.tasks(spark, SF) == -(-rows // 100)
    assert f"hashpartitioning(code#" in plan(factors.full_bars(spark, SF)) and f", {-(-rows // 100)}), REPARTITION_BY_NUM" in plan(factors.full_bars(spark, SF))


def test_sorts_of_indicators(spark):
    """the 13 windows share 7 sorts (11 before, and one more for the last bar)."""
    bars = spark.range(100).select(F.lit("a").alias("code"), F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), *[F.sin(F.col("id").cast("double")).alias(x) for x in ("open", "close", "high", "low", "volume")])
    x = signals.indicators(bars).filter("last")
    assert plan(x).count("Sort [") <= 7
    assert [r.date for r in x.select("date").collect()] == [dt.date(2024, 4, 9)]


def test_ranks_are_dealt(spark):
    """groups are ranked in as many tasks as asked for."""
    rows = spark.createDataFrame([("f", m, float(i), float(i * m % 7)) for m in (1, 2) for i in range(10)], "factor string, month int, value double, fwd double")
    slices = [audit.Slice("sample", "all", "fwd")]
    assert ", 37), REPARTITION_BY_NUM" in plan(audit.sliced_ic(rows, slices, tasks=37))
    assert audit.sliced_ic(rows, slices, tasks=37).collect() == audit.sliced_ic(rows, slices).collect()
    assert ", 37), REPARTITION_BY_NUM" in plan(c.rank_ic(rows, "value", "fwd", ["factor", "month"], tasks=37))


def test_carried_values_move_once(spark):
    """Each value goes to the places before the next one: one shuffle, no row twice."""
    values = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 20, 5.0), ("b", 2, 2.0), ("b", 2, 2.0)], "code string, i long, v double")
    x = joins.carried(values, "v", 5, ["code"], "i")
    assert plan(x).count("Exchange") == 1
    want = {("a", 1): 1.0, ("a", 2): 1.0} | {("a", i): 3.0 for i in range(3, 9)} | {("a", i): 5.0 for i in range(20, 26)} | {("b", i): 2.0 for i in range(2, 8)}
    got = x.collect()
    assert {(r.code, r.i): r.v for r in got} == want and len(got) == len(want)


def test_first_merge_is_written_once(spark, tmp_path, monkeypatch):
    """a first update makes the table without a copy in the shared folder."""
    monkeypatch.setattr(mg, "written", lambda *x: pytest.fail("copied"))
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", 3.0)], "id int, day string, v double")
    assert mg.merge(spark, str(tmp_path / "t"), rows.limit(0), ["id", "day"], "day") == 0
    assert mg.merge(spark, str(tmp_path / "t"), rows, ["id", "day"], "day") == 2
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("id", "day", "v").collect()) == [(1, "a", 2.0), (2, "b", 3.0)]


@pytest.mark.parametrize("name", ["fa17_j6_valuation_ffill", "m34_landing_checks", "a10_horizon_ic", "m22_neutralization_audit", "m30_contract_json", "m29_experiments", "m25_layered_audit"])
def test_bars_are_made_once(spark, name):
    """What is read many times is written once, so that the rows of trades are not aggregated again."""
    assert not [f for f in registry.QUERIES[name](spark, SF).inputFiles() if "lineitem" in f]


def test_last_closes(spark):
    """the last close of each code without its bars."""
    want = p.bars(spark, SF).groupBy("code").agg(F.max_by("close", "date").alias("price"))
    got = p.last_closes(spark, SF)
    assert plan(got).count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scores_of_signal_days_alone_move(spark):
    """scores of other days are left out before the shuffle."""
    quoted = bt.quotes(p.bars(spark, SF))
    scores = p.bars(spark, SF).select("code", "date", F.col("close").alias("s"))
    assert "LeftSemi" in plan(bt.select_names(quoted, scores, "s", {"": bt.Rules(min_listed_days=1, max_price=1e9)}))


def test_sums_of_lots_are_made_once(spark):
    """F16: buys, sells and rests read written running sums."""
    rows = spark.createDataFrame([("a", 1, "buy", 5.0), ("a", 2, "sell", 7.0)], "code string, id long, direction string, volume double")
    lots = joins.fifo_lots(rows, "code", ["id"], strict=True)
    assert lots.inputFiles() and sorted((r.buy_id, r.alloc) for r in lots.collect() if r.buy_id) == [(1, 5.0)]


def test_bars_move_once(spark):
    """the rows are dealt and sorted by code once, for the bars and all windows over them (two of each before)."""
    shown = plan(factors.price_factors(spark, SF))
    assert shown.count("Exchange ") == 1 and shown.count("Sort [") == 1


def test_long_windows_are_made_of_blocks(spark):
    """no sliding window of the factors is longer than a block, where every row took 20 and 60 steps a value before."""
    shown = plan(factors.price_factors(spark, SF))
    assert "specifiedwindowframe(RowFrame, -9, currentrow$())" in shown and "RowFrame, -59" not in shown and "RowFrame, -19" not in shown


def test_blocks_equal_whole_windows(spark):
    """Means, deviations and extremes put together from blocks are those of the whole window, nulls and short series too."""
    rows = spark.range(150).select(F.when(F.col("id") < 130, "a").otherwise("b").alias("code"), F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), (100 + 9 * F.sin(F.col("id") * F.col("id"))).alias("close"),
                                   F.when(F.col("id") != 77, F.cos("id") + 2).alias("turnover"))
    ret = c.pct_change("close")
    dd = -(F.col("close") / c.roll(F.max, "close", 60, 20) - 1)
    want = rows.withColumns({"ret": ret, "dd": dd}).select("code", "date", (c.roll(F.stddev_samp, "ret", 60) * F.sqrt(F.lit(252.0))).alias("v"), c.roll(F.avg, "turnover", 20).alias("t"), c.roll(F.max, "dd", 60, 20).alias("d"))
    got = fa.compute_factors(rows, ["vol_60d_realized", "liq_20d_turnover", "astock_maxdd_60d"])
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect())), strict=True):
        assert all(x == y or (None not in (x, y) and abs(x - y) <= 1e-12 * abs(y)) for x, y in zip(a, b, strict=True)), (a, b)


def test_means_are_added_from_the_first_row_on(spark):
    """F2: scores that are equal but for their last digits are ordered by these, so a mean of 20 rows is the same double as that of one window, which the means of its blocks missed."""
    values = [(i * i * 7 % 50 + 1) / 10.0 for i in range(60)]
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, v) for i, v in enumerate(values)], "code string, date date, close double, turnover double")
    got = [r.liq_20d_turnover for r in fa.compute_factors(rows, ["liq_20d_turnover"]).orderBy("date").collect()]
    want = [None] * 19
    for end in range(20, 61):
        total = 0.0
        for v in values[end - 20 : end]:  # sum() of Python adds with a correction
            total += v
        want.append(total / 20)
    assert got == want
    whole = rows.select("date", c.roll(F.avg, "turnover", 20).alias("t")).orderBy("date").collect()
    assert got == [r.t for r in whole]


def test_ranks_share_a_sort(spark):
    """a side's ranks and its ties are told by one sort (two before), and a correlation that is 0 has no sign, however its rows come."""
    pairs = [(3.0, 3.0), (10.0, 6.0), (8.0, 8.0), (2.0, 7.0), (7.0, 4.0), (4.0, 5.0), (5.5, 2.0), (5.5, 1.0), (9.0, 9.0), (1.0, 10.0)]
    for rows in (pairs, sorted(pairs), sorted(pairs, reverse=True), sorted(pairs, key=lambda r: r[1])):
        df = spark.createDataFrame([("g", *r) for r in rows], "g string, x double, y double")
        ic = c.rank_ic(df, "x", "y", ["g"])
        assert plan(ic).count("Sort [") == 2
        assert [tuple(r) for r in ic.collect()] == [("g", 0.0, 10)]


def test_fits_are_made_once(spark):
    """figures and Newey-West t of the coefficients come from one pass over the fits (two before, with all that lies below them)."""
    rows = spark.createDataFrame([(dt.date(2024, m, 1), float(i), float(i * m % 7)) for m in (1, 2, 3) for i in range(40)], "month date, x double, y double")
    assert plan(models.coefficient_summary(models.cross_section_models(rows, "month", ["x"], "y"), "2024-02-01")).count("MapInPandas") == 1


def test_last_bars_are_made_once(spark):
    """the mean change and the scores read the same written last bars."""
    shown = plan(trading.g7(spark, SF))
    assert "Window" not in shown and shown.count("last_bars-") >= 1 and "lineitem" not in shown


def test_scores_beside_the_bars(spark):
    """a panel with its scores gives the backtest that a frame of scores gives, without a join of both."""
    b = p.bars(spark, SF)
    scores = b.select("code", "date", (F.col("volume") * 1.0).alias("s"))
    both = b.withColumn("s", F.col("volume") * 1.0)
    rules = bt.Rules(min_listed_days=1, max_price=1e9)
    want, got = bt.rebalance(b, scores, "s", rules=rules), bt.rebalance(both, None, "s", rules=rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert plan(got).count("LeftSemi") == 0 < plan(want).count("LeftSemi")


def test_days_around_need_no_window(spark):
    """the days of an event's window are counted by what is gathered there, without windows over the code as a whole (one before)."""
    r = spark.createDataFrame([("a", i, 0.01 * (i % 3)) for i in range(40)], "code string, cal_idx int, r double")
    study = events.day_study(spark.createDataFrame([(20,)], "t0_idx int"), r, r.select("cal_idx", "r"), est=(-15, -6), win=(-5, 5), least_obs=5, least_codes=1)
    assert "windowspecdefinition(code" in plan(study) and "unboundedpreceding$(), unboundedfollowing$()" not in plan(study)
    assert sorted(x.rel_day for x in study.collect()) == list(range(-5, 6))


def test_events_are_dealt(spark, monkeypatch):
    """the rows that events make are spread over tasks that grow with the events, however few splits their file has."""
    monkeypatch.setattr(p, "ROWS_A_TASK", 100)
    assert f"hashpartitioning(event_id#" in plan(events_plan.m19(spark, SF)) and f", {p.tasks(spark, SF, 'orders')}), REPARTITION_BY_NUM" in plan(events_plan.m19(spark, SF))


def test_month_ends_are_made_where_the_bars_lie(spark, monkeypatch):
    """no valuation is spread over the days that it is held (and sorted there by code and month); trades and reports are dealt by code over tasks that grow with the trades, and nothing moves by code again."""
    monkeypatch.setattr(p, "ROWS_A_TASK", 100)
    shown = plan(audits.fundamentals(spark, SF))
    assert "sequence(" not in shown and "explode(" not in shown and "bars-" not in shown
    assert shown.count(f", {p.tasks(spark, SF)}), REPARTITION_BY_NUM") == 2
    assert shown.count("Exchange ") == 6  # these, the orders of the reports, and the calendar: its dates, their order, its months to all tasks


def test_dealing_reads_small_splits(spark, monkeypatch):
    """a task that deals the rows of trades reads a bounded part of a file, as it holds them; a smaller setting stays."""
    key = "spark.sql.files.maxPartitionBytes"
    monkeypatch.setattr(p, "SPLIT_BYTES", 32 << 10)
    kept = spark.conf.get(key)
    try:
        for given, want in (("128m", "32768"), ("1g", "32768"), ("134217728b", "32768"), ("40000", "32768"), ("8k", "8k"), ("8192", "8192")):
            spark.conf.set(key, given)
            p.bars(spark, SF)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, kept)
