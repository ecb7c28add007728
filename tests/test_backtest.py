"""Hand-checked cases of the rebalance backtest: sales put off, price bounds, scores and capital by variant."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import backtest as bt
from tessera.operators import joins
from tessera.plans import state

START = dt.date(2023, 1, 2)


def weekdays(n):
    days = [START + dt.timedelta(i) for i in range(2 * n)]
    return [d for d in days if d.weekday() < 5][:n]


def bars(spark, series):
    """``series``: code to (date, open, close) rows."""
    rows = [(c, d, o, x, max(o, x), min(o, x), 1e6) for c, values in series.items() for d, o, x in values]
    return spark.createDataFrame(rows, "code string, date date, open double, close double, high double, low double, volume double")


def test_sale_waits_for_an_open_above_the_limit(spark):
    """Days 1 and 2 open at the lower limit, day 3 is not traded, day 4 sells; a name that never opens is not sold."""
    quotes = spark.createDataFrame(
        [("a", 1, 9.0, True), ("a", 2, 8.1, True), ("a", 4, 8.0, False), ("a", 5, 7.0, False), ("b", 1, 5.0, False), ("c", 1, 3.0, True), ("c", 11, 3.0, False), ("d", 1, None, False), ("d", 3, 4.0, False)],
        "code string, cal_idx long, open double, blocked boolean")
    wanted = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("a", 1), ("e", 1)], "code string, exit_idx long")
    got = {r.code: (r.exit_open, r.sold_idx) for r in joins.first_sellable(wanted, quotes, 10).collect()}
    assert got == {"a": (8.0, 4), "b": (5.0, 1), "d": (4.0, 3)}


def test_backtest_defers_a_limit_down_exit(spark):
    """The exit day opens 10 % down: the sale is at the next open; the value is that of the fill less the fees."""
    days = weekdays(70)
    at = {m: max(i for i, d in enumerate(days) if d.month == m) for m in (1, 2)}
    out = at[2] + 1
    close = [10.0] * 70
    series = [(d, 9.0 if i == out else 10.5 if i == out + 1 else 10.0, close[i]) for i, d in enumerate(days)]
    panel = bars(spark, {"600001": series})
    scores = panel.select("code", "date", F.lit(1.0).alias("s"))
    got = bt.rebalance(panel, scores, "s", rules=bt.Rules(min_listed_days=1)).orderBy("signal").first()
    fees = 2 * 250.0 + 1e6 * (0.001 + 0.001 * 2 + 0.00001 * 2)
    assert (got.signal, got.entry, got.exit, got.tradable) == (days[at[1]], days[at[1] + 1], days[out], 1.0)
    assert got.period_ret == pytest.approx(10.5 / 10.0 - 1 - fees / 1e6) and got.nav > 1


def test_price_bounds_and_listed_days(spark):
    """A close of 3 and of 500 may be bought, below and above may not; a name listed too short may not."""
    days = weekdays(70)
    names = {"600001": 3.0, "600002": 2.99, "600003": 500.0, "600004": 500.01, "600005": 20.0}
    series = {c: [(d, x, x) for d in (days[15:] if c == "600005" else days)] for c, x in names.items()}
    panel = bars(spark, series)
    quoted = bt.quotes(panel)
    scores = panel.select("code", "date", F.lit(1.0).alias("s"))
    first = days[max(i for i, d in enumerate(days) if d.month == 1)]
    picked = lambda rules: {r.code for r in bt.select_names(quoted, scores, "s", {"": rules}).filter(F.col("signal") == F.lit(first)).collect()}
    assert picked(bt.Rules(top_quantile=1.0, min_listed_days=20)) == {"600001", "600003"}
    assert picked(bt.Rules(top_quantile=1.0, min_listed_days=5)) == {"600001", "600003", "600005"}
    assert picked(bt.Rules(top_quantile=1.0, min_listed_days=20, max_price=1e9, min_price=0.0)) == {"600001", "600002", "600003", "600004"}


def test_variants_have_their_own_scores_and_capital(spark):
    days = weekdays(70)
    panel = bars(spark, {"600001": [(d, 10.0 + i / 100, 10.0 + i / 100) for i, d in enumerate(days)], "600002": [(d, 20.0 - i / 100, 20.0 - i / 100) for i, d in enumerate(days)]})
    scores = panel.select("code", "date", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("variant")).withColumn("s", F.when((F.col("variant") == "up") == (F.col("code") == "600001"), 1.0).otherwise(0.0))
    rules = {"up": bt.Rules(min_listed_days=1, max_holdings=1), "down": bt.Rules(min_listed_days=1, max_holdings=1, initial_capital=1e3)}
    got = {r.variant: r for r in bt.rebalance_variants(panel, scores, "s", bt.Costs(), rules).filter(F.month("signal") == 1).collect()}
    alone = bt.rebalance(panel, scores.filter("variant = 'up'").drop("variant"), "s", rules=rules["up"]).filter(F.month("signal") == 1).first()
    assert got["up"].period_ret == pytest.approx(alone.period_ret) and got["up"].period_ret > 0 > got["down"].period_ret
    i = max(i for i, d in enumerate(days) if d.month == 1) + 1
    j = max(i for i, d in enumerate(days) if d.month == 2) + 1
    assert got["down"].period_ret == pytest.approx((20 - j / 100) / (20 - i / 100) - 1 - (2 * 5.0 + 1e3 * 0.00302) / 1e3)


def test_growth_of_what_falls_below_zero(spark, monkeypatch):
    """the logarithm of a value below zero is NaN as in SQL (null before), and that of a very small value keeps its digits."""
    months = [dt.date(2024, m, 1) for m in (1, 2, 3)]
    returns = {"mom_1": (0.5, 0.0, 1.0), "vol_20d_atr": (0.5, -1.5, 0.1), "liq_20d_turnover": (-1 + 1e-7, -1 + 1e-7, -1 + 1e-7)}
    rows = []
    for variant, each in returns.items():
        nav = 1.0
        for month, r in zip(months, each, strict=True):
            nav *= 1 + r
            rows.append((variant, month, r, nav))
    monkeypatch.setattr(state.bt, "rebalance_variants", lambda *_: spark.createDataFrame(rows, "variant string, signal date, period_ret double, nav double"))
    got = {r.experiment: r.log_growth for r in state.m29(spark, "/root/testdata/sf0.001").collect()}
    assert got["mom_1"] == pytest.approx(math.log(3.0), abs=1e-5) and math.isnan(got["vol_20d_atr"]) and got["liq_20d_turnover"] == pytest.approx(3 * math.log(1e-7), abs=1e-5)
