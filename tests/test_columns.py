"""Hand-checked cases of the column functions and operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import events, joins, ledger, models, signals
from tessera.operators.factors import limit_up
from tessera.operators.scans import with_ewm
from tessera.plans.factors import available_from


def days(spark, values, kind="double"):
    return spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(values)], f"code string, date date, x {kind}")


def column(df, *names):
    rows = df.orderBy("date").collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_rounding_beyond_a_long(spark):
    """F2: a value times its scale beyond 2**63 stays as it is; a long would give 92233720368547.77."""
    values = [1.7479256936840843e33, -3e20, 1.2345678, -1.2345678, 9e12, None]
    assert column(days(spark, values).withColumn("y", c.rnd("x", 5)), "y") == [1.7479256936840843e33, -3e20, 1.23457, -1.23457, 9e12, None]


def test_roll_needs_all_values(spark):
    df = days(spark, [1.0, None, 3.0, 4.0, 5.0]).withColumn("y", c.roll(F.avg, "x", 3))
    assert column(df, "y") == [None, None, None, None, 4.0]


def test_fill_is_limited(spark):
    df = days(spark, [1.0] + [None] * 6)
    assert column(df.withColumn("y", joins.ffill(df, "x", 5, ["code"], "date")), "y") == [1.0] * 6 + [None]


def test_average_rank_and_safe_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "x double, y double").withColumn("g", F.lit(1))
    assert sorted(r[0] for r in df.select(c.average_rank("x", "g")).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert df.agg(c.safe_corr("x", "y")).first()[0] is None


def test_ewm_is_the_adjusted_mean(spark):
    values = np.random.default_rng(1).normal(size=1500).tolist()
    for span in (1.5, 12, 26, 300):
        df = with_ewm(days(spark, values), {"y": ("x", 1 - 2 / (span + 1))})
        assert np.allclose(column(df, "y"), pd.Series(values).ewm(span=span).mean())
    gaps = [None if i % 3 == 0 or 100 < i < 300 else v for i, v in enumerate(values)]
    df = with_ewm(days(spark, gaps), {"y": ("x", 1 - 2 / 13), "z": ("x", 0.5)})
    want = pd.Series(gaps, dtype=float).ewm(span=12, ignore_na=True).mean()
    assert column(df, "y")[0] is None and np.allclose(column(df, "y")[1:], want[1:]) and df.columns[-2:] == ["y", "z"]


def test_clip_keeps_null_and_cdf(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double").select(c.clip("x", -1.0, 1.0).alias("y"), c.normal_cdf(F.lit(1.959964)).alias("p"))
    rows = df.collect()
    assert [r["y"] for r in rows] == [None, 1.0]
    assert abs(rows[0]["p"] - 0.975) < 1e-6


def test_limit_boundary(spark):
    df = spark.createDataFrame([(10.95,), (10.96,)], "p double").select(limit_up(F.lit("600001"), F.lit(10.0), F.col("p")).alias("up"))
    assert [r["up"] for r in df.collect()] == [False, True]


def test_disclosure_day(spark):
    df = spark.createDataFrame([(dt.date(2023, 12, 31),)], "d date").select(available_from(F.col("d")).alias("d"))
    assert df.first()["d"] == dt.date(2024, 4, 29)


def test_asof_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "code string, t int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0), ("a", 5, 15.0)], "code string, t int, v double")
    got = {(r.code, r.t): r.v for r in joins.asof_backward(left, right, ["code"], "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 20.0, ("b", 2): None}
    cal = spark.createDataFrame([(dt.date(2023, 12, 29), 1), (dt.date(2024, 1, 2), 2)], "date date, cal_idx long")
    ev = spark.createDataFrame([(1, dt.date(2023, 12, 30)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 3))], "event_id int, d date")
    assert {r.event_id: r.t0_idx for r in joins.asof_forward(ev, cal, "d").collect()} == {1: 2, 2: 2, 3: None}


@pytest.mark.parametrize(("volumes", "expected"), [([100.0, 200.0, -150.0], {1: 100.0, 2: 50.0}), ([100.0, -150.0], {1: 100.0, None: 50.0})])
def test_fifo(spark, volumes, expected):
    rows = [("a", i + 1, "buy" if v > 0 else "sell", abs(v)) for i, v in enumerate(volumes)]
    df = spark.createDataFrame(rows, "code string, id long, direction string, volume double")
    assert {r.buy_id: r.alloc for r in joins.fifo_lots(df, "code", ["id"], width=64.0).collect()} == expected


def test_replay_rejects_same_day_sale(spark):
    t = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", 1, t[0], "buy", 10.0, 100.0), ("a", 2, t[1], "buy", 12.0, 100.0), ("a", 3, t[1], "sell", 13.0, 150.0), ("a", 4, t[1], "sell", 13.0, 100.0)], "code string, id long, ts timestamp, direction string, price double, volume double")
    r = ledger.replay(df, ["id"]).first()
    assert (r.held, r.cost, r.pnl, r.rejected) == (100.0, 11.0, 200.0, 1)


def test_bh_and_sizing(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double").withColumn("k", F.lit(1))
    got = {r.i: round(r.p_adj, 10) for r in events.benjamini_hochberg(df, ["k"], "p", "i").collect()}
    assert got == {1: 0.03, 2: 0.04, 3: 0.04}
    assert df.select(ledger.order_volume(F.lit(1e6), F.lit(0.2), F.lit(1e6), F.lit(0.05), F.lit(33.0))).first()[0] == 1500


def test_negated_advice(spark):
    texts = [("不建议买入",), ("建议买入",), ("[信号] 卖出。止损",), ("",), (None,)]
    df = spark.createDataFrame(texts, "t string").select(signals.parse_action(F.col("t")).alias("a"))
    assert [r.a for r in df.collect()][:4] == ["hold", "buy", "sell", "hold"]


def test_dense_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [0.5, -0.2] + 0.01 * rng.normal(size=200)
    sums = lambda x: (lambda a: a.T @ a)(np.column_stack([np.ones(len(x)), x, y]))
    beta, t, r2 = models.ols(sums(x))
    a = np.column_stack([np.ones(200), x])
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    error = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * ((y - a @ want) ** 2).sum() / 197)
    assert np.allclose(beta, want) and np.allclose(t, want / error, rtol=1e-5) and abs(r2 - 1 + ((y - a @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum()) < 1e-9
    assert np.allclose(models.ridge(sums(x), 0.0), beta)
    assert np.allclose(models.ridge(sums(x), 3.0), np.linalg.solve(a.T @ a + np.diag([0, 3.0, 3.0]), a.T @ y))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(models.lasso(sums(z), 0.001), models.ols(sums(z))[0], atol=1e-4)
    assert (models.lasso(sums(z), 1e6)[1:] == 0).all()
    twice = np.column_stack([x[:, 0], x[:, 0]])
    assert np.allclose(models.ols(sums(twice))[0], np.linalg.lstsq(np.column_stack([np.ones(200), twice]), y, rcond=None)[0])
    r = rng.normal(size=600) * np.repeat([0.01, 0.03, 0.01], 200)
    assert 0.5 < models.fit_garch(r)["persistence"] < 1
    regime = np.column_stack([np.repeat([0.01, -0.02], 60) + 0.002 * rng.normal(size=120), np.repeat([0.1, 0.4], 60)])
    assert models.two_state_hmm(regime)[:60].mean() > 0.9 and models.two_state_hmm(regime)[60:].mean() < 0.1
