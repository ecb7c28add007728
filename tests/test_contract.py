"""The contract's rows, its JSON, the parameters under it, and checks that fail when they should."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import contract as ct
from tessera.operators import ledger
from tessera.sources import panel as p

METRICS = ["close", "vol"]


@pytest.fixture(scope="module")
def parts(spark):
    days = [(dt.date(2023, 1, 15) + dt.timedelta(30 * i), ["bear", "range", "bull_high_vol"][i % 3], 100.0 + i, 0.1) for i in range(15)]
    regimes = spark.createDataFrame(days, "date date, regime string, close double, vol double")
    factors = spark.createDataFrame([("a", 0.05, 3.0), ("b", -0.04, -2.5), ("c", 0.01, 0.5), ("d", 0.06, 4.0)], "factor string, mean_ic double, t double")
    crowding = spark.createDataFrame([("a", False, 1.0), ("b", False, 0.2), ("d", True, -0.5)], "factor string, crowded boolean, sharpe double")
    return regimes, factors, crowding


def test_contract(parts):
    rows = {(r.section, r.key): (r.text, r.value) for r in ct.build_contract(*parts, METRICS).collect()}
    assert rows["regime", "state"] == ("bull_high_vol", None) and rows["limits", "max_total_position"] == (None, 1.0) and rows["weights", "short"] == (None, 0.6)
    assert {k: v for (s, k), v in rows.items() if s == "factors"} == {"a": ("active", 0.05), "b": ("active", 0.05), "c": ("watch", 0.0), "d": ("crowded", 0.0)}
    assert rows["crowding", "c"] == ("false", None) and rows["metrics", "close"] == (None, 114.0) and len([1 for s, _ in rows if s == "history"]) == 12
    assert ct.build_contract(parts[0].limit(0), parts[1].limit(0), parts[2], METRICS).count() == 0


def test_json_and_parameters(spark, parts):
    contract = ct.build_contract(*parts, METRICS)
    back = {(r.section, r.key): r.entry for r in ct.read_json(ct.as_json(contract)).collect()}
    assert back["regime", "state"] == "bull_high_vol" and float(back["limits", "min_cash_pct"]) == 0.3 and back["factors", "d"] == "crowded"
    stored = spark.createDataFrame([("max_total_position", 0.8), ("max_hold_days", 30.0)], "key string, value double")
    assert {tuple(r) for r in ct.effective_parameters(stored, contract).collect()} == {("max_total_position", 1.0, True), ("max_hold_days", 30.0, False)}


def test_checks_fail_when_they_should(spark, parts):
    contract = ct.build_contract(*parts, METRICS)
    snapshot = spark.createDataFrame([(1.0,), (2.0,), (None,)], "pb double")
    failing = lambda c, s=snapshot, n=4: {r.check_name for r in ct.landing_checks(c, s, n).collect() if not r.ok}
    assert failing(contract) == {"cash_leaves_room"}  # a bull market's limit of 1.0 leaves no 30 % of cash
    assert failing(contract, n=5) == {"cash_leaves_room", "factor_states", "crowding_told"}
    assert "book_ratio_coverage" in failing(contract, spark.createDataFrame([(1.0,), (None,)], "pb double"))
    assert "weights_sum_to_one" in failing(contract.withColumn("value", F.when(F.col("key") == "long", 0.2).otherwise(F.col("value"))))
    assert "a_factor_is_active" in failing(contract.filter("not (section = 'factors' and value > 0)"))
    assert "regime_known" in failing(contract.withColumn("text", F.when(F.col("key") == "state", "up").otherwise(F.col("text"))))
    assert len(failing(contract.limit(0))) >= 10


def test_policy_overlay(spark):
    states = spark.createDataFrame([("plan", "active", 0.05, 0.01234, 7), ("tax", "active", 0.05, -0.02, 3), ("rate", "watch", 0.0, 0.01, 9)], "kind string, status string, weight double, mean_car double, n_events long")
    got = {r.kind: r.text for r in ct.policy_overlay(states, spark.createDataFrame([("plan",), ("rate",), ("plan",)], "kind string")).collect()}
    assert got == {"plan": "研究层政策因子 policy_plan：active，CAR +1.23%，样本 7，窗口内有 plan 事件", "tax": None, "rate": None}


def test_damped_confidence_and_codes(spark):
    rows = spark.createDataFrame([(65.0, 90.0, 70.0), (65.0, 62.9, 62.0), (42.0, 30.0, 40.0), (88.0, 99.0, 90.0), (65.0, None, 65.0)], "now double, wanted double, want double")
    assert all(r.got == r.want for r in rows.withColumn("got", ledger.damped(F.lit("min_confidence"), F.col("now"), F.col("wanted"))).collect())
    codes = spark.createDataFrame([("sh600519",), (" SZ000001 ",), ("600519.XSHG",), ("bj430047",), ("300001",)], "s string").select(p.plain_code(F.col("s")).alias("c"))
    assert [r.c for r in codes.collect()] == ["600519", "000001", "600519", "430047", "300001"]
