"""Whole results: no query reads a part of the rows that it is asked for."""

import numpy as np

from tessera import registry, suite  # noqa: F401  (suite registers the queries)
from tessera.operators import events as ev
from tessera.plans.sql import BARS, with_
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


def test_all_events(spark, duck):
    """Every order is an event."""
    frame = registry.QUERIES["j8_event_days"](spark, SF).toPandas()
    last = str(duck.execute(with_(BARS) + "SELECT max(date) FROM bars").fetchdf().iloc[0, 0])[:10]
    want = duck.execute(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{last}'").fetchdf()
    assert sorted(frame.event_id) == sorted(want.o_orderkey)


def test_decisions_of_all_events(spark):
    rows = {r.kind: r for r in registry.QUERIES["a20_m20_m21_decisions"](spark, SF).collect()}
    cars = registry.QUERIES["a19_car"](spark, SF).filter("lo = -1 and hi = 5").toPandas()
    kinds = cars.event_id.map(lambda x: ["rate", "plan", "tax"][x % 3])
    for kind, part in cars.groupby(kinds):
        assert rows[kind].n_events == len(part)
        assert abs(rows[kind].mean_car - part.car.mean()) < 1e-7


def test_counted_adjustment(spark):
    rng = np.random.default_rng(0)
    days = [(k, t, float(rng.integers(1, 12) / 40), int(rng.integers(1, 5))) for k in ("a", "b") for t in range(20)]
    counted = spark.createDataFrame(days, "kind string, t long, p double, n long")
    single = spark.createDataFrame([(k, t, p, 10 * t + i) for k, t, p, n in days for i in range(n)], "kind string, t long, p double, id long")
    want = {(r.kind, r.t): r.p_adj for r in ev.benjamini_hochberg(single, ["kind"], "p", "id").collect()}
    for r in ev.benjamini_hochberg_counted(counted, ["kind"], "p", "t", "n").collect():
        assert abs(r.p_adj - want[r.kind, r.t]) < 1e-12


def test_macd_line_of_whole_series(spark, duck):
    """Each code's bars from the 20th to the last, by the recursion."""
    bars = duck.execute(with_(BARS) + "SELECT code, date, close FROM bars ORDER BY code, date").fetchdf()
    want = {}
    for code, part in bars.groupby("code"):
        s12 = w12 = s26 = w26 = 0.0
        for i, (date, close) in enumerate(zip(part.date, part.close, strict=True), 1):
            s12, w12, s26, w26 = s12 * 11 / 13 + close, w12 * 11 / 13 + 1, s26 * 25 / 27 + close, w26 * 25 / 27 + 1
            if i >= 20:
                want[code, str(date)[:10]] = s12 / w12 - s26 / w26
    frame = registry.QUERIES["g3_w8_macd_line"](spark, SF).toPandas()
    keys = list(zip(frame.code, frame.date.astype(str), strict=True))
    assert sorted(keys) == sorted(want)
    assert max(bars.groupby("code").size()) > 200
    for key, dif in zip(keys, frame.dif, strict=True):
        assert abs(dif - want[key]) < 1e-5
    same_rows(frame, duck.execute(registry.ORACLE["g3_w8_macd_line"]).fetchdf())
