"""Two-level scans, exponential means and lots against plain loops; hot keys are spread over buckets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import backtest, events, joins, ledger
from tessera.operators.scans import drawdowns, running, with_ewm


@pytest.fixture(scope="module")
def series(spark):
    """One key with most of the rows, some nulls; a key of nulls; a key of one row."""
    rng = np.random.default_rng(4)
    rows = [("hot", i, float(round(v, 3)) if i % 7 else None) for i, v in enumerate(rng.normal(size=2000))]
    rows += [("none", i, None) for i in range(5)] + [("one", 700, 1.5)]
    return spark.createDataFrame(rows, "code string, i long, v double")


def test_running(series):
    outs = {"s": ("sum", "v"), "n": ("count", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "last": ("last", "v"), "before": ("max_before", "v")}
    got = running(series, ["code"], F.floor(F.col("i") / 100), ["i"], outs).collect()
    assert len(got) == 2006
    for code in ("hot", "none", "one"):
        s, seen = 0.0, []
        for r in sorted((r for r in got if r.code == code), key=lambda r: r.i):
            assert r.before == max(seen, default=None)
            if r.v is not None:
                s, seen = s + r.v, [*seen, r.v]
            assert r.n == len(seen) and r.last == (seen[-1] if seen else None)
            assert (r.hi, r.lo) == (max(seen, default=None), min(seen, default=None))
            assert r.s is None if not seen else abs(r.s - s) < 1e-9


def test_a_hot_key_is_spread(series):
    """No window holds a whole key: each is over a key and a bucket, or over one row a bucket."""
    plan = running(series, ["code"], F.floor(F.col("i") / 100), ["i"], {"s": ("sum", "v")})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window [" in line or "- Window [" in line]
    assert windows
    for line in windows:
        keys = line.split("], [")[1] if "], [" in line else line
        assert "_bucket" in keys or "_t_s" in line, line


def test_drawdowns(series):
    got = {r.i: r for r in drawdowns(series.filter("code = 'hot' and v is not null").withColumn("v", F.exp("v")), ["code"], F.floor(F.col("i") / 64), ["i"], "v").collect()}
    peak = 0.0
    for i in sorted(got):
        peak = max(peak, got[i].v)
        assert got[i].peak == peak and abs(got[i].drawdown - (got[i].v / peak - 1)) < 1e-12


def test_asof_of_a_hot_key(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2020, 1, 1)
    day = lambda: start + dt.timedelta(int(rng.integers(0, 1500)))
    left = [("hot" if i % 3 else f"k{i % 5}", day(), i) for i in range(900)] + [("hot", None, 900), (None, start, 901), ("new", start, 902)]
    right = [("hot" if i % 3 else f"k{i % 5}", day(), float(i)) for i in range(300)] + [(None, start, 1.0)]
    got = {r.n: r.v for r in joins.asof_backward(spark.createDataFrame(left, "code string, date date, n int"), spark.createDataFrame(right, "code string, date date, v double"), ["code"], "date", ["v"]).collect()}
    assert len(got) == len(left)
    for code, date, n in left:
        known = [(d, v) for c, d, v in right if c == code and date is not None and c is not None and d <= date]
        assert got[n] == (max(known)[1] if known else None)


def test_ewm_of_a_million_rows(spark):
    """A long series in bounded steps a row: the last value is that of the plain recurrence."""
    n, d = 1_000_000, 1 - 2 / 27
    rows = spark.range(n).select(F.lit("a").alias("code"), F.col("id").alias("date"), F.sin(F.col("id").cast("double")).alias("x"))
    tail = np.sin(np.arange(n - 2000, n, dtype=float))
    want = (tail * d ** np.arange(1999, -1, -1)).sum() * (1 - d)
    got = with_ewm(rows, {"y": ("x", d)}).filter(F.col("date") == n - 1).first().y
    assert abs(got - want) < 1e-12


def loop(trades):
    """Lots of each sell in order, earlier buys alone: (sell, buy, volume), and the rest with no buy."""
    queue, out = {}, []
    for code, i, side, v in trades:
        lots = queue.setdefault(code, [])
        if side == "buy":
            lots.append([i, v])
            continue
        while v > 0 and lots:
            used = min(v, lots[0][1])
            out.append((code, i, lots[0][0], used))
            v -= used
            lots[0][1] -= used
            if lots[0][1] <= 0:
                lots.pop(0)
        if v > 0:
            out.append((code, i, None, v))
    return sorted(out, key=str)


def test_strict_lots_of_a_hot_code(spark):
    rng = np.random.default_rng(6)
    trades = [("hot" if i % 3 else f"k{i % 4}", i, "buy" if rng.random() < 0.5 else "sell", float(rng.integers(1, 400))) for i in range(1500)]
    rows = spark.createDataFrame([(*t, float(t[1] % 11)) for t in trades], "code string, id long, direction string, volume double, price double")
    lots = joins.fifo_lots(rows, "code", ["id"], bucket=F.floor(F.col("id") / 50), strict=True)
    assert sorted(((r.code, r.sell_id, r.buy_id, r.alloc) for r in lots.collect()), key=str) == loop(trades)
    gains = {}
    for _, s, b, v in loop(trades):
        m, g = gains.get(s, (0.0, 0.0))
        gains[s] = (m + v, g + v * (s % 11 - b % 11)) if b is not None else (m, g)
    got = {r.id: (r.matched, r.pnl) for r in ledger.timed_fifo(rows, ["id"], F.floor(F.col("id") / 50)).collect()}
    assert got == gains and any(m == 0 for m, _ in gains.values())


def test_performance_of_a_long_series(spark):
    """Figures over some hundred buckets equal those over the whole series at once."""
    rng = np.random.default_rng(9)
    r = [float(v) for v in rng.normal(0.0003, 0.02, 3000)]
    rows = [("long", dt.date(2000, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(r)] + [("one", dt.date(2000, 1, 1), 0.5), ("one", dt.date(2000, 2, 1), None), ("falls", dt.date(2000, 1, 30), -0.5), ("falls", dt.date(2000, 2, 1), -0.5)]
    got = {x.s: x for x in backtest.performance(spark.createDataFrame(rows, "s string, d date, r double"), ["s"], "d", "r", None).collect()}
    equity = np.cumprod(1 + np.array(r))
    assert abs(got["long"].max_drawdown - (equity / np.maximum.accumulate(equity) - 1).min()) < 1e-12
    assert abs(got["long"].annualized_vol - np.std(r, ddof=1) * np.sqrt(252)) < 1e-12 and got["long"].periods == 3000
    assert (got["one"].max_drawdown, got["one"].total_return, got["falls"].max_drawdown) == (0.0, 0.5, -0.5)


def test_day_study_at_full_limits(spark):
    """30 estimation days, 50 codes, all 26 window days, codes with gaps: against least squares window by window."""
    rng = np.random.default_rng(10)
    days, market = 260, rng.normal(0, 0.01, 260)
    data = {c: {d: float(0.001 + (0.5 + c / 60) * market[d] + rng.normal(0, 0.005)) for d in range(c % 7, days) if c % 3 or rng.random() < 0.9} for c in range(75)}
    returns = spark.createDataFrame([(f"c{c}", d + 1, v) for c, x in data.items() for d, v in x.items()], "code string, cal_idx long, r double")
    index = spark.createDataFrame([(d + 1, float(v)) for d, v in enumerate(market)], "cal_idx long, r double")
    t0s = [40, 100, 125, 126, 200, 239, 240, 259]
    at = spark.createDataFrame([(t + 1,) for t in [*t0s, 100]], "t0_idx long")
    got = {(r.t0_idx - 1, r.rel_day): (r.aar, r.codes) for r in events.day_study(at, returns, index).collect()}
    want = {}
    for t in t0s:
        ars = {}
        for x in data.values():
            est = [d for d in range(t - 120, t - 35) if d in x]
            if len(est) < 30 or any(t + k not in x for k in range(-5, 21)):
                continue
            beta, alpha = np.polyfit(market[est], [x[d] for d in est], 1)
            for k in range(-5, 21):
                ars.setdefault(k, []).append(x[t + k] - alpha - beta * market[t + k])
        want |= {(t, k): (np.mean(v), len(v)) for k, v in ars.items() if len(v) >= 50}
    assert got.keys() == want.keys() and len({t for t, _ in want}) >= 4
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-10 for k in want)


def test_strict_lots_deal_rows_once(spark, monkeypatch):
    """Rows are dealt by series and bucket once for all running values; the maximum of earlier buckets meets sells alone. A series without a key is scanned within each bucket and has no lots, only rests."""
    rng = np.random.default_rng(11)
    made = [(code, i, "buy" if rng.random() < 0.5 else "sell", float(rng.integers(1, 20)) / 2, float(rng.integers(1, 9))) for code in ("a", "b", None) for i in range(90)]
    made += [("c", 1, "sell", 5.0, 1.0), ("c", 2, "sell", None, 1.0), ("d", 1, "buy", 2.0, 1.0)]
    rows = spark.createDataFrame(made, "code string, id long, direction string, volume double, price double")
    plans, keep = [], joins.written
    monkeypatch.setattr(joins, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    lots = joins.fifo_lots(rows, "code", ["id"], width=8.0, bucket=F.floor(F.col("id") / 10), strict=True, keep=("price",))
    got = {(r.code, r.sell_id, r.buy_id): (round(r.alloc, 6), r.sell_price) for r in lots.collect()}
    want = {}
    for code in ("a", "b", "c", None):
        held, span = [], None
        for _, i, direction, volume, price in sorted((r for r in made if r[0] == code and r[3] is not None), key=lambda r: r[1]):
            held, span = [] if code is None and i // 10 != span else held, i // 10
            if direction == "buy":
                held.append([i, volume])
                continue
            left = volume
            while left and held:
                alloc = min(left, held[0][1])
                if code is not None:
                    want[code, i, held[0][0]] = (alloc, price)
                left, held[0][1] = left - alloc, held[0][1] - alloc
                held = held if held[0][1] else held[1:]
            if left:
                want[code, i, None] = (left, price)
    assert got == want
    # the rows; the totals of buckets; these by series; what is carried. Rows are sorted once, totals once
    assert plans[0].count("Exchange hashpartitioning") == 4 and plans[0].count("Sort [") == 2
