"""Volatility forecasts, periods a year, carried values and timed lots against plain loops on small tables."""

import datetime as dt

import numpy as np
import pytest

from tessera import registry, suite  # noqa: F401  (suite registers the queries)
from tessera.operators import backtest, joins, ledger, models

SF = "/root/testdata/sf0.001"


def test_windows(spark):
    n, size, step = 57, 20, 5
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(n)] + [("b", i, 1.0) for i in range(size)], "code string, t int, r double")
    got = {(r.code, r.window_id): (list(r.returns), r.t) for r in models.rolling_windows(rows, "code", "t", "r", size, step).collect()}
    assert got == {("a", k): ([float(i) for i in range(at - size, at)], at) for k, at in enumerate(range(size, n, step))}


def test_garch_finds_the_parameters():
    rng = np.random.default_rng(1)
    for asymmetric, gamma in ((False, 0.0), (True, 0.15)):
        h, x = 1e-4, []
        for _ in range(4000):
            x.append(np.sqrt(h) * rng.normal())
            h = 4e-6 + (0.08 + gamma * (x[-1] < 0)) * x[-1] ** 2 + 0.8 * h
        got = models.fit_garch(np.array(x), asymmetric)
        assert abs(got["alpha"] - 0.08) < 0.05 and abs(got["beta"] - 0.8) < 0.1 and abs(got["gamma"] - gamma) < 0.08
        assert abs(got["forecast"] / np.sqrt(h) - 1) < 0.15


def test_likelihoods_in_batches():
    """The batched loss is that of a plain loop; a fit is no worse than any point of a grid, and the same alone as among others."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.01, (4, 300)) * np.where(np.arange(300) % 90 < 45, 1, 2)
    r2, neg = (x * x).T, (x < 0).T.astype(float)
    grid = np.array([[w, a, g, b] for w in (-14.0, -11.0) for a in (-4.0, -2.0, 0.0) for g in (-50.0, -3.0) for b in (0.0, 1.0, 2.0, 4.0)])
    got = models.garch_loss(np.repeat(grid[:, None], 4, 1), r2, neg)

    def plain(theta, s):
        w, (a, g, b) = np.exp(theta[0]), 1 / (1 + np.exp(-theta[1:]))
        if a + g / 2 + b >= 0.9999:
            return 1e12
        h, total = r2[:, s].mean(), 0.0
        for v, n in zip(r2[:, s], neg[:, s], strict=True):
            total += np.log(h) + v / h
            h = w + (a + g * n) * v + b * h
        return total / 2

    assert np.allclose(got, [[plain(t, s) for s in range(4)] for t in grid], rtol=1e-10)
    x = x - x.mean(1, keepdims=True)
    r2, neg = (x * x).T, (x < 0).T.astype(float)
    for asymmetric in (False, True):
        together = models.fit_garch(x, asymmetric)
        for s in range(4):
            alone = models.fit_garch(x[s], asymmetric)
            assert all(abs(alone[k] - together[k][s]) < 1e-9 for k in alone)
            share = [together[k][s] for k in ("alpha", "gamma", "beta")]
            theta = np.array([np.log(together["omega"][s]), *(np.log(max(v, 1e-22) / (1 - v)) for v in share)])
            assert plain(theta, s) <= min(plain(t, s) for t in grid if asymmetric or t[2] == -50.0) + 1e-6


def test_volatility_comparison(spark):
    frame = registry.QUERIES["m10_m12_garch"](spark, SF).toPandas().sort_values("date")
    got = {r.model: r for r in registry.QUERIES["m12_volatility_comparison"](spark, SF).collect()}
    assert set(frame.model) == set(got) == {"GARCH", "GJR"}
    for model, x in frame.groupby("model"):
        actual, r = x.realized_next, got[model]
        assert r.periods == len(x)
        for name, guess in (("garch", x.forecast), ("hist", x.realized_20d)):
            ratio = actual / guess
            assert abs(r["mse_" + name] - ((guess - actual) ** 2).mean()) < 1e-9
            assert abs(r["qlike_" + name] - (ratio - np.log(ratio) - 1).mean()) < 1e-9
            assert abs(r["direction_" + name] - ((guess.diff() > 0) == (actual.diff() > 0)).mean()) < 1e-9


@pytest.mark.parametrize(("gap", "year"), [(1, 252), (30, 12)])
def test_periods_a_year(spark, gap, year):
    start, rng = dt.date(2020, 1, 1), np.random.default_rng(2)
    r = [float(x) for x in rng.normal(0.001, 0.01, 40)]
    rows = spark.createDataFrame([("s", start + dt.timedelta(days=gap * i), x) for i, x in enumerate(r)], "s string, d date, r double")
    got = backtest.performance(rows, ["s"], "d", "r", per_year=None).first()
    assert abs(got.annualized_vol - np.std(r, ddof=1) * np.sqrt(year)) < 1e-9
    assert abs(got.annualized_return - (np.prod(1 + np.array(r)) ** (year / len(r)) - 1)) < 1e-9


def test_carried(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 9, 9.0), ("b", 2, 5.0)], "code string, i long, v double")
    got = {(r.code, r.i): r.v for r in joins.carried(rows, "v", 2, ["code"], "i").collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("a", 3): 3.0, ("a", 4): 3.0, ("a", 5): 3.0, ("a", 9): 9.0, ("a", 10): 9.0, ("a", 11): 9.0, ("b", 2): 5.0, ("b", 3): 5.0, ("b", 4): 5.0}


def test_account_ledger(spark):
    """A buy beyond the cash, a sell of the same day and one beyond the position are rejected; fees are taken."""
    day = lambda d: dt.datetime(2024, 1, d, 10)
    trades = [(1, day(1), "x", "buy", 10.0, 50.0), (2, day(1), "x", "sell", 11.0, 10.0), (3, day(2), "y", "buy", 100.0, 10.0), (4, day(2), "x", "sell", 12.0, 20.0), (5, day(3), "x", "buy", 20.0, 30.0), (6, day(4), "x", "sell", 9.0, 61.0), (7, day(4), "x", "sell", 9.0, 60.0)]
    rows = spark.createDataFrame([("a", *t) for t in trades], "account string, id int, ts timestamp, code string, direction string, price double, volume double")
    done = ledger.account_ledger(rows, ["id"], 1200.0)
    r = done.first()
    mean = (30 * 10 + 30 * 20) / 60
    assert abs(r.cash - (1200 - 500 * 1.0003 + 240 * 0.9987 - 600 * 1.0003 + 540 * 0.9987)) < 1e-9
    assert abs(r.pnl - (40 + (9 - mean) * 60)) < 1e-9
    assert (r.filled, r.no_cash, r.no_shares) == (4, 1, 2)
    open_ = ledger.marked_positions(ledger.account_ledger(rows.filter("id < 6"), ["id"], 1200.0), spark.createDataFrame([("x", 18.0)], "code string, price double")).first()
    assert (open_.held, open_.cost, open_.price) == (60.0, mean, 18.0) and abs(open_.pnl_ratio - 20) < 1e-9 and open_.unrealized == 180.0


def test_ledger_goes_on_from_a_snapshot(spark):
    """Cuts after each day, an account that rests and one that begins late: as one replay over all trades."""
    rng = np.random.default_rng(11)
    rows = [(f"a{int(rng.integers(0, 4))}", i, dt.datetime(2024, 1, 1 + i // 30, 9, i % 30), f"c{int(rng.integers(0, 5))}", "buy" if rng.random() < 0.6 else "sell", float(rng.integers(5, 15)), float(rng.integers(1, 30))) for i in range(240)]
    rows += [("late", 500, dt.datetime(2024, 1, 8, 10), "c1", "buy", 10.0, 5.0), ("rests", 501, dt.datetime(2024, 1, 1, 10), "c1", "buy", 10.0, 5.0)]
    frame = spark.createDataFrame(rows, "account string, id int, ts timestamp, code string, direction string, price double, volume double")
    whole = {r.account: r for r in ledger.account_ledger(frame, ["id"], 2000.0).collect()}
    at = None
    for last in (3, 4, 6, 9):
        first = {3: 1, 4: 3, 6: 4, 9: 6}[last]
        some = frame.filter(f"day(ts) >= {first} AND day(ts) < {last}")
        at = spark.createDataFrame(ledger.account_ledger(some, ["id"], 2000.0, at).collect(), ledger.account_ledger(some, ["id"], 2000.0, at).schema)
    got = {r.account: r for r in at.collect()}
    assert got.keys() == whole.keys() and {"late", "rests"} <= got.keys()
    held = lambda r: {k: (v.held, round(v.cost, 9)) for k, v in r.positions.items() if v.held > 0}
    for a, r in whole.items():
        assert abs(got[a].cash - r.cash) < 1e-9 and abs(got[a].pnl - r.pnl) < 1e-9 and held(got[a]) == held(r)
        assert (got[a].filled, got[a].no_cash, got[a].no_shares) == (r.filled, r.no_cash, r.no_shares)
    assert sum(r.no_cash + r.no_shares for r in whole.values()) > 10


def test_closed_shares(spark):
    """A sell of 150 with a profit of 30 on lots of 100 and 200: 20 and 10; a rest beyond all buys takes its share too."""
    for volumes, want in (([100.0, 200.0, -150.0], {1: 20.0, 2: 10.0}), ([100.0, -150.0], {1: 20.0, None: 10.0})):
        rows = spark.createDataFrame([("a", i + 1, "buy" if v > 0 else "sell", abs(v), 30.0 if v < 0 else None, "stop") for i, v in enumerate(volumes)], "code string, id long, direction string, volume double, pnl double, reason string")
        got = ledger.closed_shares(joins.fifo_lots(rows, "code", ["id"]), rows.filter("direction = 'sell'")).collect()
        assert {r.buy_id: round(r.pnl, 9) for r in got} == want and {r.reason for r in got} == {"stop"}


def test_timed_fifo(spark):
    trades = [(1, "buy", 10.0, 5.0), (2, "sell", 12.0, 8.0), (3, "buy", 11.0, 4.0), (4, "buy", 9.0, 4.0), (5, "sell", 10.0, 6.0), (6, "sell", 13.0, 1.0)]
    rows = spark.createDataFrame([("x", *t) for t in trades], "code string, id long, direction string, price double, volume double")
    got = {r.id: (r.matched, r.pnl) for r in ledger.timed_fifo(rows, ["id"]).collect()}
    assert got == {2: (5.0, 10.0), 5: (6.0, -4.0 + 2.0), 6: (1.0, 4.0)}
