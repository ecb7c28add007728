"""The factor registry: column builders over one shared window, so that any set of factors is one shuffle by code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import div, lag, pct_change, roll

#: Code prefixes and the daily price limits of their boards.
BOARD_20, BOARD_30 = ("300", "301", "688"), ("8", "4", "92")
LIMIT_20, LIMIT_30, LIMIT = 0.20, 0.30, 0.10


@dataclass(frozen=True)
class FactorSpec:
    name: str
    build: Callable[[], Column]
    needs: tuple[str, ...]
    lookback: int = 0


def price_limit(code: Column | str = "code") -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.when(code.rlike("^(300|301|688)"), LIMIT_20).when(code.rlike("^(8|4|92)"), LIMIT_30).otherwise(LIMIT)


def limit_up(code: Column, prev: Column, price: Column) -> Column:
    """At the limit within half a percent; false where a price is missing."""
    return F.coalesce((price - prev) / F.nullif(prev, F.lit(0.0)) >= price_limit(code) - 0.005, F.lit(False))


def limit_down(code: Column, prev: Column, price: Column) -> Column:
    return F.coalesce((price - prev) / F.nullif(prev, F.lit(0.0)) <= -(price_limit(code) - 0.005), F.lit(False))


def _range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _staged(name: str, needs: tuple[str, ...], level: int, x: Callable[[], Column]) -> Callable[[], Column]:
    """A window over a window: the inner one has a column of its own, see compute_factors. A level reads the levels before it."""
    STEPS.setdefault(level, {})[name] = (needs, x)
    return lambda: F.col(name)


STEPS: dict[int, dict[str, tuple[tuple[str, ...], Callable[[], Column]]]] = {}
#: Rows of a block. A sliding window costs each row as many steps as it has rows, so long windows are put together from blocks that end 0, 10, 20, ... rows back.
BLOCK = 10
_ret = _staged("_ret", ("close",), 1, lambda: pct_change("close"))
_tr = _staged("_tr", ("close", "high", "low"), 1, _range)
_illiq = _staged("_illiq", ("close", "amount"), 1, lambda: F.abs(pct_change("close")) / F.nullif("amount", F.lit(0.0)) * 1e8)
_up = _staged("_up", ("pct_chg",), 1, lambda: F.coalesce(F.col("pct_chg") >= price_limit() * 100 - 0.5, F.lit(False)).cast("double"))


def _ends(block: str, n: int) -> list[Column]:
    """``block`` at the ends of the blocks that make the last ``n`` rows."""
    return [F.col(block), *[lag(block, k) for k in range(BLOCK, n, BLOCK)]]


def _mean(x: str, needs: tuple[str, ...], n: int) -> Callable[[], Column]:
    """The mean of the last ``n`` rows, null with fewer values: the sum of the first block and then each row after it, the same double as one window from its first row on.

    Means of blocks would end on other digits, and scores that are equal but for their last digits are ordered by these.
    """
    _staged(f"_sum_{x}", needs, 2, lambda: roll(F.sum, x, BLOCK))
    after = range(n - BLOCK - 1, 0, -1)
    return lambda: sum([*[lag(x, k) for k in after], F.col(x)], lag(f"_sum_{x}", n - BLOCK)) / n


def _deviation(x: str, needs: tuple[str, ...], n: int) -> Callable[[], Column]:
    """The sample deviation of the last ``n`` rows: the deviations within full blocks and those of the blocks' means add up."""
    _staged(f"_avg_{x}", needs, 2, lambda: roll(F.avg, x, BLOCK))
    _staged(f"_var_{x}", needs, 2, lambda: roll(F.var_pop, x, BLOCK))

    def build() -> Column:
        means, within = _ends(f"_avg_{x}", n), _ends(f"_var_{x}", n)
        mean = sum(means[1:], means[0]) / len(means)
        apart = [(m - mean) * (m - mean) for m in means]
        return F.sqrt(BLOCK * (sum(within[1:], within[0]) + sum(apart[1:], apart[0])) / (n - 1))

    return build


def _highest(x: str, needs: tuple[str, ...], level: int, n: int, least: int) -> Callable[[], Column]:
    """The largest of the last ``n`` rows, null with fewer than ``least`` values."""
    _staged(f"_max_{x}", needs, level, lambda: roll(F.max, x, BLOCK, 1))
    _staged(f"_count_{x}", needs, level, lambda: roll(F.count, x, BLOCK, 0))

    def build() -> Column:
        counts = [F.coalesce(c, F.lit(0)) for c in _ends(f"_count_{x}", n)]
        return F.when(sum(counts[1:], counts[0]) >= least, F.greatest(*_ends(f"_max_{x}", n)))

    return build


_top = _highest("close", ("close",), 2, 60, 20)
_staged("_dd", ("close",), 3, lambda: -(F.col("close") / F.nullif(_top(), F.lit(0.0)) - 1))
_fall = _highest("_dd", ("close",), 4, 60, 20)
_atr = _mean("_tr", ("close", "high", "low"), 20)
_turnover, _amount, _amihud = _mean("turnover", ("turnover",), 20), _mean("amount", ("amount",), 20), _mean("_illiq", ("close", "amount"), 20)
_volatility = _deviation("_ret", ("close",), 60)

REGISTRY: dict[str, FactorSpec] = {
    f.name: f
    for f in [
        FactorSpec("mom_12_1", lambda: div(lag("close", 21), lag("close", 273)) - 1, ("close",), 273),
        FactorSpec("mom_6_1", lambda: div(lag("close", 21), lag("close", 147)) - 1, ("close",), 147),
        FactorSpec("mom_1", lambda: pct_change("close", 21), ("close",), 21),
        FactorSpec("vol_60d_realized", lambda: _volatility() * F.sqrt(F.lit(252.0)), ("close",), 60),
        FactorSpec("vol_20d_atr", lambda: _atr() / F.nullif("close", F.lit(0.0)), ("close", "high", "low"), 20),
        FactorSpec("liq_20d_turnover", _turnover, ("turnover",), 20),
        FactorSpec("liq_20d_amt", _amount, ("amount",), 20),
        FactorSpec("liq_amihud_20d", _amihud, ("close", "amount"), 21),
        FactorSpec("astock_limit_up_5d", lambda: roll(F.sum, _up(), 5), ("pct_chg",), 5),
        FactorSpec("astock_maxdd_60d", _fall, ("close",), 119),
        FactorSpec("value_ep", lambda: F.when(F.col("pe_ttm") > 0, 1 / F.nullif("pe_ttm", F.lit(0.0))), ("pe_ttm",)),
        FactorSpec("value_bp", lambda: 1 / F.nullif("pb", F.lit(0.0)), ("pb",)),
        FactorSpec("value_dp", lambda: F.col("dv_ratio"), ("dv_ratio",)),
        FactorSpec("size_logcap", lambda: F.ln(F.when(F.col("total_mv") > 0, F.col("total_mv"))), ("total_mv",)),
        FactorSpec("quality_roe", lambda: F.col("roe"), ("roe",)),
        FactorSpec("quality_gross_margin", lambda: F.col("gross_margin"), ("gross_margin",)),
    ]
}
PRICE_FACTORS = list(REGISTRY)[:10]
SNAPSHOT_FACTORS = list(REGISTRY)[10:]


def compute_factors(panel: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """``code``, ``date`` and the named factors in one pass; rows with a null close are dropped first.

    A factor whose columns the panel lacks is null, so callers need no branches.
    """
    rows = panel.filter("close is not null") if "close" in panel.columns else panel
    missing = {c for n in names for c in REGISTRY[n].needs} - set(rows.columns)
    for c in sorted(missing):
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    staged = rows
    for level in sorted(STEPS) if {"code", "date"} <= set(rows.columns) else ():
        staged = staged.withColumns({n: build() for n, (needs, build) in STEPS[level].items() if set(needs) <= set(rows.columns)})
    return staged.select("code", *(["date"] if "date" in rows.columns else []), *keep, *[REGISTRY[n].build().alias(n) for n in names])


def padded(panel: DataFrame, names: list[str], first: str) -> DataFrame:
    """Bars from far enough before ``first`` for the factors' lookbacks (in rows, taken as 2 days each with a month to spare).

    A filter on the date does not pass a window by code, so it is put below the windows here.
    """
    days = 2 * max(REGISTRY[n].lookback for n in names) + 31
    return panel.filter(F.col("date") >= F.date_sub(F.to_date(F.lit(first)), days))


__all__ = ["FactorSpec", "PRICE_FACTORS", "REGISTRY", "SNAPSHOT_FACTORS", "compute_factors", "limit_down", "limit_up", "padded", "price_limit"]
