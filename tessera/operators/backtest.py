"""Monthly rebalance backtest on long frames, and performance figures of a return series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import ln
from tessera.operators import joins
from tessera.operators.factors import limit_down, limit_up
from tessera.operators.scans import running
from tessera.sources.panel import calendar, month_ends
from tessera.sources.staging import written


@dataclass(frozen=True)
class Costs:
    commission: float = 0.00025
    min_commission: float = 5.0
    stamp_duty: float = 0.001
    slippage: float = 0.001
    transfer_fee: float = 0.00001


@dataclass(frozen=True)
class Rules:
    top_quantile: float = 0.2
    max_holdings: int = 20
    min_listed_days: int = 120
    min_price: float = 3.0
    max_price: float = 500.0
    ascending: bool = False
    initial_capital: float = 1_000_000.0
    sell_days: int = 10


def periods(cal: DataFrame) -> DataFrame:
    """One row a month of a calendar (date, cal_idx) but the last: signal day, entry and exit days with their places in it.

    Entry is the day after the month's last, exit the day after the next month's last, or the last day there is.
    These windows run over dates and months alone.
    """
    nxt = cal.select(F.col("date").alias("next_date"), (F.col("cal_idx") - 1).alias("cal_idx"))
    ends = month_ends(cal).join(nxt, "cal_idx", "left")
    last = cal.agg(F.max("date").alias("last_date"), F.max("cal_idx").alias("last_idx"))
    w = Window.orderBy("date")
    ends = ends.withColumns({"exit_date": F.lead("next_date").over(w), "after": F.lead("cal_idx").over(w)}).filter("after is not null and next_date is not null").crossJoin(F.broadcast(last))
    return ends.select(
        F.col("date").alias("signal"), F.col("next_date").alias("entry"), (F.col("cal_idx") + 1).alias("entry_idx"),
        F.coalesce("exit_date", "last_date").alias("exit"), F.when(F.col("exit_date").isNull(), F.col("last_idx")).otherwise(F.col("after") + 1).alias("exit_idx"))


def quotes(panel: DataFrame) -> DataFrame:
    """Bars with ``cal_idx``, running ``listed`` days, the close of the calendar day before (null if not traded then), and open and volume of the entry day, the calendar day after."""
    cal = calendar(panel)
    keyed = panel.filter("close is not null").join(F.broadcast(cal), "date")
    w = Window.partitionBy("code").orderBy("date")
    before = F.when(F.lag("cal_idx").over(w) == F.col("cal_idx") - 1, F.lag("close").over(w))
    follows = F.lead("cal_idx").over(w) == F.col("cal_idx") + 1
    # the entry day is the calendar's next, so a code's next row is its entry row or it has none
    return keyed.withColumns({"listed": F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), "prev_close": before,
                              "entry_open": F.when(follows, F.lead("open").over(w)), "entry_volume": F.when(follows, F.lead("volume").over(w))})


def select_names(quoted: DataFrame, factor: DataFrame | None, name: str, variants: dict[str, Rules]) -> DataFrame:
    """Eligible names of ``quotes`` at each signal day and the top of them by ``name`` (ties by code): one window a ``variant`` and period.

    A ``factor`` with a column ``variant`` has scores of its own for each; without one, all variants rank the same scores. Without ``factor`` the quotes have the column ``name``.
    """
    cal = quoted.select("date", "cal_idx").distinct()
    score = [F.col(name).alias("score")] if factor is None else []
    at = quoted.select("code", F.col("date").alias("signal"), F.col("close").alias("signal_close"), "listed", "entry_open", "entry_volume", *score).join(F.broadcast(periods(cal)), "signal")
    own = [] if factor is None or "variant" not in factor.columns else [F.col("variant").alias("_of")]
    if factor is not None:
        factor = factor.join(F.broadcast(periods(cal).select(F.col("signal").alias("date"))), "date", "left_semi")  # only scores of signal days move
        at = at.join(factor.select("code", F.col("date").alias("signal"), F.col(name).alias("score"), *own), ["code", "signal"])
    good = at.filter(
        F.col("score").isNotNull() & F.col("entry_open").isNotNull() & (F.coalesce("entry_volume", F.lit(0.0)) > 0) & ~limit_up(F.col("code"), F.col("signal_close"), F.col("entry_open")))
    rows = [F.struct(F.lit(k).alias("variant"), F.lit(r.min_listed_days).alias("days"), F.lit(r.min_price).alias("low"), F.lit(r.max_price).alias("high"), F.lit(r.top_quantile).alias("share"),
                     F.lit(r.max_holdings).alias("most"), F.lit(1.0 if r.ascending else -1.0).alias("sign"), F.lit(r.initial_capital).alias("capital")) for k, r in variants.items()]
    each = good.select("*", F.inline(F.array(*rows))).filter((F.col("listed") >= F.col("days")) & F.col("signal_close").between(F.col("low"), F.col("high")))
    each = each.filter("variant = _of").drop("_of") if own else each
    w = Window.partitionBy("variant", "signal")
    ranked = each.withColumns({"rank": F.row_number().over(w.orderBy(F.col("score") * F.col("sign"), "code")), "k": F.count("*").over(w)})
    take = F.least(F.greatest(F.lit(1), F.floor(F.col("k") * F.col("share"))), F.col("most"))
    return ranked.filter(F.col("rank") <= take).withColumn("weight", 1.0 / take)


def rebalance(panel: DataFrame, factor: DataFrame | None, name: str, costs: Costs = Costs(), rules: Rules = Rules()) -> DataFrame:
    """``signal``, ``entry``, ``exit``, ``names``, ``tradable``, ``period_ret`` and ``nav`` of each period."""
    return rebalance_variants(panel, factor, name, costs, {"": rules}).drop("variant")


def rebalance_variants(panel: DataFrame, factor: DataFrame | None, name: str, costs: Costs, variants: dict[str, Rules]) -> DataFrame:
    """Backtests of several rules, each with its own capital and, if ``factor`` has a ``variant``, its own scores, in one pass; days to sell are the first's. Without ``factor`` the panel has the column ``name``.

    Quotes are written once: the calendar, the names and the sales read them. A name that finds no open above its lower limit within ``sell_days`` calendar days adds neither return nor cost.
    Fees are on the initial capital's share, so the value is a plain running product.
    """
    quoted = written(quotes(panel).select("code", "date", "cal_idx", "open", "close", "volume", "listed", "prev_close", "entry_open", "entry_volume", *([name] if factor is None else [])), "quotes")
    picks = select_names(quoted, factor, name, variants)
    q = quoted.withColumn("blocked", limit_down(F.col("code"), F.col("prev_close"), F.col("open")))
    sold = joins.first_sellable(picks.select("code", "exit_idx"), q.select("code", "cal_idx", "open", "blocked"), next(iter(variants.values())).sell_days)
    held = picks.join(sold, ["code", "exit_idx"], "left")
    notional = F.col("capital") * F.col("weight")
    fee = F.greatest(notional * costs.commission, F.lit(costs.min_commission))
    fees = 2 * fee + notional * (costs.stamp_duty + costs.slippage * 2 + costs.transfer_fee * 2)
    filled = F.coalesce((F.col("entry_open") > 0) & (F.col("exit_open") > 0), F.lit(False))
    gain = F.when(filled, F.col("weight") * (F.col("exit_open") / F.nullif("entry_open", F.lit(0.0)) - 1) - fees / F.col("capital"))
    out = held.groupBy("variant", "signal", "entry", "exit").agg(F.count("*").alias("names"), F.avg(filled.cast("int")).alias("tradable"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("period_ret"))
    w = Window.partitionBy("variant").orderBy("signal").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    return out.withColumn("nav", F.product(1 + F.col("period_ret")).over(w))


def worst_fall(returns: DataFrame, by: list[str], bucket: str, order: str, r: str) -> DataFrame:
    """``by``, ``max_drawdown``: the least value of the product of 1 + r over its running maximum, less 1; returns are above -1.

    A bucket of rows is (product, top and lowest prefix, worst fall within); these combine associatively, so buckets are scanned side by side
    and only one row a bucket is scanned in order. A value is measured against the higher of the top before its bucket and the top within, whichever is worse.
    """
    inside = Window.partitionBy(*by, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = returns.withColumn("_e", F.product(1 + F.col(r)).over(inside)).withColumn("_top", F.max("_e").over(inside))
    blocks = x.groupBy(*by, bucket).agg(F.product(1 + F.col(r)).alias("_p"), F.max("_e").alias("_high"), F.min("_e").alias("_low"), F.min(F.col("_e") / F.nullif("_top", F.lit(0.0))).alias("_fall"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_at", F.coalesce(F.product("_p").over(before), F.lit(1.0)))
    blocks = blocks.withColumn("_peak", F.max(F.col("_at") * F.col("_high")).over(before))
    across = F.col("_at") * F.col("_low") / F.nullif("_peak", F.lit(0.0))
    return blocks.groupBy(*by).agg((F.min(F.least("_fall", across)) - 1).alias("max_drawdown"))


def performance(returns: DataFrame, by: list[str], order: str, r: str, per_year: float | None = 12.0, growth: bool = False) -> DataFrame:
    """Ten figures of each return series: one aggregate, and the drawdown by buckets of ``order``, so no series is held by one task.

    Without ``per_year``, a series of dates with a median gap of two days at most has 252 periods a year, others 12. With ``growth``, also ``log_growth``, the logarithm
    of the last value: ``total_return`` is that value less 1, which loses the digits of a small one.
    """
    x = returns.filter(F.col(r).isNotNull()).withColumn("_bucket", joins.time_bucket(returns, order))
    if per_year is None:
        x = running(x, by, F.col("_bucket"), [order], {"_prev": ("max_before", order)}).withColumn("_bucket", joins.time_bucket(returns, order))
        year = F.when(F.median(F.datediff(order, "_prev")) <= 2, 252.0).otherwise(12.0)
    else:
        year = F.lit(float(per_year))
    a = x.groupBy(*by).agg(
        F.count("*").alias("periods"), year.alias("_year"), (F.product(1 + F.col(r)) - 1).alias("total_return"), ln(F.product(1 + F.col(r))).alias("log_growth"), F.stddev_samp(r).alias("_s"),
        F.stddev_samp(F.when(F.col(r) < 0, F.col(r))).alias("_d"), F.avg((F.col(r) > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(r) / F.nullif(F.stddev_samp(r) / F.sqrt(F.count(r)), F.lit(0.0)), F.lit(0.0)).alias("t_stat"))
    a = a.join(worst_fall(x, by, "_bucket", order, r), by)
    a = a.withColumns({"annualized_return": F.pow(1 + F.col("total_return"), F.col("_year") / F.col("periods")) - 1, "annualized_vol": F.col("_s") * F.sqrt("_year"), "_down": F.col("_d") * F.sqrt("_year")})
    return a.select(
        *by, "periods", "total_return", "annualized_return", "annualized_vol", F.coalesce(F.col("annualized_return") / F.nullif("annualized_vol", F.lit(0.0)), F.lit(0.0)).alias("sharpe"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs(F.nullif("max_drawdown", F.lit(0.0)))).alias("calmar"), (F.col("annualized_return") / F.nullif("_down", F.lit(0.0))).alias("sortino"), "win_rate", "t_stat", *(["log_growth"] if growth else []))
