"""Queries: the rebalance backtest, its baselines and variants, performance, regimes, stress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_code, pct_change, rnd, roll
from tessera.operators import backtest as bt
from tessera.operators import models

from tessera.plans import sql as q
from tessera.plans.factors import FACTOR_CTES, baseline_factors, factor_table
from tessera.plans.sql import CAL, ENDS, INDEX, with_
from tessera.registry import query
from tessera.sources import panel as p
from tessera.sources.staging import written

RULES = bt.Rules(max_price=1e9)
_PERIODS = """nxt AS (SELECT e.month, e.date AS signal, e.cal_idx, c.date AS entry FROM ends e LEFT JOIN cal c ON c.cal_idx = e.cal_idx + 1),
periods AS (SELECT signal, entry, cal_idx + 1 AS entry_idx, coalesce(x, (SELECT max(date) FROM cal)) AS exit, CASE WHEN x IS NULL THEN (SELECT max(cal_idx) FROM cal) ELSE after + 1 END AS exit_idx
  FROM (SELECT *, lead(entry) OVER (ORDER BY signal) AS x, lead(cal_idx) OVER (ORDER BY signal) AS after FROM nxt) WHERE after IS NOT NULL AND entry IS NOT NULL)"""
_LIM = "(CASE WHEN regexp_matches(code, '^(300|301|688)') THEN 0.2 WHEN regexp_matches(code, '^(8|4|92)') THEN 0.3 ELSE 0.1 END::DOUBLE - 0.005::DOUBLE)"
_QUOTES = f"""quotes AS (
  SELECT *, coalesce((open - prev_close) / nullif(prev_close, 0) <= -{_LIM}, false) AS blocked, coalesce((open - prev_close) / nullif(prev_close, 0) >= {_LIM}, false) AS capped FROM (
    SELECT b.*, cal_idx, row_number() OVER w AS listed, CASE WHEN lag(cal_idx) OVER w = cal_idx - 1 THEN lag(close) OVER w END AS prev_close FROM bars b JOIN cal USING (date) WINDOW w AS (PARTITION BY code ORDER BY date)))"""


def _run(score: str, ascending: bool = False, quantile: float = 0.2, listed: int = 120, holdings: int = 20, source: str = "factors", capital: float = 1e6) -> str:
    return f"""good AS (
  SELECT pr.*, f.code, f.{score} AS score, e.open AS entry_open FROM periods pr JOIN {source} f ON f.date = pr.signal JOIN quotes s ON s.code = f.code AND s.date = pr.signal
  JOIN quotes e ON e.code = f.code AND e.date = pr.entry WHERE f.{score} IS NOT NULL AND s.listed >= {listed} AND e.volume > 0 AND s.close BETWEEN 3 AND 1e9 AND NOT e.capped),
picks AS (SELECT *, 1.0::DOUBLE / take AS weight FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score {'' if ascending else 'DESC'}, code) AS rank,
  least(greatest(1, CAST(floor(count(*) OVER (PARTITION BY signal) * {quantile}::DOUBLE) AS BIGINT)), {holdings}) AS take FROM good) WHERE rank <= take),
held AS (SELECT k.*, (SELECT arg_min(x.open, x.cal_idx) FROM quotes x WHERE x.code = k.code AND x.cal_idx BETWEEN k.exit_idx AND k.exit_idx + 9 AND NOT x.blocked) AS exit_open FROM picks k),
nav0 AS (SELECT signal, entry, exit, count(*) AS names, avg((exit_open IS NOT NULL)::INT) AS tradable,
  coalesce(sum(CASE WHEN entry_open > 0 AND exit_open > 0 THEN weight * (exit_open / entry_open - 1) - (2 * greatest({capital}::DOUBLE * weight * 0.00025::DOUBLE, 5.0) + {capital}::DOUBLE * weight * (0.001::DOUBLE + 0.001::DOUBLE * 2 + 0.00001::DOUBLE * 2)) / {capital}::DOUBLE END), 0) AS period_ret
  FROM held GROUP BY 1, 2, 3)"""


_BASE = (*FACTOR_CTES, CAL, ENDS, _PERIODS, _QUOTES)
_NAV = "SELECT signal, entry, exit, names, round(tradable, 6) AS tradable, round(period_ret, 6) AS period_ret FROM nav0"


def _bars(spark, sf_dir):
    """Bars written once: the factors and the quotes of a backtest read them."""
    return written(p.bars(spark, sf_dir), "bars")


def _scored_bars(spark, sf_dir, name: str):
    """Bars with a close and their factor ``name``, written once: the calendar and the quotes of a backtest read them."""
    return written(factor_table(spark, sf_dir, [name], ["open", "close", "volume"]), "bars")


def _rebalanced(spark, sf_dir, name: str, rules: bt.Rules):
    return bt.rebalance(_scored_bars(spark, sf_dir, name), None, name, bt.Costs(), rules)


@query("m2_rebalance_momentum", with_(*_BASE, _run("mom_1")) + _NAV)
def m2(spark, sf_dir):
    """The whole backtest for one-month momentum."""
    n = _rebalanced(spark, sf_dir, "mom_1", RULES)
    return n.select("signal", "entry", "exit", "names", F.round("tradable", 6).alias("tradable"), F.round("period_ret", 6).alias("period_ret"))


@query("m2_rebalance_low_volatility", with_(*_BASE, _run("vol_20d_atr", ascending=True)) + _NAV)
def m2_low(spark, sf_dir):
    """M2 in ascending order."""
    n = _rebalanced(spark, sf_dir, "vol_20d_atr", bt.Rules(max_price=1e9, ascending=True))
    return n.select("signal", "entry", "exit", "names", F.round("tradable", 6).alias("tradable"), F.round("period_ret", 6).alias("period_ret"))


_PERF = """, eq AS (SELECT signal, period_ret AS r, product(1 + period_ret) OVER (ORDER BY signal) AS e FROM nav0), dd AS (SELECT *, e / max(e) OVER (ORDER BY signal) - 1 AS d FROM eq),
a AS (SELECT count(*) AS periods, product(1 + r) - 1 AS total, stddev_samp(r) * sqrt(12) AS vol, min(d) AS mdd, stddev_samp(r) FILTER (r < 0) * sqrt(12) AS down, avg((r > 0)::INT) AS win, coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0), 0) AS t FROM dd),
b AS (SELECT *, pow(1 + total, 12.0::DOUBLE / periods) - 1 AS ann FROM a)
SELECT periods, round(total, 4) AS total_return, round(ann, 5) AS annualized_return, round(vol, 5) AS annualized_vol, round(ann / vol, 5) AS sharpe, round(mdd, 6) AS max_drawdown, round(ann / abs(mdd), 5) AS calmar, round(ann / nullif(down, 0), 5) AS sortino, round(win, 6) AS win_rate, round(t, 5) AS t_stat FROM b"""


@query("a2_performance", with_(*_BASE, _run("vol_20d_atr", ascending=True)) + _PERF)
def a2(spark, sf_dir):
    """Total and annualized return, volatility, Sharpe, drawdown, Calmar, Sortino, win rate, t."""
    n = _rebalanced(spark, sf_dir, "vol_20d_atr", bt.Rules(max_price=1e9, ascending=True)).withColumn("s", F.lit(1))
    digits = {"total_return": 4, "max_drawdown": 6, "win_rate": 6}
    perf = bt.performance(n, ["s"], "signal", "period_ret", per_year=None)
    return perf.select("periods", *[F.round(c, digits.get(c, 5)).alias(c) for c in perf.columns if c not in ("s", "periods")])


@query("a6_subperiod_returns", with_(*_BASE, _run("mom_1")) + "SELECT year(exit) || 'H' || CASE WHEN month(exit) <= 6 THEN 1 ELSE 2 END AS half, count(*) AS periods, round(product(1 + period_ret) - 1, 5) AS ret FROM nav0 GROUP BY 1")
def a6(spark, sf_dir):
    """Returns by half-year."""
    half = F.concat(F.year("exit").cast("string"), F.lit("H"), F.when(F.month("exit") <= 6, "1").otherwise("2"))
    return _rebalanced(spark, sf_dir, "mom_1", RULES).groupBy(half.alias("half")).agg(F.count("*").alias("periods"), F.round(F.product(1 + F.col("period_ret")) - 1, 5).alias("ret"))


_BASELINES = [("BL1", "constant", 1.0, 10_000), ("BL2", "hist_mean", 0.2, 20), ("BL3", "constant", 1.0, 10_000), ("BL4", "mom_12_1", 0.2, 20)]
_BASELINE = """base AS (SELECT b.code, b.date, mom_12_1, 0.0::DOUBLE AS constant, h.hist_mean FROM factors b LEFT JOIN (SELECT code, date, lag(r) OVER (PARTITION BY code ORDER BY date) AS hist_mean FROM (
  SELECT code, date, close / nullif(lag(close, 60) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r FROM bars)) h ON h.code = b.code AND h.date = b.date AND h.date >= (SELECT min(date) + 60 FROM bars))"""


@query("m28_baselines", " UNION ALL ".join(f"SELECT * FROM ({with_(*_BASE, _BASELINE, _run(c, quantile=qt, holdings=k, source='base'))} SELECT '{n}' AS baseline, count(*) AS periods, round(avg(names), 4) AS names, round(avg(period_ret), 6) AS mean_ret, round(product(1 + period_ret) - 1, 4) AS total_return FROM nav0)" for n, c, qt, k in _BASELINES))
def m28(spark, sf_dir):
    """Random walk and equal weight (all names), historical mean and 12-1 momentum, each as a backtest."""
    b = _bars(spark, sf_dir)
    own = baseline_factors(b).join(factor_table(spark, sf_dir, ["mom_12_1"], bars=b).select("code", "date", "mom_12_1"), ["code", "date"], "full")
    scores = own.select("code", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("score")) for n, c, *_ in _BASELINES])).alias("x")).select("code", "date", "x.*")
    rules = {n: bt.Rules(max_price=1e9, top_quantile=share, max_holdings=holdings) for n, _, share, holdings in _BASELINES}
    runs = bt.rebalance_variants(b, scores, "score", bt.Costs(), rules).withColumnRenamed("variant", "baseline")
    return runs.groupBy("baseline").agg(
        F.count("*").alias("periods"), F.round(F.avg("names"), 4).alias("names"), F.round(F.avg("period_ret"), 6).alias("mean_ret"), F.round(F.product(1 + F.col("period_ret")) - 1, 4).alias("total_return"))


_VARIANTS = [("base", 0.2, 120), ("q_low", 0.16, 120), ("q_high", 0.24, 120), ("listed_low", 0.2, 96), ("listed_high", 0.2, 144)]


@query("m26_sensitivity", " UNION ALL ".join(f"SELECT * FROM ({with_(*_BASE, _run('mom_1', quantile=qt, listed=ld))} SELECT '{n}' AS variant, count(*) AS periods, round(avg(period_ret), 6) AS mean_ret FROM nav0)" for n, qt, ld in _VARIANTS))
def m26(spark, sf_dir):
    """Five variants of the quantile and listed days, ranked and replayed in one pass."""
    variants = {n: bt.Rules(max_price=1e9, top_quantile=qt, min_listed_days=ld) for n, qt, ld in _VARIANTS}
    runs = bt.rebalance_variants(_scored_bars(spark, sf_dir, "mom_1"), None, "mom_1", bt.Costs(), variants)
    return runs.groupBy("variant").agg(F.count("*").alias("periods"), F.round(F.avg("period_ret"), 6).alias("mean_ret"))


#: The two capitals of the capacity audit.
_CAPITALS = [("small", 1e5), ("large", 1e8)]


@query("m25_capacity", " UNION ALL ".join(f"SELECT * FROM ({with_(*_BASE, _run('mom_1', capital=c))} SELECT '{n}' AS variant, count(*) AS periods, {q.rnd('avg(tradable)', 6)} AS tradable, {q.rnd('avg(period_ret)', 7)} AS mean_ret, {q.rnd('product(1 + period_ret) - 1', 5)} AS total_return FROM nav0)" for n, c in _CAPITALS))
def m25_capacity(spark, sf_dir):
    """The backtest with a small and a large capital side by side: least commissions weigh on the small one."""
    variants = {n: bt.Rules(max_price=1e9, initial_capital=c) for n, c in _CAPITALS}
    runs = bt.rebalance_variants(_scored_bars(spark, sf_dir, "mom_1"), None, "mom_1", bt.Costs(), variants)
    return runs.groupBy("variant").agg(F.count("*").alias("periods"), rnd(F.avg("tradable"), 6).alias("tradable"), rnd(F.avg("period_ret"), 7).alias("mean_ret"), rnd(F.product(1 + F.col("period_ret")) - 1, 5).alias("total_return"))


REGIME = f"""idxw AS (SELECT date, close, avg(close) OVER w20 AS ma20, avg(close) OVER w60 AS ma60, count(*) OVER w60 AS n, r FROM (SELECT *, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS r FROM idx)
  WINDOW w20 AS (ORDER BY date ROWS 19 PRECEDING), w60 AS (ORDER BY date ROWS 59 PRECEDING)),
regimes AS (SELECT date, close, CASE WHEN n < 60 THEN 'transition' WHEN close > 1.05 * ma60 AND ma20 > ma60 THEN CASE WHEN coalesce(vol, 0) >= 0.2 THEN 'bull_high_vol' ELSE 'bull' END WHEN close < 0.95 * ma60 AND ma20 < ma60 THEN 'bear'
  WHEN abs(close / ma60 - 1) < 0.05 THEN 'range' ELSE 'transition' END AS regime FROM (SELECT *, stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING) * sqrt(252) AS vol FROM idxw))"""


def regimes(index):
    """Rule labels of an index (code, date, close): windows instead of a rescan for each day."""
    x = index.withColumn("r", pct_change("close"))
    x = x.withColumns({"ma20": F.avg("close").over(by_code().rowsBetween(-19, 0)), "ma60": F.avg("close").over(by_code().rowsBetween(-59, 0)), "n": F.count("*").over(by_code().rowsBetween(-59, 0)), "vol": F.stddev_samp("r").over(by_code().rowsBetween(-19, 0)) * F.sqrt(F.lit(252.0))})
    c, slow, fast = F.col("close"), F.col("ma60"), F.col("ma20")
    label = (F.when(F.col("n") < 60, "transition")
             .when((c > 1.05 * slow) & (fast > slow), F.when(F.coalesce("vol", F.lit(0.0)) >= 0.2, "bull_high_vol").otherwise("bull"))
             .when((c < 0.95 * slow) & (fast < slow), "bear").when(F.abs(c / F.nullif(slow, F.lit(0.0)) - 1) < 0.05, "range").otherwise("transition"))
    return x.withColumn("regime", label)


@query("m13_rule_regimes", with_(INDEX, REGIME) + "SELECT date, regime FROM regimes")
def m13(spark, sf_dir):
    """Labels by moving averages and volatility."""
    return regimes(p.index_series(spark, sf_dir).withColumn("code", F.lit("index"))).select("date", "regime")


@query("m14_regime_metrics", with_(INDEX, REGIME) + f"""SELECT count(*) AS days, {q.rnd('max_by(close, date)', 4)} AS close, {q.rnd('max_by(ma20, date)', 4)} AS ma20, {q.rnd('max_by(ma60, date)', 4)} AS ma60, {q.rnd('max_by(vol, date)')} AS vol_20d, {q.rnd('max_by(close / nullif(ma60, 0) - 1, date)')} AS deviation, max_by(regime, date) AS state
FROM (SELECT r.date, r.close, r.regime, x.ma20, x.ma60, stddev_samp(x.r) OVER (ORDER BY r.date ROWS 19 PRECEDING) * sqrt(252) AS vol FROM regimes r JOIN idxw x USING (date))""")
def m14(spark, sf_dir):
    """The last day's means, volatility, deviation and state."""
    r = regimes(p.index_series(spark, sf_dir).withColumn("code", F.lit("index"))).withColumn("deviation", F.col("close") / F.nullif("ma60", F.lit(0.0)) - 1)
    at = lambda c, n, digits=6: rnd(F.max_by(c, "date"), digits).alias(n)
    return r.agg(F.count("*").alias("days"), at("close", "close", 4), at("ma20", "ma20", 4), at("ma60", "ma60", 4), at("vol", "vol_20d"), at("deviation", "deviation"), F.max_by("regime", "date").alias("state"))


@query("a26_month_regime", with_(INDEX, REGIME) + "SELECT CAST(date_trunc('month', date) AS DATE) AS month, max_by(regime, date) AS regime, max(date) AS last_day FROM regimes GROUP BY 1")
def a26(spark, sf_dir):
    """The last label of each month."""
    r = regimes(p.index_series(spark, sf_dir).withColumn("code", F.lit("index")))
    return r.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by("regime", "date").alias("regime"), F.max("date").alias("last_day"))


@query("j10_returns_by_regime", with_(*_BASE, _run("mom_1"), INDEX, REGIME) + ", labelled AS (SELECT n.*, last_value(r.regime IGNORE NULLS) OVER (ORDER BY n.exit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS regime FROM nav0 n LEFT JOIN regimes r ON r.date = n.exit) SELECT coalesce(regime, 'none') AS regime, count(*) AS periods, round(product(1 + period_ret) - 1, 5) AS ret FROM labelled GROUP BY 1")
def j10(spark, sf_dir):
    """Label of the exit day, else of the exit day before; returns by label."""
    n = _rebalanced(spark, sf_dir, "mom_1", RULES)
    r = regimes(p.index_series(spark, sf_dir).withColumn("code", F.lit("index"))).select(F.col("date").alias("exit"), "regime")
    w = Window.orderBy("exit").rowsBetween(Window.unboundedPreceding, 0)  # one row a month
    x = n.join(r, "exit", "left").withColumn("regime", F.coalesce(F.last("regime", ignorenulls=True).over(w), F.lit("none")))
    return x.groupBy("regime").agg(F.count("*").alias("periods"), F.round(F.product(1 + F.col("period_ret")) - 1, 5).alias("ret"))


@query("m18_both_regimes")
def m18(spark, sf_dir):
    """Each trading day with the rule's label and that of the hidden Markov model, null where it has none."""
    rule = regimes(p.index_series(spark, sf_dir).withColumn("code", F.lit("index"))).select("date", F.col("regime").alias("rule"))
    return rule.join(m15(spark, sf_dir).select("date", "hmm"), "date", "left")


@query("m15_m17_hmm_regimes")
def m15(spark, sf_dir):
    """Every trading day with its state by a two-state hidden Markov model and its label with the 60-day mean; both null where the features or the model lack a state."""
    x = p.index_series(spark, sf_dir).withColumn("code", F.lit("index")).withColumn("ret", pct_change("close"))
    f = x.withColumns({"vol20": roll(F.stddev_samp, "ret", 20), "ma60": roll(F.avg, "close", 60)}).withColumn("gap", F.col("close") / F.nullif("ma60", F.lit(0.0)) - 1)
    states = models.hmm_labels(f, "code", "date", ["ret", "vol20", "gap"])
    both = states.join(f.select("code", "date", "gap"), ["code", "date"])
    label = F.when((F.col("state") == 1) & (F.col("gap") > 0.02), "bull").when((F.col("state") == 0) & (F.col("gap") < -0.02), "bear").when(F.abs("gap") < 0.05, "range").otherwise("transition")
    return both.select("date", F.col("state").cast("long").alias("state"), F.when(F.col("state").isNotNull(), label).alias("hmm"))


def _forecasts(spark, sf_dir):
    """Refits on 500 days each 20, with the realized 20-day volatility of the day before and of the day itself, all a year."""
    r = p.index_series(spark, sf_dir).withColumn("code", F.lit("index")).withColumn("r", pct_change("close")).filter("r is not null")
    year = F.sqrt(F.lit(252.0))
    vol = r.withColumn("realized_next", roll(F.stddev_samp, "r", 20) * year)
    vol = vol.withColumn("realized_20d", F.lag("realized_next").over(by_code())).select("code", "date", "realized_20d", "realized_next")
    windows = models.rolling_windows(r, "code", "date", "r", 500, 20)
    fitted = models.rolling_garch(windows.select("window_id", "returns").repartition("window_id"))
    out = fitted.join(windows.select("window_id", "code", "date"), "window_id").join(vol, ["code", "date"])
    return out.withColumn("forecast", F.col("forecast") * year).drop("code")


@query("m10_m12_garch")
def m10(spark, sf_dir):
    """GARCH and GJR refitted on 500 days each 20, next day's volatility beside the realized one."""
    return _forecasts(spark, sf_dir)


@query("m12_volatility_comparison")
def m12(spark, sf_dir):
    """Each model against the last realized volatility: squared error, QLIKE, directions."""
    return models.compare_forecasts(_forecasts(spark, sf_dir), ["model"], "date")


#: The stress scenarios (periods, total shock, whether half is sold on the first day).
SCENARIOS = [("crash_2015", 21, -0.30, False), ("slow_bear_2018", 252, -0.25, False), ("shock_2020", 10, -0.15, False), ("liquidity_dry_up", 21, -0.30, True)]


@query("m27_stress", with_("h AS (SELECT sum(l_extendedprice) FILTER (l_returnflag <> 'R') AS invested, sum(l_extendedprice) / 10 AS cash FROM lineitem)", "sc(scenario, n, shock, dry) AS (VALUES ('crash_2015', 21, -0.30::DOUBLE, false), ('slow_bear_2018', 252, -0.25::DOUBLE, false), ('shock_2020', 10, -0.15::DOUBLE, false), ('liquidity_dry_up', 21, -0.30::DOUBLE, true))",
       "days AS (SELECT *, unnest(range(1, n + 1)) AS t FROM sc CROSS JOIN h)", "nav AS (SELECT scenario, t, invested + cash AS initial, CASE WHEN dry THEN invested / 2 ELSE invested END * pow(1 + shock, t / n::DOUBLE) + cash + CASE WHEN dry THEN invested / 2 ELSE 0 END AS v FROM days)",
       "dd AS (SELECT *, v / max(v) OVER (PARTITION BY scenario ORDER BY t) - 1 AS d FROM nav)") + "SELECT scenario, round(min(d), 6) AS max_drawdown, round(arg_max(v, t), 2) AS final_nav, round(max(initial), 2) AS initial_nav, min(d) <= -0.4 AS reduce FROM dd GROUP BY scenario")
def m27(spark, sf_dir):
    """Four scenarios in closed form; the value falls by an equal share a day."""
    h = p.table(spark, sf_dir, "lineitem").agg(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))).alias("invested"), (F.sum("l_extendedprice") / 10).alias("cash"))
    days = spark.createDataFrame(SCENARIOS, "scenario string, n int, shock double, dry boolean").crossJoin(F.broadcast(h)).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("n"))))
    kept = F.when(F.col("dry"), F.col("invested") / 2).otherwise(F.col("invested"))
    v = kept * F.pow(1 + F.col("shock"), F.col("t") / F.col("n").cast("double")) + F.col("cash") + F.col("invested") - kept
    w = Window.partitionBy("scenario").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumn("v", v).withColumn("d", F.col("v") / F.max("v").over(w) - 1)
    return x.groupBy("scenario").agg(F.round(F.min("d"), 6).alias("max_drawdown"), F.round(F.max_by("v", "t"), 2).alias("final_nav"), F.round(F.max(F.col("invested") + F.col("cash")), 2).alias("initial_nav"), (F.min("d") <= -0.4).alias("reduce"))


