"""Queries: the contract from live state, its parameters and checks, horizons by regime, experiments, the refreshed store."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import ic_stats, rank_ic, rnd
from tessera.operators import backtest as bt
from tessera.operators import contract as ct
from tessera.operators import factors as fa
from tessera.operators import models
from tessera.operators.joins import asof_backward
from tessera.operators.refresh import refresh, stored
from tessera.plans import sql as q
from tessera.plans.backtest import _BASE, REGIME, RULES, _bars, _run, regimes
from tessera.plans.events import _AR, _DECIDED, _EVENTS, a20, event_kind
from tessera.plans.factors import _DIGITS, _PRICE, _SNAP, FACTOR_CTES, SNAP_SPEC, factor_table, snapshot
from tessera.plans.sql import BARS, CAL, INDEX, with_
from tessera.plans.xsection import _CROWD, _RANKS, _STATS, _Z, FACTORS3, LONG, MONTHLY_CTES, _z, factor_returns, long_monthly
from tessera.registry import query
from tessera.sources import panel as p
from tessera.sources.staging import shared_dir, written

_METRICS = ["close", "ma20", "ma60", "vol", "deviation"]
_PERIODS = (12, 24)


def _regimes(spark, sf_dir):
    r = regimes(p.index_series(spark, sf_dir).withColumn("code", F.lit("index")))
    return r.withColumn("deviation", F.col("close") / F.nullif("ma60", F.lit(0.0)) - 1)


def _contract(spark, sf_dir):
    rows = written(long_monthly(spark, sf_dir), "monthly")  # correlations and crowding read them
    ics = ic_stats(rank_ic(rows, "value", "fwd", ["factor", "month"], tasks=p.tasks(spark, sf_dir)), ["factor"])
    crowding = models.crowding(factor_returns(_z(spark, sf_dir, rows)), "factor", "month", "r", *_PERIODS).select("factor", "crowded", "sharpe")
    return ct.build_contract(_regimes(spark, sf_dir), ics.select("factor", "mean_ic", "t"), crowding, _METRICS)


_CONTRACT = (_RANKS.format(by="factor, month", src="long", least=5) + f""", ic_all AS (SELECT factor, {_STATS} FROM ics WHERE ic IS NOT NULL GROUP BY factor)""" + _Z + _CROWD + f""",
cb AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY month DESC) AS back FROM fr WHERE r IS NOT NULL),
cs AS (SELECT factor, avg(r) FILTER (back <= {_PERIODS[0]}) AS m1, stddev_samp(r) FILTER (back <= {_PERIODS[0]}) AS s1, avg(r) FILTER (back > {_PERIODS[0]} AND back <= {sum(_PERIODS)}) AS m0, stddev_samp(r) FILTER (back > {_PERIODS[0]} AND back <= {sum(_PERIODS)}) AS s0 FROM cb GROUP BY factor),
cf AS (SELECT factor, round(coalesce(m1 / nullif(s1, 0) * sqrt(252), 0), 3) AS sharpe, (coalesce(m0 / nullif(s0, 0), 0) > 0 AND coalesce(m1 / nullif(s1, 0), 0) < coalesce(m0 / nullif(s0, 0), 0) * 0.5)::BIGINT + coalesce(s1 > s0 * 1.3, false)::BIGINT + (m1 < 0)::BIGINT >= 2 AS crowded FROM cs),
today AS (SELECT r.date, r.regime, x.close, x.ma20, x.ma60, x.vol, x.close / nullif(x.ma60, 0) - 1 AS deviation FROM regimes r JOIN (SELECT *, stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING) * sqrt(252) AS vol FROM idxw) x USING (date) ORDER BY r.date DESC LIMIT 1),
cap AS (SELECT CASE WHEN regime LIKE 'bull%' THEN 1.0 WHEN regime LIKE 'bear%' THEN 0.5 WHEN regime LIKE 'range%' THEN 0.7 ELSE 0.4 END::DOUBLE AS c, regime LIKE 'bull%' AS bull FROM today),
state AS (SELECT factor, CASE WHEN coalesce(crowded, false) THEN 'crowded' WHEN abs(t) >= 2 THEN 'active' ELSE 'watch' END AS status, mean_ic, coalesce(crowded, false) AS crowded, sharpe FROM ic_all LEFT JOIN cf USING (factor)),
contract AS (SELECT 'regime' AS section, 'state' AS key, regime AS text, NULL::DOUBLE AS value FROM today UNION ALL SELECT 'regime', 'date', CAST(date AS VARCHAR), NULL FROM today
  """ + "".join(f" UNION ALL SELECT 'metrics', '{m}', NULL, {m} FROM today" for m in _METRICS) + "".join(f" UNION ALL SELECT 'limits', '{k}', NULL, {v} FROM cap" for k, v in [("max_position_pct", "c"), ("max_total_position", "c"), ("single_stock_pct", "0.05::DOUBLE"), ("max_position_size", "0.05::DOUBLE"), ("min_cash_pct", "0.3::DOUBLE")])
  + "".join(f" UNION ALL SELECT 'weights', '{k}', NULL, CASE WHEN bull THEN {b} ELSE {w} END::DOUBLE FROM cap" for k, b, w in [("short", 0.6, 0.5), ("medium", 0.3, 0.3), ("long", 0.1, 0.2)])
  + """ UNION ALL SELECT 'history', month, regime, NULL FROM (SELECT strftime(date, '%Y-%m') AS month, max_by(regime, date) AS regime FROM regimes GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
  UNION ALL SELECT 'factors', factor, status, CASE WHEN status = 'active' THEN 0.05 ELSE 0.0 END::DOUBLE FROM state UNION ALL SELECT 'evidence', factor, NULL, mean_ic FROM state UNION ALL SELECT 'crowding', factor, crowded::VARCHAR, sharpe FROM state)""")
_LIVE = with_(*MONTHLY_CTES, LONG, INDEX, REGIME) + _CONTRACT


@query("m30_contract", _LIVE + f" SELECT section, key, text, {q.rnd('value', 4)} AS value FROM contract")
def m30(spark, sf_dir):
    """The contract of the last day: regime with figures and history, factor states, crowding, limits, weights."""
    return _contract(spark, sf_dir).select("section", "key", "text", rnd("value", 4).alias("value"))


@query("m30_contract_json", _LIVE + " SELECT section, count(*) AS entries, string_agg(key, ',' ORDER BY key) AS keys, string_agg(text, ',' ORDER BY key) AS texts FROM contract GROUP BY section")
def m30_json(spark, sf_dir):
    """The contract through its JSON and back: keys and texts of each section."""
    rows = ct.read_json(ct.as_json(_contract(spark, sf_dir)))
    texts = F.when(F.col("section").isin("regime", "history", "factors", "crowding"), F.col("entry"))
    sorted_ = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", F.col(c).alias("v")))), lambda x: x["v"]), ",")
    out = rows.withColumn("t", texts).groupBy("section").agg(F.count("*").alias("entries"), sorted_("key").alias("keys"), F.nullif(sorted_("t"), F.lit("")).alias("texts"))
    return out


#: The parameters that hold where a contract says nothing.
DEFAULTS = {"max_total_position": 0.8, "single_stock_pct": 0.2, "max_hold_days": 30.0, "min_confidence": 65.0}


@query("g17_effective_parameters", _LIVE + ", stored(key, value) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in DEFAULTS.items()) + "), lim AS (SELECT key, value AS over FROM contract WHERE section = 'limits') SELECT key, coalesce(over, value) AS value, over IS NOT NULL AS by_contract FROM stored LEFT JOIN lim USING (key)")
def g17(spark, sf_dir):
    """Stored parameters with the live contract's limits laid over them."""
    stored_ = spark.createDataFrame(list(DEFAULTS.items()), "key string, value double")
    return ct.effective_parameters(stored_, _contract(spark, sf_dir))


@query("m34_landing_checks", with_(*MONTHLY_CTES, LONG, INDEX, REGIME, _SNAP) + _CONTRACT + """, v AS (SELECT max(value) FILTER (section = 'limits' AND key = 'max_total_position') AS total, max(value) FILTER (section = 'limits' AND key = 'single_stock_pct') AS single, max(value) FILTER (section = 'limits' AND key = 'min_cash_pct') AS cash,
  sum(value) FILTER (section = 'weights') AS w, count(*) FILTER (section = 'history') AS months, count(*) FILTER (section = 'factors') AS states, count(*) FILTER (section = 'crowding') AS told, count(*) FILTER (section = 'factors' AND value > 0) AS active, count(*) FILTER (section = 'factors' AND value > 0 AND text = 'crowded') AS wrong,
  count(*) FILTER (section = 'regime' AND key = 'state' AND text IN ('bull', 'bull_high_vol', 'bear', 'range', 'transition')) AS known, count(*) FILTER (section = 'regime' AND key = 'date' AND text IS NOT NULL) AS dated, count(*) FILTER (section = 'limits' AND value IS NOT NULL AND key IN ('max_position_pct', 'min_cash_pct', 'single_stock_pct')) AS lims FROM contract)
SELECT UNNEST([{'n': 'regime_known', 'ok': known = 1}, {'n': 'dated', 'ok': dated = 1}, {'n': 'history_complete', 'ok': months = 12}, {'n': 'factor_states', 'ok': states = 3}, {'n': 'a_factor_is_active', 'ok': active >= 1}, {'n': 'no_weight_when_crowded', 'ok': wrong = 0}, {'n': 'crowding_told', 'ok': told = 3},
  {'n': 'limits_present', 'ok': lims = 3}, {'n': 'limits_in_range', 'ok': coalesce(total BETWEEN 0 AND 1, false)}, {'n': 'single_below_total', 'ok': coalesce(single <= total, false)}, {'n': 'cash_leaves_room', 'ok': coalesce(1 - cash >= total, false)}, {'n': 'weights_sum_to_one', 'ok': coalesce(abs(w - 1) < 1e-9, false)},
  {'n': 'book_ratio_coverage', 'ok': (SELECT avg((pb IS NOT NULL)::INT) >= 0.6 FROM snap)}]) AS x FROM v""".replace("SELECT UNNEST(", "SELECT x.n AS check_name, x.ok AS ok FROM (SELECT UNNEST(") + ")")
def m34(spark, sf_dir):
    """The checks on the live contract and the snapshot, one row each; some fail where the panel is too short or no factor has a t of two."""
    return ct.landing_checks(_contract(spark, sf_dir), p.ensure_columns(snapshot(spark, sf_dir), SNAP_SPEC), len(FACTORS3))


_KINDS = f"""{_DECIDED[: _DECIDED.index(chr(10) + "SELECT kind, n_events")]}, recent AS (SELECT DISTINCT kind FROM ev WHERE event_date >= (SELECT max(event_date) - 5 FROM ev)),
factor AS (SELECT kind, n_events, {q.rnd('mean_car', 8)} AS car, mean_car > 0 AS up, r.kind IS NOT NULL AS seen FROM types LEFT JOIN (SELECT kind AS k, kind FROM recent) r ON r.k = types.kind)"""


@query("g16_policy_overlay", with_(BARS, CAL, _EVENTS, _AR) + _KINDS.replace("SELECT kind, n_events, floor", "SELECT types.kind, n_events, floor") + """ SELECT kind, CASE WHEN up THEN 0.05 ELSE 0.0 END::DOUBLE AS weight,
  CASE WHEN up AND seen THEN '研究层政策因子 policy_' || kind || '：active，CAR ' || printf('%+.2f', floor(car * 1e4 + 0.5::DOUBLE) / 100) || '%，样本 ' || n_events || '，窗口内有 ' || kind || ' 事件' END AS text FROM factor""")
def g16_overlay(spark, sf_dir):
    """The overlay line of each policy factor with weight (a positive mean return) and an event of the last five days."""
    up = F.col("mean_car") > 0
    states = a20(spark, sf_dir).select("kind", "n_events", "mean_car", F.when(up, "active").otherwise("watch").alias("status"), F.when(up, 0.05).otherwise(0.0).alias("weight"))
    o = p.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), event_kind().alias("kind"))
    recent = o.join(F.broadcast(o.agg(F.date_sub(F.max("d"), 5).alias("since"))), F.col("d") >= F.col("since"))
    return ct.policy_overlay(states, recent).select("kind", "weight", "text")


#: Ten horizon slots and weights by market strength, from the strongest on; the least mean change in percent of the first three.
BUCKETS = {"strong": ((8, 1, 1), (0.8, 0.1, 0.1)), "firm": ((7, 2, 1), (0.7, 0.2, 0.1)), "range": ((6, 3, 1), (0.6, 0.3, 0.1)), "weak": ((5, 3, 2), (0.5, 0.3, 0.2))}
STRENGTH = {"strong": 0.8, "firm": 0.2, "range": -0.3}
HORIZONS = ("short", "medium", "long")


def horizon_bucket(regime, change):
    """The research regime's bucket, else that of the market's mean change in percent."""
    own = F.when(regime.startswith("bull"), "strong").when(regime.startswith("bear") | (regime == "transition"), "weak").when(regime == "range", "range")
    strength = F.lit("weak")
    for name, least in reversed(STRENGTH.items()):
        strength = F.when(F.coalesce(change, F.lit(0.0)) >= least, name).otherwise(strength)
    return F.coalesce(own, strength)


_SLOTS = "CASE b " + " ".join(f"WHEN '{k}' THEN CASE WHEN i < {n[0]} THEN 'short' WHEN i < {n[0] + n[1]} THEN 'medium' ELSE 'long' END" for k, (n, _) in BUCKETS.items()) + " END"


@query("g15_w16_allocation", with_(INDEX, REGIME) + f""", day AS (SELECT x.date, CASE WHEN x.n < 60 THEN NULL ELSE r.regime END AS regime, x.r * 100 AS chg FROM regimes r JOIN idxw x USING (date)),
placed AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l_shipdate, l_suppkey, l_extendedprice, l_quantity, d.regime, d.chg FROM lineitem l ASOF LEFT JOIN day d ON CAST(l.l_shipdate AS DATE) >= d.date),
b AS (SELECT *, CASE WHEN regime LIKE 'bull%' THEN 'strong' WHEN regime LIKE 'bear%' OR regime = 'transition' THEN 'weak' WHEN regime = 'range' THEN 'range' WHEN coalesce(chg, 0) >= 0.8 THEN 'strong' WHEN coalesce(chg, 0) >= 0.2 THEN 'firm' WHEN coalesce(chg, 0) >= -0.3 THEN 'range' ELSE 'weak' END AS b,
  (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1) % 10 AS i FROM placed)
SELECT l_suppkey, b AS bucket, {_SLOTS} AS horizon, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def g15(spark, sf_dir):
    """Each trade's horizon by round robin over the ten slots of its day's bucket; counts by code."""
    r = _regimes(spark, sf_dir).select("date", F.when(F.col("n") >= 60, F.col("regime")).alias("regime"), (F.col("r") * 100).alias("chg"))
    trades = p.table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate")).withColumn("all", F.lit(1))
    days = asof_backward(trades.select("all", "date").distinct(), r.withColumn("all", F.lit(1)), ["all"], "date", ["regime", "chg"])
    t = trades.join(F.broadcast(days.drop("all")), "date").withColumn("bucket", horizon_bucket(F.col("regime"), F.col("chg")))
    i = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")) - 1) % 10
    slots = F.create_map(*[x for k, (n, _) in BUCKETS.items() for x in (F.lit(k), F.array(*[F.lit(h) for h, c in zip(HORIZONS, n, strict=True) for _ in range(c)]))])
    return t.withColumn("i", i).select("l_suppkey", "bucket", F.get(F.element_at(slots, F.col("bucket")), F.col("i")).alias("horizon")).groupBy("l_suppkey", "bucket", "horizon").agg(F.count("*").alias("n"))


#: The experiments: a factor and whether low values are bought.
EXPERIMENTS = [("mom_1", False), ("vol_20d_atr", True), ("liq_20d_turnover", True)]


@query("m29_experiments", " UNION ALL ".join(f"""SELECT * FROM ({with_(*_BASE, _run(f, ascending=low))}, eq AS (SELECT signal, period_ret AS r, product(1 + period_ret) OVER (ORDER BY signal) AS e FROM nav0), dd AS (SELECT *, e / max(e) OVER (ORDER BY signal) - 1 AS d FROM eq)
  SELECT '{f}' AS experiment, count(*) AS periods, {q.rnd('ln(product(1 + r))', 5)} AS log_growth, {q.rnd('stddev_samp(r) * sqrt(12)', 5)} AS annualized_vol, {q.rnd('min(d)', 6)} AS max_drawdown, {q.rnd('avg((r > 0)::INT)', 6)} AS win_rate FROM dd) JOIN (
  {with_(*MONTHLY_CTES, LONG)}{_RANKS.format(by="factor, month", src="long", least=5)} SELECT {_STATS.replace("AS t", "AS ic_t").replace("AS positive", "AS ic_positive")} FROM ics WHERE ic IS NOT NULL AND factor = '{f}') ON true""" for f, low in EXPERIMENTS))
def m29(spark, sf_dir):
    """Every experiment's correlation and backtest figures side by side; the backtests run in one pass, told apart by their scores."""
    names = [f for f, _ in EXPERIMENTS]
    b = _bars(spark, sf_dir)
    scores = factor_table(spark, sf_dir, names, bars=b).select("code", "date", F.explode(F.array(*[F.struct(F.lit(f).alias("variant"), F.col(f).alias("score")) for f in names])).alias("x")).select("code", "date", "x.*")
    rules = {f: bt.Rules(max_price=RULES.max_price, ascending=low) for f, low in EXPERIMENTS}
    runs = bt.rebalance_variants(b, scores, "score", bt.Costs(), rules)
    perf = bt.performance(runs, ["variant"], "signal", "period_ret", 12.0, growth=True)
    perf = perf.select(F.col("variant").alias("experiment"), "periods", *[rnd(c, d).alias(c) for c, d in (("log_growth", 5), ("annualized_vol", 5), ("max_drawdown", 6), ("win_rate", 6))])
    ics = ic_stats(rank_ic(long_monthly(spark, sf_dir, b), "value", "fwd", ["factor", "month"], tasks=p.tasks(spark, sf_dir)), ["factor"]).withColumnsRenamed({"factor": "experiment", "t": "ic_t", "positive": "ic_positive"})
    return perf.join(ics, "experiment")


@query("m31_daily_refresh", with_(*FACTOR_CTES) + "SELECT code, date, " + ", ".join(f"{q.rnd(k, _DIGITS.get(k, 6))} AS {k}" for k in _PRICE) + " FROM factors")
def m31(spark, sf_dir):
    """The factor store after a first run and a refresh with the last three months of bars; as of one run over all of them."""
    store = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    b = _bars(spark, sf_dir).withColumn("turnover", F.col("volume") / 10.0)
    cut = b.agg(F.add_months(F.trunc(F.max("date"), "MM"), -2)).first()[0]
    span = (b.agg(F.datediff(F.max("date"), F.min("date"))).first()[0] or 0) + 1
    for part in (b.filter(F.col("date") < F.lit(cut)), b.filter(F.col("date") >= F.lit(cut))):
        refresh(spark, store, part, fa.PRICE_FACTORS, lookback_days=span)  # codes rest for long here: all of their bars count
    return stored(spark, store, "factors").select("code", "date", *[rnd(c, _DIGITS.get(c, 6)).alias(c) for c in fa.PRICE_FACTORS])


