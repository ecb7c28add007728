"""Queries: as-of days, the event study and its tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import normal_cdf, rnd
from tessera.operators import events as ev
from tessera.operators import joins
from tessera.plans import sql as q
from tessera.plans.sql import BARS, CAL, INDEX, with_
from tessera.registry import query
from tessera.sources import panel as p
from tessera.sources.staging import written

_EVENTS = """ev AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date, CASE o_orderkey % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'plan' ELSE 'tax' END AS kind FROM orders),
t0 AS (SELECT e.*, c.date AS t0, c.cal_idx AS t0_idx FROM ev e ASOF JOIN cal c ON e.event_date <= c.date)"""


def event_kind():
    return F.when(F.col("o_orderkey") % 3 == 0, "rate").when(F.col("o_orderkey") % 3 == 1, "plan").otherwise("tax")


def _events(spark, sf_dir, cal):
    kind = event_kind()
    e = p.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("event_date"), kind.alias("kind"))
    days = joins.asof_forward(e.select("event_date").distinct(), cal, "event_date").filter("t0 is not null")  # one row a date
    return e.join(F.broadcast(days), "event_date").select("event_id", "event_date", "kind", "t0", "t0_idx")


@query("j8_event_days", with_(BARS, CAL, _EVENTS) + "SELECT event_id, event_date, kind, t0, t0_idx FROM t0")
def j8(spark, sf_dir):
    """The first trading day on or after each event."""
    return _events(spark, sf_dir, p.calendar(p.bars(spark, sf_dir)))


_AR = """keyed AS (SELECT code, cal_idx, b.date, close, lag(close) OVER (PARTITION BY code ORDER BY date) AS prev FROM bars b JOIN cal USING (date)),
rets AS (SELECT code, cal_idx, ln(close / prev) / 100 AS r FROM keyed WHERE prev > 0), mkt AS (SELECT cal_idx, avg(r) AS m FROM rets GROUP BY 1),
placed AS (SELECT t0_idx, code, r, m, cal_idx - t0_idx AS rel_day FROM rets JOIN mkt USING (cal_idx) JOIN (SELECT DISTINCT t0_idx FROM t0) ON cal_idx BETWEEN t0_idx - 120 AND t0_idx + 20),
fit AS (SELECT t0_idx, code, avg(r) FILTER (rel_day BETWEEN -120 AND -36) AS my, avg(m) FILTER (rel_day BETWEEN -120 AND -36) AS mm, var_pop(m) FILTER (rel_day BETWEEN -120 AND -36) AS v, covar_pop(m, r) FILTER (rel_day BETWEEN -120 AND -36) AS c,
  count(r) FILTER (rel_day BETWEEN -120 AND -36) AS n, count(r) FILTER (rel_day BETWEEN -5 AND 20) AS days FROM placed GROUP BY 1, 2),
ab AS (SELECT t0_idx, code, CASE WHEN v > 1e-12 THEN c / nullif(v, 0) ELSE 0 END AS beta, my, mm FROM fit WHERE n >= 10 AND days >= 3),
by_day AS (SELECT t0_idx, rel_day, avg(r - (my - beta * mm) - beta * m) AS aar, count(*) AS codes FROM placed JOIN ab USING (t0_idx, code) WHERE rel_day BETWEEN -5 AND 20 GROUP BY 1, 2 HAVING count(*) >= 5),
aar AS (SELECT event_id, kind, rel_day, aar, codes FROM by_day JOIN t0 USING (t0_idx))"""


def _aar(spark, sf_dir):
    b = p.bars(spark, sf_dir).select("code", "date", "close")
    w = Window.partitionBy("code").orderBy("date")
    b = written(b.withColumn("prev", F.lag("close").over(w)), "closes")  # the calendar, the market and the study read it
    cal = p.calendar(b)
    r = b.join(F.broadcast(cal), "date").filter("prev > 0").select("code", "cal_idx", (F.ln(F.col("close") / F.col("prev")) / 100).alias("r"))
    market = r.groupBy("cal_idx").agg(F.avg("r").alias("r"))
    e = _events(spark, sf_dir, cal)
    return e, ev.day_study(e, r, market, least_obs=10, least_codes=5, per_day=3)


@query("m19_abnormal_returns", with_(BARS, CAL, _EVENTS, _AR) + f"SELECT event_id, rel_day, {q.rnd('aar', 8)} AS aar, codes FROM aar")
def m19(spark, sf_dir):
    """Market model per event and code, mean abnormal return per day (10 estimation days, 5 codes and 3 window days asked for; README)."""
    e, aar = _aar(spark, sf_dir)
    e = e.select("event_id", "t0_idx").repartition(p.tasks(spark, sf_dir, "orders"), "event_id")  # each event makes a row a day: spread, however few splits the file has
    return ev.event_study(e, aar).select("event_id", "rel_day", rnd("aar", 8).alias("aar"), "codes")


_CAR = """, wins(lo, hi) AS (VALUES (-1, 1), (-1, 5), (-5, 5)), car AS (SELECT event_id, lo, hi, sum(aar) AS car, coalesce(sum(aar) / (nullif(stddev_samp(aar), 0) / sqrt(count(*))), 0) AS t FROM aar JOIN wins ON rel_day BETWEEN lo AND hi GROUP BY 1, 2, 3 HAVING count(*) = hi - lo + 1)"""


@query("a19_car", with_(BARS, CAL, _EVENTS, _AR) + _CAR + f" SELECT event_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, {q.rnd('car', 8)} AS car, round(t, 5) AS t FROM car")
def a19(spark, sf_dir):
    """Cumulative returns by window with the reference's t."""
    e, aar = _aar(spark, sf_dir)
    c = ev.car_tests(aar, [(-1, 1), (-1, 5), (-5, 5)], F.lit("positive"), "t0_idx")
    return ev.event_study(e, c).select("event_id", "lo", "hi", rnd("car", 8).alias("car"), F.round("t_ref", 5).alias("t"))


_P = "1.0::DOUBLE / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2.0::DOUBLE))"
_DECIDED = f""", one AS (SELECT event_id, kind, sum(aar) AS car, coalesce(sum(aar) / (nullif(stddev_samp(aar), 0) / sqrt(count(*))), 0) AS t FROM aar WHERE rel_day BETWEEN -1 AND 5 GROUP BY 1, 2 HAVING count(*) = 7),
erf AS (SELECT *, 1 - k * (0.254829592::DOUBLE + k * (-0.284496736::DOUBLE + k * (1.421413741::DOUBLE + k * (-1.453152027::DOUBLE + k * 1.061405429::DOUBLE)))) * exp(-t * t / 2) AS e FROM (SELECT *, {_P} AS k FROM one)),
ps AS (SELECT *, 1 - CASE WHEN t >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END AS p FROM erf),
ranked AS (SELECT *, p * count(*) OVER (PARTITION BY kind) / row_number() OVER (PARTITION BY kind ORDER BY p, event_id) AS q FROM ps),
adj AS (SELECT *, least(min(q) OVER (PARTITION BY kind ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING), 1) AS p_adj FROM ranked),
types AS (SELECT kind, count(*) AS n_events, avg(car) AS mean_car, median(car) AS median_car, coalesce(stddev_samp(car), 0) AS std_car, avg((car > 0)::INT) AS consistency, avg((p_adj < 0.05)::INT) AS rejection FROM adj GROUP BY 1)
SELECT kind, n_events, {", ".join(f"{q.rnd(c, 8)} AS {c}" for c in ("mean_car", "median_car", "std_car"))}, round(consistency, 6) AS consistency, round(rejection, 6) AS rejection,
  CASE WHEN n_events < 5 THEN 'too_few' WHEN consistency < 0.6 OR rejection < 0.5 THEN 'reject' ELSE 'accept' END AS decision FROM types"""


@query("a20_m20_m21_decisions", with_(BARS, CAL, _EVENTS, _AR) + _DECIDED)
def a20(spark, sf_dir):
    """One-sided p by the normal law, adjusted within types, decision ladder."""
    e, aar = _aar(spark, sf_dir)
    c = ev.car_tests(aar, [(-1, 5)], F.lit("positive"), "t0_idx")
    days = ev.event_study(e.groupBy("kind", "t0_idx").agg(F.count("*").alias("events")), c)
    adjusted = ev.benjamini_hochberg_counted(days, ["kind"], "p", "t0_idx", "events").select("kind", "t0_idx", "car", "p_adj")
    d = ev.decide(e.select("kind", "t0_idx").join(F.broadcast(adjusted), ["kind", "t0_idx"]), "kind")
    return d.select("kind", "n_events", *[rnd(c, 8).alias(c) for c in ("mean_car", "median_car", "std_car")], F.round("consistency", 6).alias("consistency"), F.round("rejection", 6).alias("rejection"), "decision")


@query("m21_benjamini_hochberg", with_("x AS (SELECT c_mktsegment AS kind, c_custkey, (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS p FROM customer)",
       "r AS (SELECT *, p * count(*) OVER (PARTITION BY kind) / row_number() OVER (PARTITION BY kind ORDER BY p, c_custkey) AS q FROM x)") + "SELECT kind, c_custkey, round(least(min(q) OVER (PARTITION BY kind ORDER BY p DESC, c_custkey DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS p_adj FROM r")
def m21(spark, sf_dir):
    """Adjusted p-values by two windows."""
    x = p.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), "c_custkey", (F.col("c_custkey") * 37 % 1000 / F.lit(1000.0)).alias("p"))
    return ev.benjamini_hochberg(x, ["kind"], "p", "c_custkey").select("kind", "c_custkey", F.round("p_adj", 8).alias("p_adj"))


@query("m20_normal_cdf", "SELECT x, floor(CASE WHEN x >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END * 1e8 + 0.5) / 1e8 AS p FROM (SELECT x, 1 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z) AS e FROM (SELECT x, z, 1.0::DOUBLE / (1 + 0.3275911::DOUBLE * z) AS t FROM (SELECT (n_nationkey - 12) / 4.0::DOUBLE AS x, abs((n_nationkey - 12) / 4.0::DOUBLE) / sqrt(2.0::DOUBLE) AS z FROM nation)))")
def m20(spark, sf_dir):
    """The normal distribution as a column expression."""
    x = p.table(spark, sf_dir, "nation").select(((F.col("n_nationkey") - 12) / F.lit(4.0)).alias("x"))
    return x.select("x", rnd(normal_cdf("x"), 8).alias("p"))


@query("w4_index_log_returns", with_(BARS, CAL, INDEX) + f"SELECT cal.date, {q.rnd('ln(idx.close / nullif(lag(idx.close) OVER (ORDER BY cal.date), 0))')} AS r FROM cal LEFT JOIN idx USING (date)")
def w4(spark, sf_dir):
    """Log returns of the index on the trading calendar."""
    cal = p.calendar(p.bars(spark, sf_dir))
    x = cal.join(p.index_series(spark, sf_dir), "date", "left")
    return x.select("date", rnd(F.ln(F.col("close") / F.nullif(F.lag("close").over(Window.orderBy("date")), F.lit(0.0)))).alias("r"))
