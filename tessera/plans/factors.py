"""Queries: bars, the sixteen factors, history panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import rnd
from tessera.operators import factors as fa
from tessera.operators import joins
from tessera.plans import sql as q
from tessera.plans.sql import BARS, CAL, lag, roll, with_
from tessera.registry import query
from tessera.sources import panel as p
from tessera.sources.staging import written


def full_bars(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    """Bars (those given, or made anew) with the change in percent and a turnover (volume / 10); given bars are dealt by code over tasks that grow with the table, new ones already are."""
    b = p.bars(spark, sf_dir) if bars is None else bars.repartition(p.tasks(spark, sf_dir), "code")
    return p.normalize(b.withColumn("turnover", F.col("volume") / 10.0))


FULL = f"full_bars AS (SELECT *, volume / 10.0 AS turnover, (close / nullif({lag('close', 1)}, 0) - 1) * 100 AS pct_chg FROM bars)"


_S3 = ["open", "close", "high", "low", "amount", "pct_chg", "turnover"]


@query("s3_normalized_bars", with_(BARS, FULL) + """
SELECT code, date, volume, """ + ", ".join(f"{q.rnd(c, 4)} AS {c}" for c in _S3) + " FROM full_bars")
def s3(spark, sf_dir):
    b = full_bars(spark, sf_dir)
    return b.select("code", "date", "volume", *[rnd(c, 4).alias(c) for c in _S3])


_STEPS = f"""steps AS (
  SELECT *, close / nullif({lag('close', 1)}, 0) - 1 AS ret,
    greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr,
    abs(close / nullif({lag('close', 1)}, 0) - 1) / nullif(amount, 0) * 1e8 AS illiq,
    CASE WHEN coalesce(pct_chg >= (CASE WHEN regexp_matches(code, '^(300|301|688)') THEN .2 WHEN regexp_matches(code, '^(8|4|92)') THEN .3 ELSE .1 END) * 100 - .5, false) THEN 1.0 ELSE 0.0 END AS up,
    -(close / nullif({roll('max', 'close', 60, 20)}, 0) - 1) AS dd
  FROM full_bars)"""
_PRICE = {
    "mom_12_1": f"{lag('close', 21)} / nullif({lag('close', 273)}, 0) - 1",
    "mom_6_1": f"{lag('close', 21)} / nullif({lag('close', 147)}, 0) - 1",
    "mom_1": f"close / nullif({lag('close', 21)}, 0) - 1",
    "vol_60d_realized": f"{roll('stddev_samp', 'ret', 60)} * sqrt(252)",
    "vol_20d_atr": f"{roll('avg', 'tr', 20)} / nullif(close, 0)",
    "liq_20d_turnover": roll("avg", "turnover", 20),
    "liq_20d_amt": roll("avg", "amount", 20),
    "liq_amihud_20d": roll("avg", "illiq", 20),
    "astock_limit_up_5d": roll("sum", "up", 5),
    "astock_maxdd_60d": roll("max", "dd", 60, 20),
}
FACTORS = "factors AS (SELECT code, date, close, amount, volume, " + ", ".join(f"{v} AS {k}" for k, v in _PRICE.items()) + " FROM steps)"
FACTOR_CTES = (BARS, FULL, _STEPS, FACTORS)
_DIGITS = {"liq_20d_amt": 5}


def factor_table(spark, sf_dir, names=None, keep=(), bars: DataFrame | None = None) -> DataFrame:
    return fa.compute_factors(full_bars(spark, sf_dir, bars), names or fa.PRICE_FACTORS, keep)


@query("fa1_fa10_price_factors", with_(*FACTOR_CTES) + "SELECT code, date, " + ", ".join(f"{q.rnd(k, _DIGITS.get(k, 6))} AS {k}" for k in _PRICE) + " FROM factors")
def price_factors(spark, sf_dir):
    """FA1-FA10 and FA21: ten factors in one pass over one window."""
    t = factor_table(spark, sf_dir)
    return t.select("code", "date", *[rnd(c, _DIGITS.get(c, 6)).alias(c) for c in fa.PRICE_FACTORS])


@query("fa3_mom_1_top5", with_(*FACTOR_CTES) + """
, last_bars AS (SELECT code, date_trunc('month', date) AS month, max_by(mom_1, date) AS mom_1, max(date) AS date FROM factors GROUP BY 1, 2)
SELECT CAST(month AS DATE) AS month, rank, code, round(mom_1, 6) AS mom_1 FROM (
  SELECT *, row_number() OVER (PARTITION BY month ORDER BY mom_1 DESC, code) AS rank FROM last_bars WHERE mom_1 IS NOT NULL) WHERE rank <= 5""")
def flagship(spark, sf_dir):
    """The five codes with the highest one-month momentum at their last bar of each month."""
    t = factor_table(spark, sf_dir, ["mom_1"])
    last = t.groupBy("code", F.trunc("date", "MM").alias("month")).agg(F.max_by("mom_1", "date").alias("mom_1")).filter("mom_1 is not null")
    w = Window.partitionBy("month").orderBy(F.desc("mom_1"), "code")
    return last.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("month", "rank", "code", F.round("mom_1", 6).alias("mom_1"))


_SNAP = """snap AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_acctbal / 100 AS pe_ttm, s_acctbal / 1000 AS pb, abs(s_acctbal) * 1e6 AS total_mv,
         s_acctbal / 50000 AS roe, s_suppkey % 7 / 10.0 AS dv_ratio FROM supplier)"""


def snapshot(spark, sf_dir) -> DataFrame:
    """A fundamentals snapshot in an alias layout, from supplier balances."""
    s = p.table(spark, sf_dir, "supplier")
    return s.select(p.code6(F.col("s_suppkey")).alias("code"), (F.col("s_acctbal") / 100).alias("pe"), (F.col("s_acctbal") / 1000).alias("pb"),
                    (F.abs("s_acctbal") * 1e6).alias("total_mv"), (F.col("s_acctbal") / 50000).alias("roe_weighted"), (F.col("s_suppkey") % 7 / 10.0).alias("dv_ratio"))


SNAP_SPEC = {"code": ("string", []), "pe_ttm": ("double", ["pe"]), "pb": ("double", []), "total_mv": ("double", []), "dv_ratio": ("double", []), "roe": ("double", ["roe_weighted"]), "gross_margin": ("double", ["margin"])}


@query("fa11_fa16_snapshot_factors", with_(_SNAP) + """
SELECT code, CASE WHEN pe_ttm > 0 THEN round(1 / pe_ttm, 6) END AS value_ep, round(1 / nullif(pb, 0), 6) AS value_bp, round(dv_ratio, 6) AS value_dp,
       round(CASE WHEN total_mv > 0 THEN ln(total_mv) END, 6) AS size_logcap, round(roe, 6) AS quality_roe, CAST(NULL AS DOUBLE) AS quality_gross_margin FROM snap""")
def snapshot_factors(spark, sf_dir):
    """FA11-FA16 with alias lookup (S8, S9, Z11); the column that is missing gives nulls."""
    t = fa.compute_factors(p.ensure_columns(snapshot(spark, sf_dir), SNAP_SPEC), fa.SNAPSHOT_FACTORS)
    return t.select("code", *[F.round(c, 6).alias(c) for c in fa.SNAPSHOT_FACTORS])


def _by_quarter(spark, sf_dir):
    """Orders grouped by code (each has its share of the customers) and quarter end."""
    n = p.table(spark, sf_dir, "supplier").count()
    code = p.code6(F.col("o_custkey") % F.lit(n) + 1)
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date"), 2))
    return p.table(spark, sf_dir, "orders").groupBy(code.alias("code"), quarter.alias("report"))


def reports(spark, sf_dir) -> DataFrame:
    """Quarter-end reports of each code: the mean order total."""
    return _by_quarter(spark, sf_dir).agg(rnd(F.avg("o_totalprice"), 2).alias("roe"))


def financials(spark, sf_dir) -> DataFrame:
    """Reports with both figures known (S10): ``roe`` and ``gross_margin``, the least order in percent of the largest where there are two or more."""
    margin = F.when(F.count("*") > 1, rnd(100 * F.min("o_totalprice") / F.nullif(F.max("o_totalprice"), F.lit(0.0)), 4))
    return _by_quarter(spark, sf_dir).agg(rnd(F.avg("o_totalprice"), 2).alias("roe"), margin.alias("gross_margin")).dropna(subset=["roe", "gross_margin"])


FINANCIALS = """financials AS (SELECT * FROM (
  SELECT lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 6, '0') AS code, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS report,
         floor(avg(o_totalprice) * 100 + 0.5) / 100 AS roe, CASE WHEN count(*) > 1 THEN """ + q.rnd("100 * min(o_totalprice) / nullif(max(o_totalprice), 0)", 4) + """ END AS gross_margin
  FROM orders GROUP BY 1, 2) WHERE roe IS NOT NULL AND gross_margin IS NOT NULL)"""
_REPORTS = """reports AS (
  SELECT lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 6, '0') AS code,
         last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS report, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS roe
  FROM orders GROUP BY 1, 2)"""
#: Days from a report's end to its publication, by the month of the end.
DISCLOSURE_DAYS = {3: 45, 6: 75, 9: 45, 12: 120}
OTHER_DAYS = 75


def available_from(report) -> F.Column:
    lag_days = F.lit(OTHER_DAYS)
    for month, days in DISCLOSURE_DAYS.items():
        lag_days = F.when(F.month(report) == month, days).otherwise(lag_days)
    return F.date_add(report, lag_days)


@query("fa18_j7_disclosed_quality", with_(BARS, _REPORTS) + """
, known AS (SELECT code, report + CAST(CASE month(report) WHEN 3 THEN 45 WHEN 6 THEN 75 WHEN 9 THEN 45 WHEN 12 THEN 120 ELSE 75 END AS INTEGER) AS date, roe FROM reports)
SELECT b.code, b.date, k.roe FROM bars b ASOF LEFT JOIN known k ON b.code = k.code AND b.date >= k.date""")
def disclosed_quality(spark, sf_dir):
    """FA18 / J7: a report counts from its disclosure day on, backward as-of."""
    known = reports(spark, sf_dir).select("code", available_from(F.col("report")).alias("date"), "roe")
    return joins.asof_backward(p.bars(spark, sf_dir).select("code", "date"), known, ["code"], "date", ["roe"])


_VALUES = ["pe_ttm", "pb", "total_mv"]
HELD = """codes AS (SELECT DISTINCT code FROM bars),
val AS (SELECT code, date, close / 20 - 40 AS pe_ttm, close / 10 AS pb, close * volume AS total_mv FROM bars WHERE day(date) % 3 <> 0),
grid AS (SELECT c.code, cal.date, v.pe_ttm, v.pb, v.total_mv FROM codes c CROSS JOIN cal LEFT JOIN val v ON v.code = c.code AND v.date = cal.date),
held AS (SELECT code, date, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _VALUES) + " FROM grid WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"


@query("fa17_j6_valuation_ffill", with_(BARS, CAL, HELD) + f"""
SELECT code, date, {q.rnd('CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END')} AS value_ep, {q.rnd('CASE WHEN pb > 0 THEN 1 / pb END')} AS value_bp, {q.rnd('ln(nullif(total_mv, 0))')} AS size_logcap FROM held WHERE pb IS NOT NULL""")
def valuation_ffill(spark, sf_dir):
    """FA17 / J6: value_ep, value_bp and size_logcap on the union calendar, each value carried over five rows at most; ratios of 0 or less are null.

    Every third day of the month is left without a value: the gaps that are filled.
    """
    b = written(p.bars(spark, sf_dir).select("code", "date", "close", "volume"), "bars")  # the calendar and the values read them
    return valuations(b).select("code", "date", *[rnd(c).alias(c) for c in VALUE_FACTORS])


VALUE_FACTORS = ["value_ep", "value_bp", "size_logcap"]


#: Fixed value: rows of the calendar over which a valuation is held.
HELD_ROWS = 5


def valuation_factors(close: Column, volume: Column) -> dict[str, Column]:
    """The three valuation factors of a bar, by name; ratios of 0 or less are null."""
    pe_ttm, pb, total_mv = close / 20 - 40, close / 10, close * volume
    return {"value_ep": F.when(pe_ttm > 0, 1 / F.nullif(pe_ttm, F.lit(0.0))), "value_bp": F.when(pb > 0, 1 / F.nullif(pb, F.lit(0.0))), "size_logcap": F.ln(F.nullif(total_mv, F.lit(0.0)))}


def valuations(b: DataFrame) -> DataFrame:
    """The three valuation factors on the union calendar of ``b``, not rounded."""
    cal = p.calendar(b)
    values = b.filter(F.col("close").isNotNull() & (F.dayofmonth("date") % 3 != 0)).join(F.broadcast(cal), "date").select("code", "cal_idx", F.struct("close", "volume").alias("v"))
    f = joins.carried(values, "v", HELD_ROWS, ["code"], "cal_idx").select("code", "cal_idx", "v.*")
    return f.join(F.broadcast(cal), "cal_idx").select("code", "date", *[v.alias(k) for k, v in valuation_factors(F.col("close"), F.col("volume")).items()])


@query("fa19_fa20_baseline_factors", with_(BARS) + """
, hist AS (SELECT code, date, close / nullif(lag(close, 60) OVER w, 0) - 1 AS r FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, round(lag(r, 1) OVER (PARTITION BY code ORDER BY date), 6) AS hist_mean, CAST(0.0 AS DOUBLE) AS constant FROM hist
QUALIFY date >= (SELECT min(date) + 60 FROM bars)""")
def fa19(spark, sf_dir):
    """FA19 (the 60-row change, one row late) and FA20 (constant); dates from 60 days after the first."""
    return baseline_factors(p.bars(spark, sf_dir)).withColumn("hist_mean", F.round("hist_mean", 6))


def baseline_factors(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("code").orderBy("date")
    r = b.withColumn("r", F.col("close") / F.nullif(F.lag("close", 60).over(w), F.lit(0.0)) - 1)
    first = b.agg(F.date_add(F.min("date"), 60).alias("first"))
    out = r.select("code", "date", F.lag("r").over(w).alias("hist_mean"), F.lit(0.0).alias("constant"))
    return out.join(F.broadcast(first), F.col("date") >= F.col("first")).drop("first")
