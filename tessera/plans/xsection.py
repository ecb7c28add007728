"""Queries: cross-sections of each month, rank correlations, neutralization, crowding, regressions."""

from __future__ import annotations



from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import clip, ic_stats, rank_ic, rnd, safe_corr, winsorize, zscore
from tessera.operators import models
from tessera.plans import sql as q
from tessera.plans.backtest import REGIME, regimes
from tessera.plans.factors import FACTOR_CTES, factor_table
from tessera.plans.sql import BARS, CAL, ENDS, INDEX, INDUSTRY, with_
from tessera.registry import query
from tessera.sources import panel as p
from tessera.sources.staging import written

FACTORS3 = ["mom_1", "vol_20d_atr", "liq_20d_turnover"]
MONTHLY = """monthly AS (
  SELECT *, lead(close) OVER (PARTITION BY code ORDER BY month) / nullif(close, 0) - 1 AS fwd FROM (
    SELECT code, CAST(date_trunc('month', date) AS DATE) AS month, arg_max_null(close, date) AS close, arg_max_null(mom_1, date) AS mom_1,
           arg_max_null(vol_20d_atr, date) AS vol_20d_atr, arg_max_null(liq_20d_turnover, date) AS liq_20d_turnover, arg_max_null(amount, date) AS cap
    FROM factors GROUP BY 1, 2))"""
MONTHLY_CTES = (*FACTOR_CTES, MONTHLY)
LONG = "long AS (SELECT month, code, factor, " + q.rnd("value", 8) + " AS value, fwd, cap FROM monthly UNPIVOT (value FOR factor IN (mom_1, vol_20d_atr, liq_20d_turnover)))"
_RANKS = """, ranked AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY {by} ORDER BY fwd) + (count(*) OVER (PARTITION BY {by}, fwd) - 1) / 2.0::DOUBLE AS y FROM {src} WHERE value IS NOT NULL AND fwd IS NOT NULL),
ics AS (SELECT {by}, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic, count(*) AS n FROM ranked GROUP BY {by} HAVING count(*) >= {least})"""
_STATS = "count(*) AS months, round(avg(ic), 6) AS mean_ic, round(median(ic), 6) AS median_ic, round(avg((ic > 0)::INT), 6) AS positive, round(coalesce(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 0), 5) AS t"


def monthly(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    """The last bar of each code and month (of the bars given, or made anew) with its factors, and the return to the next month's last close."""
    t = factor_table(spark, sf_dir, FACTORS3, ["close", "amount"], bars)
    m = t.groupBy("code", F.trunc("date", "MM").alias("month")).agg(*[F.max_by(c, "date").alias(n) for c, n in [("close", "close"), *[(f, f) for f in FACTORS3], ("amount", "cap")]])
    w = Window.partitionBy("code").orderBy("month")
    return m.withColumn("fwd", F.lead("close").over(w) / F.nullif("close", F.lit(0.0)) - 1)


def long_monthly(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return monthly(spark, sf_dir, bars).unpivot(["month", "code", "fwd", "cap"], FACTORS3, "factor", "value").filter("value is not null").withColumn("value", rnd("value", 8))


def _industry(spark, sf_dir) -> DataFrame:
    s, n, r = (p.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return joined.select(p.code6(F.col("s_suppkey")).alias("code"), F.coalesce("r_name", F.lit("none")).alias("industry"))


@query("a4_rank_ic", with_(*MONTHLY_CTES, LONG) + _RANKS.format(by="factor, month", src="long", least=5) + " SELECT factor, month, round(ic, 6) AS ic, n FROM ics WHERE ic IS NOT NULL")
def a4(spark, sf_dir):
    """Spearman rank correlation of each factor with the next return, per month."""
    return rank_ic(long_monthly(spark, sf_dir), "value", "fwd", ["factor", "month"]).filter("ic is not null").select("factor", "month", F.round("ic", 6).alias("ic"), "n")


@query("a5_ic_summary", with_(*MONTHLY_CTES, LONG) + _RANKS.format(by="factor, month", src="long", least=5) + f" SELECT factor, {_STATS} FROM ics WHERE ic IS NOT NULL GROUP BY factor")
def a5(spark, sf_dir):
    """Mean, median, positive share and t of the monthly rank correlations."""
    return ic_stats(rank_ic(long_monthly(spark, sf_dir), "value", "fwd", ["factor", "month"]), ["factor"])


@query("a7_within_industry_ic", with_(*MONTHLY_CTES, LONG, INDUSTRY) + ", ind AS (SELECT long.*, coalesce(industry, 'none') AS industry FROM long LEFT JOIN industry USING (code))"
       + _RANKS.format(by="factor, month, industry", src="ind", least=10) + f", m AS (SELECT factor, month, avg(ic) AS ic FROM ics WHERE ic IS NOT NULL GROUP BY factor, month) SELECT factor, {_STATS} FROM m GROUP BY factor")
def a7(spark, sf_dir):
    """Correlations within industries of ten names or more, their plain mean per month, then the summary."""
    ind = long_monthly(spark, sf_dir).join(_industry(spark, sf_dir), "code", "left").fillna("none", ["industry"])
    ics = rank_ic(ind, "value", "fwd", ["factor", "month", "industry"], least=10).filter("ic is not null")
    return ic_stats(ics.groupBy("factor", "month").agg(F.avg("ic").alias("ic")), ["factor"])


@query("a8_cap_tercile_ic", with_(*MONTHLY_CTES, LONG) + """, edges AS (SELECT factor, month, quantile_cont(cap, 1/3.0::DOUBLE) AS e1, quantile_cont(cap, 2/3.0::DOUBLE) AS e2 FROM long WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30),
cut AS (SELECT long.*, CASE WHEN cap <= e1 THEN 'small' WHEN cap <= e2 THEN 'middle' ELSE 'large' END AS tercile FROM long JOIN edges USING (factor, month))"""
       + _RANKS.format(by="factor, month, tercile", src="cut", least=5) + f" SELECT factor, tercile, {_STATS} FROM ics WHERE ic IS NOT NULL GROUP BY factor, tercile")
def a8(spark, sf_dir):
    """By thirds of size, cut at percentile edges (equal sizes share a bin; ntile would part them)."""
    rows = long_monthly(spark, sf_dir).filter("fwd is not null")
    edges = rows.groupBy("factor", "month").agg(F.percentile("cap", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"), F.count("*").alias("k")).filter("k >= 30")
    cut = rows.join(F.broadcast(edges), ["factor", "month"]).withColumn("tercile", F.when(F.col("cap") <= F.col("e")[0], "small").when(F.col("cap") <= F.col("e")[1], "middle").otherwise("large"))
    return ic_stats(rank_ic(cut, "value", "fwd", ["factor", "month", "tercile"]).filter("ic is not null"), ["factor", "tercile"])


@query("m1_industry_neutral", with_(*MONTHLY_CTES, INDUSTRY) + """, joined AS (SELECT month, code, vol_20d_atr AS y, coalesce(industry, 'none') AS industry FROM monthly LEFT JOIN industry USING (code) WHERE vol_20d_atr IS NOT NULL),
bounds AS (SELECT month, quantile_cont(y, 0.01::DOUBLE) AS lo, quantile_cont(y, 0.99::DOUBLE) AS hi, count(*) AS n, stddev_pop(y) AS s FROM joined GROUP BY 1),
w AS (SELECT j.*, least(greatest(y, lo), hi) AS yw, n, s FROM joined j JOIN bounds USING (month))
SELECT month, code, industry, """ + q.rnd("CASE WHEN n >= 30 AND s > 0 THEN yw - avg(yw) OVER (PARTITION BY month, industry) ELSE y END") + " AS neutral FROM w")
def m1(spark, sf_dir):
    """M1, P5: winsorized values less the mean of month and industry (the residual on dummies); thin months stay raw."""
    rows = monthly(spark, sf_dir).filter("vol_20d_atr is not null").join(_industry(spark, sf_dir), "code", "left").fillna("none", ["industry"])
    return models.industry_neutral(rows, ["month"], "vol_20d_atr", "industry").select("month", "code", "industry", rnd("neutral").alias("neutral"))


_Z = """, b AS (SELECT month, factor, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi FROM long GROUP BY 1, 2),
clipped AS (SELECT long.*, least(greatest(value, lo), hi) AS v FROM long JOIN b USING (month, factor)),
z AS (SELECT *, (v - avg(v) OVER (PARTITION BY month, factor)) / (stddev_pop(v) OVER (PARTITION BY month, factor) + 1e-12) AS z0,
        (v - avg(v) OVER (PARTITION BY month, factor)) / nullif(stddev_samp(v) OVER (PARTITION BY month, factor), 0) AS z1 FROM clipped)"""


def _z(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy("month", "factor")
    v = (long_monthly(spark, sf_dir) if rows is None else rows).withColumn("v", winsorize("value", window=w))
    return v.withColumns({"z0": zscore("v", w), "z1": (F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_samp("v").over(w), F.lit(0.0))})


@query("p4_p7_winsor_zscores", with_(*MONTHLY_CTES, LONG) + _Z + f" SELECT month, factor, code, {q.rnd('z0')} AS z_pop, {q.rnd('coalesce(z1, 0)')} AS z_sample, {q.rnd('CASE WHEN fwd IS NOT NULL THEN least(greatest(fwd, -0.21), 0.21) END')} AS fwd_clipped FROM z")
def p4_p7(spark, sf_dir):
    """Fixed clip, quantile winsorizing and both z-scores."""
    return _z(spark, sf_dir).select("month", "factor", "code", rnd("z0").alias("z_pop"), rnd(F.coalesce("z1", F.lit(0.0))).alias("z_sample"), rnd(clip("fwd", -0.21, 0.21)).alias("fwd_clipped"))


_CROWD = """, fr AS (SELECT factor, month, CASE WHEN count(*) >= 20 THEN sum(z1 * fwd) / nullif(sum(abs(z1)), 0) END AS r FROM z WHERE z1 IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2)"""


def factor_returns(z: DataFrame, least: int = 20) -> DataFrame:
    good = z.filter("z1 is not null and fwd is not null")
    r = F.sum(F.col("z1") * F.col("fwd")) / F.nullif(F.sum(F.abs("z1")), F.lit(0.0))
    return good.groupBy("factor", "month").agg(F.when(F.count("*") >= least, r).alias("r")).filter("r is not null")


@query("a15_factor_returns", with_(*MONTHLY_CTES, LONG) + _Z + _CROWD + " SELECT factor, month, round(r, 6) AS factor_return FROM fr WHERE r IS NOT NULL")
def a15(spark, sf_dir):
    """Score-weighted return of a factor, keyed by date and code."""
    return factor_returns(_z(spark, sf_dir)).select("factor", "month", F.round("r", 6).alias("factor_return"))


@query("a16_crowding", with_(*MONTHLY_CTES, LONG) + _Z + _CROWD + """, b2 AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY month DESC) AS back FROM fr WHERE r IS NOT NULL),
s AS (SELECT factor, avg(r) FILTER (back <= 12) AS m1, stddev_samp(r) FILTER (back <= 12) AS s1, avg(r) FILTER (back BETWEEN 13 AND 36) AS m0, stddev_samp(r) FILTER (back BETWEEN 13 AND 36) AS s0 FROM b2 GROUP BY factor),
f AS (SELECT factor, coalesce(m1 / nullif(s1, 0) * sqrt(252), 0) AS sharpe, s1 * sqrt(252) AS vol, coalesce(m0 / nullif(s0, 0) * sqrt(252), 0) AS sharpe_prev, s0 * sqrt(252) AS vol_prev, m1 FROM s),
g AS (SELECT *, (sharpe_prev > 0 AND sharpe < sharpe_prev * 0.5)::BIGINT + coalesce(vol > vol_prev * 1.3, false)::BIGINT + (m1 < 0)::BIGINT AS flags FROM f)
SELECT factor, round(sharpe, 3) AS sharpe, round(vol, 4) AS vol, round(sharpe_prev, 3) AS sharpe_prev, round(vol_prev, 4) AS vol_prev, round(m1, 6) AS mean_return, flags, flags >= 2 AS crowded FROM g""")
def a16(spark, sf_dir):
    """The last 12 periods against the 24 before; all factors in one groupBy; crowded from two flags on."""
    return models.crowding(factor_returns(_z(spark, sf_dir)), "factor", "month", "r", 12, 24)


@query("m4_forward_returns", with_(BARS, CAL, ENDS) + """, h AS (SELECT unnest([21, 42, 63]) AS h), starts AS (SELECT b.code, b.date, e.cal_idx, b.close FROM bars b JOIN ends e USING (date)),
keyed AS (SELECT b.code, c.cal_idx, b.close FROM bars b JOIN cal c USING (date))
SELECT a.code, a.date, CAST(h.h AS BIGINT) AS horizon, """ + q.rnd("k.close / nullif(a.close, 0) - 1") + " AS fwd FROM starts a CROSS JOIN h JOIN keyed k ON k.code = a.code AND k.cal_idx = a.cal_idx + h.h")
def m4(spark, sf_dir, bars: DataFrame | None = None):
    """Returns over 21, 42 and 63 days of the union calendar, not of a code's own rows."""
    b = written(p.bars(spark, sf_dir).select("code", "date", "close"), "closes") if bars is None else bars  # the calendar and both sides read them
    cal = p.calendar(b)
    keyed = b.join(F.broadcast(cal), "date").select("code", "date", "cal_idx", "close")
    at = keyed.join(F.broadcast(p.month_ends(cal).select("date")), "date").withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in (21, 42, 63)])))
    later = keyed.select("code", F.col("cal_idx").alias("to_idx"), F.col("close").alias("later"))
    out = at.withColumn("to_idx", F.col("cal_idx") + F.col("horizon")).join(later, ["code", "to_idx"])
    return out.select("code", "date", "horizon", rnd(F.col("later") / F.nullif("close", F.lit(0.0)) - 1).alias("fwd"))


@query("m5_ols_one_factor", with_(*MONTHLY_CTES, LONG) + _Z + """ SELECT factor, month, count(*) AS n, round(regr_slope(least(greatest(fwd, -0.21), 0.21), z0), 6) AS coef, round(regr_intercept(least(greatest(fwd, -0.21), 0.21), z0), 6) AS intercept,
  round(regr_r2(least(greatest(fwd, -0.21), 0.21), z0), 6) AS r2 FROM z WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30""")
def m5_one(spark, sf_dir):
    """M5 with one factor, all inside the aggregate."""
    z = _z(spark, sf_dir).filter("fwd is not null").withColumn("y", clip("fwd", -0.21, 0.21))
    return z.groupBy("factor", "month").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "z0"), 6).alias("coef"), F.round(F.regr_intercept("y", "z0"), 6).alias("intercept"), F.round(F.regr_r2("y", "z0"), 6).alias("r2")).filter("n >= 30")


def _standard(rows: DataFrame, by: list[str], names: list[str] = FACTORS3) -> DataFrame:
    """Rows with all factors and a return: winsorized z-scores by group, the return clipped as ``y``."""
    w = Window.partitionBy(*by)
    m = rows.filter("fwd is not null and " + " and ".join(f"{f} is not null" for f in names))
    m = m.withColumns({f: winsorize(f, window=w) for f in names}).withColumns({f: zscore(f, w) for f in names})
    return m.withColumn("y", clip("fwd", -0.21, 0.21))


def _standard_sql(src: str, by: str, names: list[str] = FACTORS3) -> str:
    """``std``: the twin of ``_standard``."""
    many = ", ".join(f"quantile_cont({f}, [0.01::DOUBLE, 0.99::DOUBLE]) AS e{i}" for i, f in enumerate(names, 1))
    held = ", ".join(f"least(greatest({f}, e{i}[1]), e{i}[2]) AS v{i}" for i, f in enumerate(names, 1))
    score = ", ".join(f"(v{i} - avg(v{i}) OVER g) / (stddev_pop(v{i}) OVER g + 1e-12) AS x{i}" for i in range(1, len(names) + 1))
    return f""", full_rows AS (SELECT {by}, code, {", ".join(names)}, least(greatest(fwd, -0.21::DOUBLE), 0.21::DOUBLE) AS y FROM {src} WHERE fwd IS NOT NULL AND {" AND ".join(f"{f} IS NOT NULL" for f in names)}),
edge AS (SELECT {by}, {many} FROM full_rows GROUP BY {by}), held_in AS (SELECT {by}, code, y, {held} FROM full_rows JOIN edge USING ({by})),
std AS (SELECT {by}, y, {score} FROM held_in WINDOW g AS (PARTITION BY {by}))"""


def _models_sql(by: str) -> str:
    """``fits`` from ``std``: OLS and ridge by the inverse of the centred 3 x 3 matrix, LASSO step by step."""
    pairs = [(i, j) for i in (1, 2, 3) for j in range(i, 4)]
    raw = ", ".join([f"sum(x{i} * x{j}) AS r{i}{j}" for i, j in pairs] + [f"sum(x{i}) AS s{i}, sum(x{i} * y) AS h{i}" for i in (1, 2, 3)])
    centred = ", ".join([f"r{i}{j} - s{i} * s{j} / n AS c{i}{j}" for i, j in pairs] + [f"h{i} - s{i} * sy / n AS k{i}, s{i} / n AS m{i}" for i in (1, 2, 3)])
    quadratic = lambda c: " + ".join(f"{1 if i == j else 2} * b{i} * b{j} * {c}{i}{j}" for i, j in pairs)
    inverse = "(a22 * a33 - a23 * a23) / det AS i11, (c13 * c23 - c12 * a33) / det AS i12, (c12 * c23 - c13 * a22) / det AS i13, (a11 * a33 - c13 * c13) / det AS i22, (c12 * c13 - a11 * c23) / det AS i23, (a11 * a22 - c12 * c12) / det AS i33"
    soft = lambda e: f"(CASE WHEN {e} > 0 THEN 1 ELSE -1 END) * greatest(abs({e}) - 0.001::DOUBLE, 0) / n"
    names = ["intercept", *FACTORS3]
    long = lambda t: "UNNEST([" + ", ".join(f"{{'factor': '{f}', 'coef': b{i}, 't': {t and f't{i}' or 'NULL::DOUBLE'}}}" for i, f in enumerate(names)) + "])"
    return f""", sums AS (SELECT {by}, count(*) AS n, sum(y) AS sy, sum(y * y) AS yy, {raw} FROM std GROUP BY {by} HAVING count(*) >= 30),
cen AS (SELECT *, yy - sy * sy / n AS tss, sy / n AS my, {centred} FROM sums),
pen AS (SELECT *, c11 + alpha AS a11, c22 + alpha AS a22, c33 + alpha AS a33, c23 AS a23 FROM cen, (VALUES ('ols', 0.0::DOUBLE), ('ridge', 1.0::DOUBLE)) AS kinds(model, alpha)),
inv AS (SELECT *, {inverse} FROM (SELECT *, a11 * (a22 * a33 - c23 * c23) - c12 * (c12 * a33 - c23 * c13) + c13 * (c12 * c23 - a22 * c13) AS det FROM pen)),
bet AS (SELECT *, i11 * k1 + i12 * k2 + i13 * k3 AS b1, i12 * k1 + i22 * k2 + i23 * k3 AS b2, i13 * k1 + i23 * k2 + i33 * k3 AS b3 FROM inv),
res AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, greatest(tss - 2 * (b1 * k1 + b2 * k2 + b3 * k3) + {quadratic("c")}, 0) AS rss FROM bet),
lin AS (SELECT {by}, model, n, 1 - rss / tss AS r2, b0, b1, b2, b3, CASE WHEN model = 'ols' THEN b0 / sqrt(rss / (n - 4) * (1.0::DOUBLE / n + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23))) END AS t0,
  {", ".join(f"CASE WHEN model = 'ols' THEN b{i} / sqrt(rss / (n - 4) * i{i}{i}) END AS t{i}" for i in (1, 2, 3))} FROM res),
las AS (SELECT *, 0 AS step, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 1.0::DOUBLE AS moved FROM cen
  UNION ALL SELECT * EXCLUDE (o1, o2, o3, b1, b2, b3), b1, b2, b3, greatest(abs(b1 - o1), abs(b2 - o2), abs(b3 - o3)) AS moved FROM (
    SELECT *, {soft("(k3 - r13 * b1 - r23 * b2)")} AS b3 FROM (SELECT *, {soft("(k2 - r12 * b1 - r23 * o3)")} AS b2 FROM (SELECT *, {soft("(k1 - r12 * o2 - r13 * o3)")} AS b1 FROM (
      SELECT * EXCLUDE (b1, b2, b3, step, moved), step + 1 AS step, b1 AS o1, b2 AS o2, b3 AS o3 FROM las WHERE step < 500 AND moved >= 1e-6))))),
lasd AS (SELECT {by}, 'lasso' AS model, n, 1 - (tss - 2 * (b1 * k1 + b2 * k2 + b3 * k3) + {quadratic("r")}) / tss AS r2, my AS b0, b1, b2, b3 FROM las QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY step DESC) = 1),
flat AS (SELECT {by}, model, n, r2, {long(True)} AS u FROM lin UNION ALL SELECT {by}, model, n, r2, {long(False)} AS u FROM lasd),
fits AS (SELECT {by}, model, u.factor AS factor, u.coef AS coef, u.t AS t, r2, n FROM flat)"""


_TAIL = "1.0::DOUBLE / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2.0::DOUBLE))"
_P = f"exp(-t * t / 2) * {_TAIL} * (0.254829592::DOUBLE + {_TAIL} * (-0.284496736::DOUBLE + {_TAIL} * (1.421413741::DOUBLE + {_TAIL} * (-1.453152027::DOUBLE + {_TAIL} * 1.061405429::DOUBLE))))"


def _cross_models(spark, sf_dir) -> DataFrame:
    return models.cross_section_models(_standard(monthly(spark, sf_dir), ["month"]), "month", FACTORS3, "y")


@query("m5_m9_cross_section_models", with_(*MONTHLY_CTES) + _standard_sql("monthly", "month") + _models_sql("month") + f" SELECT month, model, factor, {q.rnd('coef', 7)} AS coef, {q.rnd('t', 4)} AS t, {q.rnd(_P, 5)} AS p, {q.rnd('r2', 6)} AS r2, n FROM fits")
def m5_m9(spark, sf_dir):
    """M5-M9: OLS with t and p, ridge and LASSO per month, from the month's Gram matrix."""
    x = _cross_models(spark, sf_dir)
    return x.select("month", "model", "factor", rnd("coef", 7).alias("coef"), rnd("t", 4).alias("t"), rnd("p", 5).alias("p"), rnd("r2", 6).alias("r2"), "n")


SPLIT = "1999-01-01"


def _summary_sql(by: str) -> str:
    """``summary`` of ``fits`` by ``by``, model, factor and half."""
    return f""", halves AS (SELECT *, CASE WHEN month < DATE '{SPLIT}' THEN 'in_sample' ELSE 'out_of_sample' END AS half FROM fits),
dev AS (SELECT *, coef - avg(coef) OVER (PARTITION BY {by}) AS e FROM halves),
lagged AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4 FROM dev WINDOW w AS (PARTITION BY {by} ORDER BY month)),
summary AS (SELECT {by}, count(*) AS months, avg(coef) AS mean, median(coef) AS median, avg((coef > 0)::INT) AS positive, avg(abs(coef)) AS mean_abs, avg(t) AS mean_t, avg((abs(t) > 2)::INT) AS large_t, avg(r2) AS mean_r2,
  avg(coef) / nullif(sqrt(greatest(sum(e * e) + 2 * (0.8 * coalesce(sum(e * e1), 0) + 0.6 * coalesce(sum(e * e2), 0) + 0.4 * coalesce(sum(e * e3), 0) + 0.2 * coalesce(sum(e * e4), 0)), 0)) / count(*), 0) AS nw_t FROM lagged GROUP BY {by})"""


_DIGITS = {"mean": 7, "median": 7, "positive": 4, "mean_abs": 7, "mean_t": 4, "large_t": 4, "mean_r2": 6, "nw_t": 3}


@query("a17_a18_coefficient_summary", with_(*MONTHLY_CTES) + _standard_sql("monthly", "month") + _models_sql("month") + _summary_sql("model, factor, half") + " SELECT model, factor, half, months, " + ", ".join(f"{q.rnd(c, d)} AS {c}" for c, d in _DIGITS.items()) + " FROM summary")
def a17_a18(spark, sf_dir):
    """Per model, factor and in- or out-of-sample half; Newey-West t with four lags."""
    x = models.coefficient_summary(_cross_models(spark, sf_dir), SPLIT)
    return x.select("model", "factor", "half", "months", *[rnd(c, d).alias(c) for c, d in _DIGITS.items()])


@query("m23_model_cross_check", with_(*MONTHLY_CTES) + _standard_sql("monthly", "month") + _models_sql("month") + _summary_sql("model, factor, half") + f""", wide AS (SELECT factor, half, {", ".join(f"max(mean) FILTER (model = '{m}') AS {m}" for m in ("ols", "ridge", "lasso"))} FROM summary WHERE factor <> 'intercept' GROUP BY 1, 2)
SELECT i.factor, {", ".join(f"{q.rnd(f'{h}.{m}', 7)} AS {m}_{n}" for h, n in (("i", "in"), ("o", "out")) for m in ("ols", "ridge", "lasso"))}, sign(i.ols) = sign(i.ridge) AND sign(i.ols) = sign(i.lasso) AS agree_in, sign(o.ols) = sign(o.ridge) AND sign(o.ols) = sign(o.lasso) AS agree_out, sign(i.ols) = sign(o.ols) AS ols_holds FROM wide i JOIN wide o ON i.factor = o.factor AND i.half = 'in_sample' AND o.half = 'out_of_sample'""")
def m23(spark, sf_dir):
    """Whether OLS, ridge and LASSO agree on each factor's sign, in and out of sample, and whether the sign holds."""
    x = models.coefficient_summary(_cross_models(spark, sf_dir), SPLIT).filter("factor <> 'intercept'")
    mean = {f"{m}_{n}": F.max(F.when((F.col("model") == m) & (F.col("half") == h), F.col("mean"))) for h, n in (("in_sample", "in"), ("out_of_sample", "out")) for m in ("ols", "ridge", "lasso")}
    w = x.groupBy("factor").agg(*[v.alias(k) for k, v in mean.items()]).dropna()
    same = lambda a, b: F.signum(a) == F.signum(b)
    agree = {f"agree_{n}": same(f"ols_{n}", f"ridge_{n}") & same(f"ols_{n}", f"lasso_{n}") for n in ("in", "out")}
    return w.select("factor", *[rnd(c, 7).alias(c) for c in mean], *[v.alias(k) for k, v in agree.items()], same("ols_in", "ols_out").alias("ols_holds"))


_VARIANTS = ", " + INDUSTRY + """,
lind AS (SELECT l.*, coalesce(industry, 'none') AS industry FROM long l LEFT JOIN industry USING (code)),
lb AS (SELECT month, factor, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.99::DOUBLE) AS hi, count(*) AS k, stddev_pop(value) AS s FROM lind GROUP BY 1, 2),
lw AS (SELECT lind.*, least(greatest(value, lo), hi) AS vw, k, s FROM lind JOIN lb USING (month, factor)),
both_ways AS (SELECT 'raw' AS variant, month, code, factor, value, fwd FROM long UNION ALL
  SELECT 'neutral', month, code, factor, """ + q.rnd("CASE WHEN k >= 30 AND s > 0 THEN vw - avg(vw) OVER (PARTITION BY month, factor, industry) ELSE value END", 8) + """, fwd FROM lw),
spread AS (SELECT variant, month, code, any_value(fwd) AS fwd, """ + ", ".join(f"max(value) FILTER (factor = '{f}') AS {f}" for f in FACTORS3) + " FROM both_ways GROUP BY 1, 2, 3)"


@query("m22_neutralization_audit", with_(*MONTHLY_CTES, LONG) + _VARIANTS + _standard_sql("spread", "variant, month") + _models_sql("variant, month") + _summary_sql("variant, model, factor, half") + _RANKS.format(by="variant, factor, month", src="both_ways", least=5) + f""",
icm AS (SELECT variant, factor, avg(ic) AS mean_ic, coalesce(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 0) AS ic_t FROM (SELECT variant, factor, {q.rnd('ic', 9)} AS ic FROM ics WHERE ic IS NOT NULL AND month >= DATE '{SPLIT}') GROUP BY 1, 2),
one AS (SELECT s.variant, s.factor, mean, positive, nw_t, mean_ic, ic_t FROM summary s JOIN icm USING (variant, factor) WHERE model = 'ols' AND half = 'out_of_sample')
SELECT r.factor, {", ".join(f"{q.rnd(f'{a}.{c}', d)} AS {n}_{c}" for a, n in (("r", "raw"), ("n", "neutral")) for c, d in (("mean", 7), ("positive", 4), ("nw_t", 3), ("mean_ic", 6), ("ic_t", 4)))}, sign(r.mean) = sign(n.mean) AS sign_holds, {q.rnd('abs(n.mean_ic) - abs(r.mean_ic)', 6)} AS ic_gain FROM one r JOIN one n ON r.factor = n.factor AND r.variant = 'raw' AND n.variant = 'neutral'""")
def m22(spark, sf_dir):
    """Each factor raw and less its industry's mean, out of sample: OLS coefficients and rank correlations, signs kept, gain in correlation."""
    raw = written(long_monthly(spark, sf_dir).join(_industry(spark, sf_dir), "code", "left").fillna("none", ["industry"]), "raw")
    neutral = models.industry_neutral(raw, ["month", "factor"], "value", "industry").withColumn("value", rnd("neutral", 8))
    rows = raw.withColumn("variant", F.lit("raw")).unionByName(written(neutral.drop("neutral").withColumn("variant", F.lit("neutral")), "neutral"))  # fits and correlations read both
    wide = rows.groupBy("variant", "month", "code").agg(F.max("fwd").alias("fwd"), *[F.max(F.when(F.col("factor") == f, F.col("value"))).alias(f) for f in FACTORS3])
    fits = models.cross_section_models(_standard(wide, ["variant", "month"]), ["variant", "month"], FACTORS3, "y").filter("model = 'ols'")
    coefs = models.coefficient_summary(fits, SPLIT, ("variant",)).filter("half = 'out_of_sample'").select("variant", "factor", "mean", "positive", "nw_t")
    ics = rank_ic(rows, "value", "fwd", ["variant", "factor", "month"], tasks=p.tasks(spark, sf_dir)).filter(F.col("ic").isNotNull() & (F.col("month") >= F.lit(SPLIT).cast("date"))).withColumn("ic", rnd("ic", 9))
    t = F.coalesce(F.avg("ic") / F.nullif(F.stddev_samp("ic") / F.sqrt(F.count("ic")), F.lit(0.0)), F.lit(0.0))
    one = coefs.join(ics.groupBy("variant", "factor").agg(F.avg("ic").alias("mean_ic"), t.alias("ic_t")), ["variant", "factor"])
    side = lambda v: {f"{v}_{c}": F.max(F.when(F.col("variant") == v, F.col(c))) for c in ("mean", "positive", "nw_t", "mean_ic", "ic_t")}
    digits = {"mean": 7, "positive": 4, "nw_t": 3, "mean_ic": 6, "ic_t": 4}
    both = one.groupBy("factor").agg(*[v.alias(k) for k, v in (side("raw") | side("neutral")).items()]).dropna()
    shown = [rnd(f"{v}_{c}", d).alias(f"{v}_{c}") for v in ("raw", "neutral") for c, d in digits.items()]
    return both.select("factor", *shown, (F.signum("raw_mean") == F.signum("neutral_mean")).alias("sign_holds"), rnd(F.abs("neutral_mean_ic") - F.abs("raw_mean_ic"), 6).alias("ic_gain"))


@query("a18_newey_west", with_(*MONTHLY_CTES, LONG) + _RANKS.format(by="factor, month", src="long", least=5) + """, d AS (SELECT factor, month, ic - avg(ic) OVER (PARTITION BY factor) AS e, avg(ic) OVER (PARTITION BY factor) AS m FROM ics WHERE ic IS NOT NULL),
l AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4 FROM d WINDOW w AS (PARTITION BY factor ORDER BY month)),
v AS (SELECT factor, count(*) AS n, max(m) AS m, sum(e * e) + 2 * (0.8 * coalesce(sum(e * e1), 0) + 0.6 * coalesce(sum(e * e2), 0) + 0.4 * coalesce(sum(e * e3), 0) + 0.2 * coalesce(sum(e * e4), 0)) AS s FROM l GROUP BY factor)
SELECT factor, n, round(m, 6) AS mean_ic, round(m / nullif(sqrt(greatest(s, 0)) / n, 0), 5) AS nw_t FROM v""")
def a18(spark, sf_dir):
    """T of a mean with a Bartlett kernel of four lags, by lags over one window a series."""
    ics = rank_ic(long_monthly(spark, sf_dir), "value", "fwd", ["factor", "month"]).filter("ic is not null")
    return models.newey_west(ics, "factor", "month", "ic").select("factor", "n", F.round("mean", 6).alias("mean_ic"), F.round("nw_t", 5).alias("nw_t"))


@query("a13_factor_coverage", with_(*MONTHLY_CTES, LONG) + ", all_rows AS (SELECT count(*) AS total FROM monthly) SELECT factor, count(*) AS n, round(100.0 * count(*) / max(total), 4) AS pct, " + ", ".join(f"{q.rnd(e, 5)} AS {n}" for e, n in [("avg(value)", "mean"), ("median(value)", "median"), *[(f"quantile_cont(value, {x}::DOUBLE)", f"q{int(x * 10)}") for x in (0.2, 0.4, 0.6, 0.8)]]) + " FROM long, all_rows GROUP BY factor")
def a13(spark, sf_dir):
    """Coverage and quantiles of each factor."""
    m = monthly(spark, sf_dir).unpivot(["month", "code"], FACTORS3, "factor", "value").withColumn("value", rnd("value", 8))
    agg = m.groupBy("factor").agg(F.count("value").alias("n"), F.count("*").alias("total"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.percentile("value", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    return agg.select("factor", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"), rnd("mean", 5).alias("mean"), rnd("median", 5).alias("median"), *[rnd(F.col("e")[i], 5).alias(f"q{2 * i + 2}") for i in range(4)])


@query("t4_safe_correlation", with_(*MONTHLY_CTES) + " SELECT month, round(covar_pop(mom_1, fwd) / nullif(stddev_pop(mom_1) * stddev_pop(fwd), 0), 6) AS corr FROM monthly WHERE mom_1 IS NOT NULL AND fwd IS NOT NULL GROUP BY month")
def t4(spark, sf_dir):
    """Pearson correlation that is null on a constant side."""
    return monthly(spark, sf_dir).filter("mom_1 is not null and fwd is not null").groupBy("month").agg(F.round(safe_corr("mom_1", "fwd"), 6).alias("corr"))




@query("a10_horizon_ic", with_(*MONTHLY_CTES, LONG) + """, h AS (SELECT unnest([21, 42, 63]) AS h), calx AS (SELECT date, row_number() OVER (ORDER BY date) AS cal_idx FROM (SELECT DISTINCT date FROM bars)),
keyed AS (SELECT b.code, c.cal_idx, b.close, b.date FROM bars b JOIN calx c USING (date)), lasts AS (SELECT date_trunc('month', date) AS month, max(date) AS date FROM calx GROUP BY 1),
far AS (SELECT a.code, CAST(l.month AS DATE) AS month, CAST(h.h AS BIGINT) AS horizon, """ + q.rnd("k.close / nullif(a.close, 0) - 1") + """ AS ret FROM keyed a JOIN lasts l USING (date) CROSS JOIN h JOIN keyed k ON k.code = a.code AND k.cal_idx = a.cal_idx + h.h),
decay AS (SELECT l.factor, l.month, l.code, l.value, far.horizon, far.ret AS fwd FROM long l JOIN far ON far.code = l.code AND far.month = CAST(l.month AS DATE))"""
       + _RANKS.format(by="factor, horizon, month", src="decay", least=5) + f" SELECT factor, horizon, {_STATS} FROM (SELECT factor, horizon, {q.rnd('ic', 9)} AS ic FROM ics WHERE ic IS NOT NULL) GROUP BY factor, horizon")
def a10(spark, sf_dir):
    """How the rank correlation of each factor decays over 21, 42 and 63 days."""
    b = written(p.bars(spark, sf_dir), "bars")  # the calendar, both sides of the returns and the factors read them
    far = m4(spark, sf_dir, b).select("code", F.trunc("date", "MM").alias("month"), "horizon", F.col("fwd").alias("ret"))
    rows = long_monthly(spark, sf_dir, b).select("factor", "code", F.to_date("month").alias("month"), "value").join(far, ["code", "month"])
    ics = rank_ic(rows, "value", "ret", ["factor", "horizon", "month"], tasks=p.tasks(spark, sf_dir)).filter("ic is not null")
    return ic_stats(ics.withColumn("ic", rnd("ic", 9)), ["factor", "horizon"])  # no sign from rounding errors


@query("a9_regime_ic", with_(*MONTHLY_CTES, LONG, INDEX, REGIME) + _RANKS.format(by="factor, month", src="long", least=5) + f""", label AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, max_by(regime, date) AS regime FROM regimes GROUP BY 1),
r AS (SELECT factor, ic, coalesce(regime, 'none') AS regime FROM ics LEFT JOIN label ON label.month = CAST(ics.month AS DATE) WHERE ic IS NOT NULL) SELECT factor, regime, {_STATS} FROM r GROUP BY factor, regime""")
def a9(spark, sf_dir):
    """Rank correlations by the index's regime at the end of the month."""
    index = p.index_series(spark, sf_dir).withColumn("code", F.lit("index"))
    label = regimes(index).groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by("regime", "date").alias("regime"))
    ics = rank_ic(long_monthly(spark, sf_dir), "value", "fwd", ["factor", "month"]).filter("ic is not null").withColumn("month", F.to_date("month"))
    return ic_stats(ics.join(F.broadcast(label), "month", "left").fillna("none", ["regime"]), ["factor", "regime"])
