"""Column expressions over long panels (code, date, ...): rolling windows, ranks, clipping, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_code():
    """A code's rows by date. Windows are made when they are asked for: that needs a session, importing does not."""
    return Window.partitionBy("code").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, null where b is 0 or null: ANSI mode raises on a plain division by zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def roll(function, x, n: int, least: int | None = None, window=None) -> Column:
    """``function`` over the last ``n`` rows of a code, null with fewer than ``least`` (``n``) values."""
    last = (window or by_code()).rowsBetween(1 - n, 0)
    return F.when(F.count(col(x)).over(last) >= (n if least is None else least), function(col(x)).over(last))


def lag(x, k: int = 1, window=None) -> Column:
    return F.lag(col(x), k).over(window or by_code())


def pct_change(x, k: int = 1, window=None) -> Column:
    return div(x, lag(x, k, window)) - 1


def running_max(x, window=None) -> Column:
    return F.max(col(x)).over((window or by_code()).rowsBetween(Window.unboundedPreceding, 0))


def clip(x, low, high) -> Column:
    """Null stays null; least and greatest alone would return the bound."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, col(low) if isinstance(low, str) else F.lit(low) if not isinstance(low, Column) else low), high if isinstance(high, Column) else F.lit(high)))


def winsorize(x, low: float = 0.01, high: float = 0.99, window=None) -> Column:
    x = col(x)
    bounds = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(window or by_date())
    return F.when(x.isNotNull(), F.least(F.greatest(x, bounds[0]), bounds[1]))


def zscore(x, window=None) -> Column:
    """Population deviation with 1e-12 added."""
    x, window = col(x), window or by_date()
    return (x - F.avg(x).over(window)) / (F.stddev_pop(x).over(window) + 1e-12)


def double_rank(x, *by: str) -> Column:
    """Twice the mean rank of ties within groups, a whole number: the first place of the ties and the last. Both are told by one sort."""
    up = Window.partitionBy(*by).orderBy(col(x))
    return F.rank().over(up).cast("long") + F.count("*").over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))


def average_rank(x, *by: str) -> Column:
    """Mean rank of ties within groups; null stays null when the frame has no nulls in ``x``."""
    return double_rank(x, *by).cast("double") / 2.0


def safe_corr(x, y) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    x, y = col(x), col(y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def rank_ic(df: DataFrame, factor: str, ret: str, by: list[str], least: int = 5, tasks: int | None = None) -> DataFrame:
    """Spearman correlation of ``factor`` and ``ret`` in each group with ``least`` pairs or more; groups are dealt over ``tasks``, if given.

    Twice an average rank is a whole number, and these have the mean n + 1: sums of their products are exact (below 2^53), so the correlation does not
    depend on the order of the rows, and one that is 0 has no sign.
    """
    pairs = df.filter(F.col(factor).isNotNull() & F.col(ret).isNotNull()).select(*by, factor, ret)
    pairs = pairs if tasks is None else pairs.repartition(tasks, *by)
    ranked = pairs.select(*by, double_rank(factor, *by).cast("double").alias("_x"), double_rank(ret, *by).cast("double").alias("_y"))
    x, y, n = F.col("_x"), F.col("_y"), F.col("n").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"), F.count("*").alias("n")).filter(F.col("n") >= least)
    centred = {c: F.col(c) - n * (n + 1) * (n + 1) for c in ("_xy", "_xx", "_yy")}
    return sums.select(*by, (centred["_xy"] / F.nullif(F.sqrt(centred["_xx"]) * F.sqrt(centred["_yy"]), F.lit(0.0))).alias("ic"), "n")


def ic_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean, median, share above zero and t of ``ic``; t is 0 for a constant series."""
    t = F.avg("ic") / F.nullif(F.stddev_samp("ic") / F.sqrt(F.count("ic")), F.lit(0.0))
    return df.filter("ic is not null").groupBy(*by).agg(
        F.count("*").alias("months"),
        F.round(F.avg("ic"), 6).alias("mean_ic"),
        F.round(F.median("ic"), 6).alias("median_ic"),
        F.round(F.avg((F.col("ic") > 0).cast("double")), 6).alias("positive"),
        F.round(F.coalesce(t, F.lit(0.0)), 5).alias("t"),
    )


def ln(x) -> Column:
    """Natural logarithm with an infinity at 0 and NaN below, as SQL has it; ``F.ln`` gives null for both. Null stays null."""
    x = col(x)
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def normal_cdf(x) -> Column:
    """Standard normal distribution from a rational approximation of erf with an error below 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    x = col(x)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def rnd(x, digits: int = 6) -> Column:
    """Half up on the binary value, as plain floor arithmetic: the same in any engine, unlike ``round`` at ties.

    ``floor`` gives a long; values that a long cannot hold have no digits behind the point and stay as they are.
    """
    scale = float(10**digits)
    y = col(x) * scale + 0.5
    return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y) / scale
