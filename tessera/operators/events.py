"""Event study: market model over an estimation window, abnormal returns, tests and adjusted p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import normal_cdf


def running_moments(returns: DataFrame, market: DataFrame) -> DataFrame:
    """A row for each code and calendar day from its first return on: ``r`` (null without a return), ``m`` and running sums ``n, sr, sm, srm, smm``.

    The calendar is that of ``market`` (cal_idx, r). Any window's sums are then the difference of two rows, so no return is
    copied into the windows it belongs to. A day without a return repeats the sums of the day before.
    """
    by = Window.partitionBy("code").orderBy("cal_idx")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    x = returns.filter("r is not null").join(F.broadcast(market.select("cal_idx", F.col("r").alias("m"))), "cal_idx")
    r, m = F.col("r"), F.col("m")
    sums = {"n": F.count("r"), "sr": F.sum(r), "sm": F.sum(m), "srm": F.sum(r * m), "smm": F.sum(m * m)}
    last = market.agg(F.max("cal_idx").alias("_last"))
    x = x.withColumns({k: v.over(upto) for k, v in sums.items()}).withColumn("_next", F.lead("cal_idx").over(by))
    x = x.crossJoin(F.broadcast(last))  # one row
    x = x.withColumn("_day", F.explode(F.sequence("cal_idx", F.coalesce(F.col("_next") - 1, F.greatest("cal_idx", "_last")))))
    return x.select("code", F.col("_day").alias("cal_idx"), F.when(F.col("_day") == F.col("cal_idx"), r).alias("r"), F.when(F.col("_day") == F.col("cal_idx"), m).alias("m"), *sums)


def day_study(days: DataFrame, returns: DataFrame, market: DataFrame, est: tuple[int, int] = (-120, -36), win: tuple[int, int] = (-5, 20), least_obs: int = 30, least_codes: int = 50, per_day: int | None = None) -> DataFrame:
    """Mean abnormal return around each event day: ``t0_idx``, ``rel_day``, ``aar``, ``codes``.

    The model depends on an event's day alone, so it runs once for each distinct ``t0_idx`` of ``days``. A code's running moments give
    the model of every day by the difference of two rows, and the days around are the rows around, so all of it is
    windows by code over one dealing of ``returns`` (code, cal_idx, r); only sums by (day, relative day) meet. A code counts with ``least_obs`` days
    to estimate on and every day of the window (or ``per_day`` of them). ``market`` and ``days`` are bounded by the calendar and broadcast.
    """
    by = Window.partitionBy("code").orderBy("cal_idx")
    dense = running_moments(returns, market)
    whole = Window.partitionBy("code")

    def between(c: str, lo: int, hi: int) -> Column:
        """The sum of a moment over the days from ``lo`` to ``hi`` around a row; days before the first count nothing, those after the last neither."""
        end = F.lag(c, -hi).over(by) if hi <= 0 else F.coalesce(F.lead(c, hi).over(by), F.max(c).over(whole))
        begin = F.lag(c, 1 - lo).over(by) if lo <= 1 else F.lead(c, lo - 1).over(by)
        return F.coalesce(end, F.lit(0)) - F.coalesce(begin, F.lit(0))

    sums = {f"_{c}": between(c, *est) for c in ("n", "sr", "sm", "srm", "smm")}
    around = F.collect_list(F.when(F.col("r").isNotNull(), F.struct(F.col("cal_idx").alias("d"), "r", "m"))).over(by.rowsBetween(win[0], win[1]))  # nulls are left out
    placed = dense.withColumns(sums | {"_around": around}).withColumn("_days", F.size("_around"))  # the days with a return are those around
    fit = placed.join(F.broadcast(days.select(F.col("t0_idx").alias("cal_idx")).distinct()), "cal_idx").filter((F.col("_n") >= least_obs) & (F.col("_days") >= (per_day or win[1] - win[0] + 1)))
    n = F.nullif(F.col("_n"), F.lit(0)).cast("double")
    mr, mm = F.col("_sr") / n, F.col("_sm") / n
    var, cov = F.col("_smm") / n - mm * mm, F.col("_srm") / n - mr * mm
    beta = F.when(var > 1e-12, cov / F.nullif(var, F.lit(0.0))).otherwise(0.0)
    fit = fit.withColumn("beta", beta).withColumn("alpha", mr - F.col("beta") * mm)
    each = fit.select(F.col("cal_idx").alias("t0_idx"), "alpha", "beta", F.explode("_around").alias("x"))
    ar = F.col("x.r") - F.col("alpha") - F.col("beta") * F.col("x.m")
    out = each.groupBy("t0_idx", (F.col("x.d") - F.col("t0_idx")).alias("rel_day")).agg(F.avg(ar).alias("aar"), F.count("*").alias("codes"))
    return out.filter(F.col("codes") >= least_codes)


def event_study(events: DataFrame, study: DataFrame) -> DataFrame:
    """Rows of a ``day_study`` (or of its ``car_tests``) for each event (event_id, t0_idx); the study is the bounded side."""
    return events.join(F.broadcast(study), "t0_idx")


def car_tests(aar: DataFrame, windows: list[tuple[int, int]], direction: Column, key: str = "event_id") -> DataFrame:
    """``car``, ``t_ref`` (sum over the error of the mean), ``t_std`` and p by direction, for each ``key`` and window with all its days."""
    w = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in windows])).alias("w")
    x = aar.select("*", w).filter(F.col("rel_day").between(F.col("w.lo"), F.col("w.hi")))
    s = F.nullif(F.stddev_samp("aar"), F.lit(0.0))
    g = x.groupBy(key, "w").agg(F.sum("aar").alias("car"), F.count("*").alias("n"), F.coalesce(F.sum("aar") / (s / F.sqrt(F.count("*"))), F.lit(0.0)).alias("t_ref"), F.coalesce(F.sum("aar") / (s * F.sqrt(F.count("*"))), F.lit(0.0)).alias("t_std"))
    g = g.filter(F.col("n") == F.col("w.hi") - F.col("w.lo") + 1)
    cdf = normal_cdf("t_ref")
    p = F.when(direction == "negative", cdf).when(direction == "mixed", 2 * (1 - normal_cdf(F.abs("t_ref")))).otherwise(1 - cdf)
    return g.select(key, F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), "car", "t_ref", "t_std", p.alias("p"))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """``p_adj``: the least p * m / rank from this p upward, 1 at most."""
    up = Window.partitionBy(*by).orderBy(p, tie)
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy(*by)) / F.row_number().over(up))
    return x.withColumn("p_adj", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q")


def benjamini_hochberg_counted(df: DataFrame, by: list[str], p: str, tie: str, count: str) -> DataFrame:
    """``benjamini_hochberg`` of rows that each stand for ``count`` tests with the same p: ranks are running counts."""
    up = Window.partitionBy(*by).orderBy(p, tie).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_q", F.col(p) * F.sum(count).over(Window.partitionBy(*by)) / F.sum(count).over(up))
    return x.withColumn("p_adj", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q")


def decide(cars: DataFrame, by: str, least: int = 5, consistent: float = 0.6, alpha: float = 0.05) -> DataFrame:
    """Mean, median and deviation of cars by type, share in the expected (positive) direction, share significant, decision."""
    a = cars.groupBy(by).agg(F.count("*").alias("n_events"), F.avg("car").alias("mean_car"), F.median("car").alias("median_car"), F.coalesce(F.stddev_samp("car"), F.lit(0.0)).alias("std_car"),
                             F.avg((F.col("car") > 0).cast("double")).alias("consistency"), F.avg((F.col("p_adj") < alpha).cast("double")).alias("rejection"))
    d = F.when(F.col("n_events") < least, "too_few").when(F.col("consistency") < consistent, "reject").when(F.col("rejection") < 0.5, "reject").otherwise("accept")
    return a.withColumn("decision", d)
