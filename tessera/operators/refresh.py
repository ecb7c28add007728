"""Incremental factor tables: new bars are merged in, and factors are made again for the days that they can change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.factors import compute_factors
from tessera.sources.merge import exists, merge
from tessera.sources.panel import normalize

#: Calendar days of bars read before the first new day: the longest factor looks 273 rows back, and a code may rest for a while.
LOOKBACK_DAYS = 800


def refresh(spark: SparkSession, store: str, bars: DataFrame, names: list[str], lookback_days: int = LOOKBACK_DAYS) -> dict[str, int]:
    """Merge new ``bars`` (code, date, prices, turnover) into ``store``/bars and bring ``store``/factors up to date; partitions written again of each.

    Both tables are partitioned by month. Factors from the first new day on are made again from the bars of ``lookback_days`` before it
    on; older months are neither read for the result nor written. A repeated run changes no value. Bars without a code or date are left out. A first run makes both tables.
    ``lookback_days`` must span the longest factor's rows of every code, or the first values after it are null.
    """
    month = F.trunc("date", "MM").cast("string").alias("month")
    seen = Observation()  # the first new day is told by the pass that merges the bars
    new = bars.filter("code is not null and date is not null").select("*", month).observe(seen, F.min("date").alias("first"))
    written = {"bars": merge(spark, f"{store}/bars", new, ["code", "date", "month"], "month")}
    if not written["bars"]:  # no new bars: nothing is seen
        return written | {"factors": 0}
    first = seen.get["first"]
    table = spark.read.parquet(f"{store}/bars")
    # the filter on months prunes partitions, the one on dates the rows of the first
    since = F.date_sub(F.lit(first), lookback_days)
    recent = table.filter((F.col("month") >= F.trunc(since, "MM").cast("string")) & (F.col("date") >= since)).drop("month")
    made = compute_factors(normalize(recent), names, ["close"]).filter(F.col("date") >= F.lit(first)).select("*", month)
    return written | {"factors": merge(spark, f"{store}/factors", made, ["code", "date", "month"], "month")}


def stored(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """A table of the store, or None where no run has made it."""
    return spark.read.parquet(f"{store}/{table}").drop("month") if exists(spark, f"{store}/{table}") else None
