"""Audits of factors: the rank correlations of many slices from one ranking pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import ic_stats, rank_ic, rnd


@dataclass(frozen=True)
class Slice:
    """Rows under ``when`` count in ``section`` under the value of ``name`` with the return ``ret``; ``part`` ranks them apart and its parts are averaged."""

    section: str
    name: str | Column
    ret: str
    part: Column | None = None
    when: Column | None = None
    least: int = 5


def sliced_ic(rows: DataFrame, slices: list[Slice], value: str = "value", by: tuple[str, ...] = ("factor",), period: str = "month", tasks: int | None = None) -> DataFrame:
    """Number, mean, median, positive share and t of each slice's rank correlations by ``by``.

    Every row goes once into each slice that it belongs to, so all slices share one shuffle and one sort instead of a job each; section and ``least`` go by a number. Rows without value
    or return, and those whose slice has no name, count nowhere; parts with fewer than ``least`` pairs or a constant side give no correlation;
    slices without one have no row. Groups are ranked in ``tasks`` tasks, if given.
    """
    kinds = list(dict.fromkeys((s.section, s.least) for s in slices))
    cell = lambda s: F.struct(F.lit(kinds.index((s.section, s.least))).alias("_kind"), (F.lit(s.name) if isinstance(s.name, str) else s.name).alias("slice"), (F.lit("") if s.part is None else s.part).alias("part"), F.col(s.ret).alias("ret"))
    cells = [cell(s) if s.when is None else F.when(s.when, cell(s)) for s in slices]
    stacked = rows.filter(F.col(value).isNotNull()).select(*by, period, value, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*by, period, value, "c.*")
    stacked = stacked.filter("ret is not null and slice is not null and part is not null")
    ics = rank_ic(stacked, value, "ret", [*by, "_kind", "slice", "part", period], tasks=tasks)
    told = lambda i: F.get(F.array(*[F.lit(kind[i]) for kind in kinds]), F.col("_kind"))
    ics = ics.withColumns({"section": told(0), "least": told(1)}).filter("n >= least and ic is not null")
    months = ics.groupBy(*by, "section", "slice", period).agg(rnd(F.avg("ic"), 9).alias("ic"))  # no sign from rounding errors
    return ic_stats(months, [*by, "section", "slice"])


def terciles(rows: DataFrame, by: list[str], size: str, least: int = 90) -> DataFrame:
    """``tercile`` by ``size`` in each group with ``least`` sizes or more, else null; equal sizes share a third.

    Groups are cross-sections (factors by months), as few as the calendar is long: their edges, one row each, go to all tasks, so ``rows`` are not moved.
    """
    edges = rows.filter(F.col(size).isNotNull()).groupBy(*by).agg(F.percentile(size, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_e"), F.count("*").alias("_k")).filter(F.col("_k") >= least)
    third = F.when(F.col(size) <= F.col("_e")[0], "small").when(F.col(size) <= F.col("_e")[1], "mid").when(F.col(size).isNotNull() & F.col("_e").isNotNull(), "large")
    return rows.join(F.broadcast(edges), by, "left").withColumn("tercile", third).drop("_e", "_k")
