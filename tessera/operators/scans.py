"""Running values over long ordered series: blocks are scanned side by side, then carried into each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of an exponential mean, and the weight below which older rows count for nothing.
BLOCK, LEAST_WEIGHT = 64, 1e-20


def _taken(kind: str, x):
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}[kind](x)


def running(df: DataFrame, by: list[str], bucket, order: list[str], outs: dict[str, tuple]) -> DataFrame:
    """``df`` with running values ``outs`` (name: kind, column) of each series up to and with the row.

    Kinds are ``sum``, ``count``, ``max``, ``min`` and ``last`` (the last that is not null); with ``_before`` at the end, the row itself is left
    out. ``bucket`` is any expression that never falls along ``order`` (a month, an id divided by a thousand): rows are scanned
    within their bucket, the buckets' own totals are scanned after one row each, and a bucket gets what came before it by a
    join. So a series of any length is spread over as many tasks as it has buckets. Where it is a column's name, rows stay dealt by that column and in order for what follows: totals, one row a bucket, meet them by hash. Rows that tie on ``order`` take any order
    among themselves. Nulls add nothing; a sum or an extreme over nulls alone is null, a count is 0. A null key or bucket is no
    series: such rows are scanned within their bucket alone.
    """
    named = isinstance(bucket, str)
    place = bucket if named else "_bucket"
    keys = [*by, place]
    placed = df if named else df.withColumn(place, bucket)
    inside = Window.partitionBy(*keys).orderBy(*order)
    ends = {False: inside.rowsBetween(Window.unboundedPreceding, 0), True: inside.rowsBetween(Window.unboundedPreceding, -1)}
    kinds = {name: (kind.removesuffix("_before"), kind.endswith("_before"), F.col(x) if isinstance(x, str) else x) for name, (kind, x) in outs.items()}
    rows = placed.withColumns({name: _taken(kind, x).over(ends[before]) for name, (kind, before, x) in kinds.items()})
    at = F.struct(*order)
    total = {name: F.max_by(x, F.when(x.isNotNull(), at)) if kind == "last" else _taken(kind, x) for name, (kind, _, x) in kinds.items()}
    totals = placed.groupBy(*keys).agg(*[t.alias(f"_t_{name}") for name, t in total.items()])
    earlier = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": "sum"}
    carried = totals.select(*keys, *[_taken(merge.get(kind, kind), F.col(f"_t_{name}")).over(earlier).alias(f"_c_{name}") for name, (kind, *_) in kinds.items()])
    both = rows.join(carried.hint("shuffle_hash") if named else carried, keys, "left")
    done = {}
    for name, (kind, *_) in kinds.items():
        own, past = F.col(name), F.col(f"_c_{name}")
        if kind == "count":
            done[name] = own + F.coalesce(past, F.lit(0))
        elif kind == "sum":
            done[name] = F.when(own.isNull(), past).when(past.isNull(), own).otherwise(own + past)
        else:
            done[name] = {"max": F.greatest, "min": F.least, "last": F.coalesce}[kind](own, past)
    return both.withColumns(done).drop(*([] if named else [place]), *[f"_c_{name}" for name in kinds])


def _faded(whole: float):
    return lambda total, block: total * whole + block


def with_ewm(df: DataFrame, outs: dict[str, tuple[str, float]], by: tuple[str, ...] = ("code",), order: tuple[str, ...] = ("date",)) -> DataFrame:
    """``df`` with exponentially weighted means ``outs`` (name: column, decay), weights adjusted to sum to one; nulls are skipped.

    A row's place among the values tells its block. Within a block the weighted sum is a plain running sum of values that were
    divided by the decay once a place; the sums of the blocks before, as many as have a weight of LEAST_WEIGHT at least, are combined once a
    block. So a row costs a few steps, however long its series is, and no shuffle beyond the one by ``by``.
    """
    decays = {name: float(d) for name, (_, d) in outs.items()}
    sizes = {x: min([max(1, min(BLOCK, int(250 / -math.log10(decays[n])))) for n, (c, _) in outs.items() if c == x]) for x in {c for c, _ in outs.values()}}
    along = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumns({f"_n_{c}": F.count(c).over(along) for c in sizes})
    x = x.withColumns({f"_b_{c}": F.floor(F.greatest(F.col(f"_n_{c}") - 1, F.lit(0)) / size).cast("long") for c, size in sizes.items()})
    place = {c: F.col(f"_n_{c}") - F.col(f"_b_{c}") * size for c, size in sizes.items()}
    block = {c: Window.partitionBy(*by, f"_b_{c}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for c in sizes}
    grown = {name: F.sum(F.col(c) * F.pow(F.lit(1 / decays[name]), place[c])).over(block[c]) for name, (c, _) in outs.items()}
    for c in sizes:  # column by column: the sums within blocks and those of the blocks before share one sort
        own = {name: decays[name] for name, (of, _) in outs.items() if of == c}
        x = x.withColumns({f"_p_{name}": grown[name] for name in own})
        x = x.withColumns({f"_p_{name}": F.col(f"_p_{name}") * F.pow(F.lit(d), place[c]) for name, d in own.items()})
        past = {}
        for name, d in own.items():
            reach = math.ceil(math.log(LEAST_WEIGHT) / math.log(d) / sizes[c]) + 1
            whole = F.when(F.col(c).isNotNull() & (place[c] == sizes[c]), F.col(f"_p_{name}"))
            past[f"_c_{name}"] = F.collect_list(whole).over(Window.partitionBy(*by).orderBy(f"_b_{c}").rangeBetween(-reach, -1))
        x = x.withColumns(past)
        x = x.withColumns({f"_c_{name}": F.aggregate(f"_c_{name}", F.lit(0.0), _faded(d ** sizes[c])) for name, d in own.items()})  # a number, so that no list is sorted along
    done = {}
    for name, (c, _) in outs.items():
        d = decays[name]
        total = F.coalesce(F.col(f"_p_{name}"), F.lit(0.0)) + F.col(f"_c_{name}") * F.pow(F.lit(d), place[c])
        done[name] = F.when(F.col(f"_n_{c}") > 0, total * (1 - d) / (1 - F.pow(F.lit(d), F.col(f"_n_{c}"))))
    return x.withColumns(done).drop(*[f"_{k}_{c}" for k in "nb" for c in sizes], *[f"_{k}_{name}" for k in "pc" for name in outs])


def drawdowns(df: DataFrame, by: list[str], bucket, order: list[str], value: str) -> DataFrame:
    """``df`` with ``peak`` and ``drawdown`` (value / peak - 1) of each series up to the row; the peak is carried from bucket to bucket."""
    up = running(df, by, bucket, order, {"peak": ("max", value)})
    return up.withColumn("drawdown", F.col(value) / F.nullif("peak", F.lit(0.0)) - 1)
