"""Upserts into partitioned tables: only partitions that an update touches are read and written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.staging import written

#: Touched partitions up to which their values become a filter of the scan; beyond, a join finds them.
MAX_LISTED = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``, in whatever store Spark reads."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _partitions(spark: SparkSession, path: str) -> int:
    """Partitions that hold rows, told by the folders of the table's files: no file is opened."""
    return len({f.rsplit("/", 2)[-2] for f in spark.read.parquet(path).inputFiles()})


def _one_a_key(rows: DataFrame, keys: list[str], first: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*first))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def _overwrite(rows: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Write the partitions of ``rows`` again. One task a partition value would make a hot one: rows are dealt by value and a bounded salt."""
    dealt = rows.repartition(F.col(partition), F.pmod(F.xxhash64(*keys), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def merge(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], partition: str, order: str | None = None, keep_old: bool = False) -> int:
    """Merge ``updates`` into the Parquet table at ``path``, partitioned by ``partition``; the number of partitions written again.

    A key has one row. With ``order`` the row of the greatest value wins (nulls least), an update before a row that ties with it; without, an update wins, and of
    updates with one key the greatest row does. ``keep_old`` inserts absent keys alone. ``partition`` is one of the keys or follows from them: a key never
    changes its partition. The result is written in the shared folder first; then Spark's dynamic overwrite swaps the touched
    partitions when its job commits, so a failed run leaves the old ones, and the files of all others stay as they are. A first
    update makes the table, without that copy. No updates write nothing.
    """
    columns = updates.columns
    rest = [c for c in columns if c not in keys]
    order_by = ([F.col(order).desc_nulls_last()] if order else []) + [F.col(c).desc_nulls_last() for c in rest]
    one = _one_a_key(updates, keys, order_by)
    if not exists(spark, path):
        # nothing to merge with: written where it belongs at once
        _overwrite(one, path, keys, partition)
        return _partitions(spark, path) if exists(spark, path) else 0
    new = written(one, "updates")
    touched = new.select(partition).distinct()
    values = [r[0] for r in touched.limit(MAX_LISTED + 1).collect()]
    if not values:
        return 0
    table = spark.read.parquet(path)
    listed = len(values) <= MAX_LISTED
    if listed:
        some = F.col(partition).isin([v for v in values if v is not None])
        old = table.filter(some | F.col(partition).isNull() if None in values else some)
    else:
        old = table.join(touched.select(F.col(partition).alias("_p")), F.col(partition).eqNullSafe(F.col("_p")), "left_semi")
    both = old.select(*columns).withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    first = [F.col("_side").asc()] if keep_old else [*([F.col(order).desc_nulls_last()] if order else []), F.col("_side").desc()]
    _overwrite(written(_one_a_key(both, keys, first).drop("_side"), "merged"), path, keys, partition)
    return len(values) if listed else touched.count()
