"""What several corpus operators share: staged tables, safe columns, column moments."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_dir: list[str] = []
_staged: list[str] = []
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20
#: Bytes of texts that are Python objects at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster that would lose tables, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        path = _own_dir[0]
    return path.rstrip("/")


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage with a committed table, so a lost executor costs only its own tasks. The table stays until
    ``drop_staged``, as results may read it later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """The tables that ``stage`` has written and nothing has dropped."""
    return list(_staged)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that no result reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _staged.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches by bytes: 10,000 rows of long texts or lists are too much for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(column) -> "F.Column":
    return F.coalesce(column.cast("string"), F.lit(""))


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """Names for working columns that no column of ``df`` has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch, columns: list[int]):
    """``batch`` in slices with about SLICE_BYTES of these columns, one row at least: what Python makes of a slice is small."""
    size = sum(batch.column(i).nbytes for i in columns)
    step = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, size))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_text(df: DataFrame, text_col, outputs: dict[str, str], make, also: list[str] = ()) -> DataFrame:
    """``df`` with new columns that Python makes of a text column, slice by slice of Arrow batches.

    ``make()`` runs once a task and returns a function from a list of texts (null: empty) and one list for each
    column of ``also`` to one list for each entry of ``outputs`` (name: type). Columns of ``df`` with the
    outputs' names are replaced.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    named = {x.lower() for x in outputs}
    keep = [c for c in df.columns if c.lower() not in named]
    extra = free_names(df, [f"map_{i}" for i in range(1 + len(also))])
    plain = df.select(*keep, F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit("")).alias(extra[0]), *[F.col(c).alias(e) for c, e in zip(also, extra[1:], strict=True)])
    schema = df.select(*keep).schema
    for name, kind in outputs.items():
        schema = schema.add(name, kind)
    width, names, kinds, many = len(keep), [*keep, *outputs], [types[k] for k in outputs.values()], 1 + len(also)

    def run(batches):
        function = make()
        for batch in batches:
            for part in slices(batch, range(width, width + many)):
                new = function(*[part.column(width + i).to_pylist() for i in range(many)])
                yield pa.RecordBatch.from_arrays([part.column(j) for j in range(width)] + [pa.array(x, k) for x, k in zip(new, kinds, strict=True)], names)

    return plain.mapInArrow(run, schema)
