"""From the driver tables to long panels: bars, calendars, index, trades, ticks; and the sinks."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "close", "high", "low", "volume", "amount", "pct_chg", "turnover")])
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code6(x: Column) -> Column:
    """Codes are text of six digits, never numbers."""
    return F.lpad(x.cast("string"), 6, "0")


def plain_code(symbol: Column) -> Column:
    """A symbol without blanks and without the mark of its exchange ahead or after a point: the six digits."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(symbol)), "^(SH|SZ|BJ)", ""), r"\.[A-Z]+$", "")


def no_nan(x: Column) -> Column:
    """NaN and infinities are missing values."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ensure_columns(df: DataFrame, spec: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Columns by first present alias ({name: (type, [alias, ...])}), typed nulls where no alias is present."""
    out = []
    for name, (kind, aliases) in spec.items():
        present = [F.col(f"`{a}`").try_cast(kind) for a in [name, *aliases] if a in df.columns]
        out.append((F.coalesce(*present) if present else F.lit(None).cast(kind)).alias(name))
    return df.select(*out)


#: Rows that a task of windows by code holds, and fewer where a small table would leave cores idle.
ROWS_A_TASK, LEAST_ROWS = 200_000, 20_000


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """Tasks that grow with a table's rows (counted from the files' footers), so that what one of them holds does not."""
    rows = table(spark, sf_dir, name).count()
    return max(1, math.ceil(rows / ROWS_A_TASK), min(math.ceil(rows / LEAST_ROWS), spark.sparkContext.defaultParallelism))


#: Fixed value: bytes of a file that one task reads at most, as dealing rows over more than 200 tasks holds all that were read.
SPLIT_BYTES = 32 << 20


def small_splits(spark: SparkSession) -> None:
    """Sets ``spark.sql.files.maxPartitionBytes`` of the session to SPLIT_BYTES, if it is not less already."""
    size, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    if int(size) * 1024 ** " kmgtp".index(unit or " ") > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each code, one shuffle: code = supplier, date = ship day, price = extended price / quantity.

    Rows are dealt by code over tasks that grow with the table and sorted there, so windows by code over the bars need neither a shuffle nor a sort of their own.
    """
    small_splits(spark)
    rows = table(spark, sf_dir, "lineitem").select(code6(F.col("l_suppkey")).alias("code"), F.to_date("l_shipdate").alias("date"), *_ORDER)
    priced = rows.repartition(tasks(spark, sf_dir), "code").select(
        "code", "date", (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("price"), "l_quantity", "l_extendedprice", F.struct(*_ORDER).alias("k"))
    return priced.groupBy("code", "date").agg(
        F.min_by("price", "k").alias("open"), F.max_by("price", "k").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 4).alias("amount"))


def last_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code`` and ``price``, the close of its last bar, from the rows themselves: each task keeps one row a code before the shuffle."""
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate is not null").select(code6(F.col("l_suppkey")).alias("code"), price.alias("price"), F.struct(F.to_date("l_shipdate").alias("date"), *_ORDER).alias("at"))
    return rows.groupBy("code").agg(F.max_by("price", "at").alias("price"))


def normalize(df: DataFrame) -> DataFrame:
    """Numbers by safe casts, NaN as null, ``pct_chg`` (percent) from closes where it is missing, rows with a date and code."""
    w = Window.partitionBy("code").orderBy("date")
    typed = ensure_columns(df, {f.name: (f.dataType.simpleString(), []) for f in BAR_SCHEMA.fields})
    for f in BAR_SCHEMA.fields[2:]:
        typed = typed.withColumn(f.name, no_nan(F.col(f.name)))
    change = (F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1) * 100
    return typed.filter("date is not null and code is not null").withColumn("pct_chg", F.coalesce("pct_chg", change))


def calendar(panel: DataFrame) -> DataFrame:
    """Dates with a close, numbered from 1. The one-task window runs over distinct dates alone."""
    dates = panel.filter("close is not null").select("date").distinct()
    return dates.withColumn("cal_idx", F.row_number().over(Window.orderBy("date")).cast("long"))


def month_ends(cal: DataFrame) -> DataFrame:
    return cal.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"), F.max("cal_idx").alias("cal_idx"))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index: the sum of order totals of each day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys and sells (return flag R) of each code with a total order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        code6(F.col("l_suppkey")).alias("code"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("direction"),
        (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("price"), F.col("l_quantity").alias("volume"), *_ORDER)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks; the time zone-free stamp is cast, as watermarks ask for."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("code"), "event_type", F.col("value").alias("price"))


#: The bar sizes in minutes with the most bars a code is given.
BAR_TAILS = {5: 240, 15: 160, 30: 120, 60: 120}


def minute_bars(ticks: DataFrame, minutes: list[int]) -> DataFrame:
    """Bars of each code, size in ``minutes`` and ``start``; ticks of one time by ``event_id``. Ticks without code, time or price count nowhere.

    Ticks shuffle once, to bars of the sizes' common divisor; the larger bars are made from these.
    """
    base = math.gcd(*minutes)
    start = lambda x, m: F.timestamp_seconds(F.floor(F.unix_seconds(x) / (60 * m)) * (60 * m))
    good = ticks.filter("code is not null and ts is not null and price is not null")
    order = F.struct("ts", "event_id")
    small = good.groupBy("code", start(F.col("ts"), base).alias("at")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
    sized = small.select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), start(F.col("at"), m).alias("from")) for m in minutes])).alias("bar"))
    return sized.groupBy("code", F.col("bar.minutes").alias("minutes"), F.col("bar.from").alias("start")).agg(
        F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("volume").alias("volume"))


def tail(df: DataFrame, by: list[str], on: str, n: int | Column, bound: int | None = None) -> DataFrame:
    """The last ``n`` rows of each group by ``on``. Where ``n`` is a number, or a column with the ``bound``, each task keeps no more before the shuffle."""
    kept = F.col("_rn") <= n if bound is None else (F.col("_rn") <= bound) & (F.col("_rn") <= n)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(on)))).filter(kept).drop("_rn")


#: Fixed value: the second source gives market values in this unit.
VALUE_UNIT = 1e8
SPOT = {"code": ("string", []), "name": ("string", []), "close": ("double", ["price"]), "total_mv": ("double", ["market_value"]), "circ_mv": ("double", ["float_value"]), "pe": ("double", ["pe_dynamic"]), "pb": ("double", [])}
SPOT_SECOND = {"code": ("string", ["symbol"]), "name": ("string", []), "close": ("double", ["zxj"]), "total_mv": ("double", ["zsz"]), "circ_mv": ("double", ["ltsz"]), "pe": ("double", ["pe_ttm"])}
EARNINGS = {"code": ("string", ["symbol"]), "name": ("string", ["short_name"]), "roe": ("double", ["roe_weighted"]), "gross_margin": ("double", ["margin"]), "eps": ("double", []), "bps": ("double", []), "industry": ("string", [])}


def spot_snapshot(first: DataFrame, second: DataFrame) -> DataFrame:
    """Prices and ratios of all codes: rows of ``first``, and of ``second`` for codes that it lacks.

    The second source marks its symbols with the exchange, gives values in hundred millions and no ``pb`` (null). Text that is no number
    is null, rows without a code go, a code that is listed twice in one source keeps both rows.
    """
    one = ensure_columns(first, SPOT).withColumn("code", code6(F.col("code")))
    two = ensure_columns(second, SPOT_SECOND).withColumn("code", code6(plain_code(F.col("code"))))
    two = two.withColumns({c: F.col(c) * VALUE_UNIT for c in ("total_mv", "circ_mv")}).withColumn("pb", F.lit(None).cast("double"))
    return prefer(one.filter("code is not null"), two.filter("code is not null"), ["code"])


def earnings(raw: DataFrame) -> DataFrame:
    """The reports of one period: return on equity, margin, earnings and book value a share, industry."""
    return ensure_columns(raw, EARNINGS).withColumn("code", code6(F.col("code"))).filter("code is not null")


def parse_quote(raw: Column) -> Column:
    """A '~'-delimited quote: name, code, price, previous close, open, ... ; under 40 fields gives only ``error``."""
    f = F.split(raw, "~")
    num = lambda i: F.get(f, F.lit(i)).try_cast("double")
    ok = F.size(f) >= 40
    names = {"price": 3, "prev_close": 4, "open": 5, "volume": 6, "time": 30, "change": 31, "pct": 32, "high": 33, "low": 34, "amount": 37, "turnover": 38}
    fields = [F.when(ok, F.get(f, F.lit(1))).alias("name")] + [F.when(ok, F.get(f, F.lit(i)) if n == "time" else num(i)).alias(n) for n, i in names.items()]
    return F.struct(*fields, F.when(~ok, "short quote").alias("error"))


def universe(names: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Codes without special-treatment names; a sample takes the smallest seeded MD5s, the same in any engine (a sort with a limit, no full sort)."""
    kept = names.filter(~F.upper("name").contains("ST")).select(code6(F.col("code")).alias("code"))
    return kept if sample is None else kept.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "code")), "code").limit(sample)


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key (append-only upsert)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: list[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, ORC, CSV (with header) or JSON; Spark commits the files."""
    writer = df.write.mode(mode).partitionBy(*partition) if partition else df.write.mode(mode)
    {"parquet": writer.parquet, "orc": writer.orc, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[kind](path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return {"parquet": reader.parquet, "orc": reader.orc, "json": reader.json, "csv": lambda p: reader.option("header", True).csv(p)}[kind](path)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str, low, high, parts: int) -> DataFrame:
    """A ledger table over JDBC, read in ``parts`` ranges of ``column``."""
    return spark.read.jdbc(url, query, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def report_lines(df: DataFrame, title: str, rows: int = 100) -> str:
    """A small result as a Markdown table; the row limit is the report's."""
    names = df.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()])
