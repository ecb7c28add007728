"""Rank correlations of slices against pandas, thirds by size, thin and constant groups."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, joins
from tessera.plans import audits
from tessera.plans.factors import FINANCIALS, HELD
from tessera.plans.sql import BARS, CAL, with_
from tessera.registry import QUERIES
from tests.conftest import same_rows


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(7)
    rows = pd.DataFrame([(f, m, f"{c:06d}", c % 3) for f in "ab" for m in pd.date_range("2020-01-01", periods=6, freq="MS").date for c in range(40)], columns=["factor", "month", "code", "industry"])
    rows["value"] = rng.integers(0, 12, len(rows)).astype(float)  # many ties
    rows["ret"] = rng.integers(-5, 6, len(rows)) / 100 + rows.value / 200
    rows["cap"] = rng.integers(1, 9, len(rows)).astype(float)
    rows.loc[rows.sample(30, random_state=1).index, "value"] = np.nan
    rows.loc[rows.sample(30, random_state=2).index, "ret"] = np.nan
    rows.loc[(rows.factor == "a") & (rows.month == rows.month.min()) & (rows.industry == 0), "value"] = 1.0
    return rows


def expected(rows, least):
    out = []
    for keys, g in rows.dropna(subset=["value", "ret"]).groupby(["factor", "month", "part"]):
        if len(g) >= least and g.value.nunique() > 1 and g.ret.nunique() > 1:
            out.append((keys[0], keys[1], g.value.rank().corr(g.ret.rank())))
    ics = pd.DataFrame(out, columns=["factor", "month", "ic"]).groupby(["factor", "month"]).ic.mean()
    return {f: (len(x), round(x.mean(), 5), round(x.median(), 5), round(x.mean() / (x.std() / np.sqrt(len(x))), 4)) for f, x in ics.groupby("factor")}


def frame(spark, rows):
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "factor string, month date, code string, industry long, value double, ret double, cap double")
    return df


def test_sliced_ic(spark, made):
    late = F.col("month") >= F.lit("2020-03-01").cast("date")
    got = audit.sliced_ic(frame(spark, made), [
        audit.Slice("all", "all", "ret"), audit.Slice("half", F.when(late, "late"), "ret"),
        audit.Slice("industry", "within", "ret", F.col("industry").cast("string"), late, 10), audit.Slice("thin", "none", "ret", least=1000)]).collect()
    rows = {(r.section, r.slice, r.factor): (r.months, round(r.mean_ic, 5), round(r.median_ic, 5), round(r.t, 4)) for r in got}
    after = made[made.month >= pd.Timestamp("2020-03-01").date()]
    want = {}
    for section, name, part, source, least in (("all", "all", "", made, 5), ("half", "late", "", after, 5), ("industry", "within", None, after, 10)):
        for f, x in expected(source.assign(part=source.industry if part is None else part), least).items():
            want[section, name, f] = x
    assert rows.keys() == want.keys()
    for k, x in want.items():
        assert rows[k] == pytest.approx(x, abs=2e-4), k


def test_sliced_ic_of_nothing(spark, made):
    assert audit.sliced_ic(frame(spark, made.head(0)), [audit.Slice("all", "all", "ret")]).count() == 0
    flat = made.assign(value=1.0)
    assert audit.sliced_ic(frame(spark, flat), [audit.Slice("all", "all", "ret")]).count() == 0


def test_terciles(spark, made):
    some = frame(spark, made).withColumn("size", F.when(F.col("code") != "000003", F.col("cap")))
    out = audit.terciles(some, ["factor", "month"], "size", 39).toPandas()
    assert len(out) == len(made) and out[out.code == "000003"].tercile.isna().all()
    for _, g in out[out.code != "000003"].groupby(["factor", "month"]):
        low, high = np.quantile(g.cap, [1 / 3, 2 / 3])
        assert (g.tercile == np.where(g.cap <= low, "small", np.where(g.cap <= high, "mid", "large"))).all()
    assert audit.terciles(some, ["factor", "month"], "size", 40).filter("tercile is not null").count() == 0


def test_slices_of_one_section_and_name_are_one(spark, made):
    """Slices that agree in section, name and least share their groups; rows without a month or factor are groups too."""
    late = F.col("month") >= F.lit("2020-03-01").cast("date")
    some = frame(spark, made).withColumns({"month": F.when(F.col("month") != F.lit("2020-06-01").cast("date"), F.col("month")), "factor": F.nullif("factor", F.lit("b"))})
    both = audit.sliced_ic(some, [audit.Slice("half", "all", "ret", when=F.coalesce(late, F.lit(False))), audit.Slice("half", "all", "ret", when=~F.coalesce(late, F.lit(False))), audit.Slice("half", "thin", "ret", least=1000)])
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, audit.sliced_ic(some, [audit.Slice("half", "all", "ret")]).collect()), key=str)
    assert {(r.factor, r.slice, r.months) for r in both.collect()} == {("a", "all", 6), (None, "all", 6)}


def test_audits_do_not_move_rows_for_small_sides(spark, made):
    """Edges and labels have a row for each month and go to all tasks; returns and industries are in the written months, so rows move for their ranks alone."""
    some = frame(spark, made).withColumn("month", F.when(F.col("month") != F.lit("2020-06-01").cast("date"), F.col("month")))
    out = audit.terciles(some, ["factor", "month"], "cap", 30)
    assert out.count() == len(made) and out.filter("month is null and tercile is not null").count() == 0
    joined = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in joined(out)
        plan = joined(QUERIES["m25_layered_audit"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning(code" not in plan and plan.count("REPARTITION_BY_NUM") == 1


def test_fundamentals_of_awkward_rows(spark, tmp_path):
    """values held across the end of a month on a calendar with gaps, bars without a close or a date, rows without a code; all rows equal SQL's."""
    rng = np.random.default_rng(3)
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(int(x)) for x in sorted(rng.choice(420, 70, replace=False))]
    some = lambda values, share: [None if rng.random() < share else v for v in values]
    whole = lambda low, high, n: rng.integers(low, high, n).tolist()
    on = lambda n: some([days[i] for i in whole(0, len(days), n)], 0.04)
    items = list(zip(range(260), some(whole(1, 8, 260), 0.04), some(map(float, whole(1, 9, 260)), 0.2), map(float, whole(100, 9000, 260)), on(260), strict=True))
    orders = list(zip(range(120), whole(1, 30, 120), map(float, whole(100, 999, 120)), on(120), strict=True))
    con = duckdb.connect()
    for name, rows, schema in (("lineitem", [(k, 1, code, 1, *rest) for k, code, *rest in items], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"),
                               ("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"), ("supplier", [(k,) for k in range(7)], "s_suppkey long")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(with_(BARS, CAL, HELD, FINANCIALS, audits._FUNDAMENTALS) + "SELECT * FROM fundamentals").fetchdf()
    assert want.value_bp.isna().sum() > 5 and want.quality_roe.notna().sum() > 5
    same_rows(audits.fundamentals(spark, str(tmp_path)).toPandas(), want)


def test_asof_by_key(spark):
    """As ``asof_backward``: rows ahead of the first match, of other keys, and without key or time get nulls."""
    left = [("a", 1, 0), ("a", 3, 1), ("a", 5, 2), ("a", None, 3), ("b", 9, 4), (None, 9, 5)]
    right = [("a", 2, 1.0), ("a", 5, 2.0), ("c", 1, 3.0), (None, 1, 4.0), ("a", None, 5.0)]
    l, r = spark.createDataFrame(left, "code string, t int, n int"), spark.createDataFrame(right, "code string, t int, v double")
    got = {x.n: x.v for x in joins.asof_by_key(l, r, ["code"], "t", ["v"]).collect()}
    assert got == {0: None, 1: 1.0, 2: 2.0, 3: None, 4: None, 5: None}
    assert got == {x.n: x.v for x in joins.asof_backward(l, r.filter("t is not null"), ["code"], "t", ["v"]).collect()}
