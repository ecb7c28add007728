"""Merges write touched partitions alone; a refreshed store equals a full run."""

import datetime as dt
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.factors import PRICE_FACTORS, compute_factors
from tessera.operators.refresh import refresh, stored
from tessera.sources import merge as mg
from tessera.sources import panel as p

SCHEMA = "id int, day string, v double, version int"


def files(path):
    return {str(f.relative_to(path)): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def rows(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("id", "day", "v", "version").collect()), key=str)


@pytest.mark.parametrize("listed", [10_000, 0])
def test_merge(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(mg, "MAX_LISTED", listed)
    path, frame = str(tmp_path / "t"), lambda *x: spark.createDataFrame(list(x), SCHEMA)
    up = lambda *x, **k: mg.merge(spark, path, frame(*x), ["id", "day"], "day", **k)
    assert up((1, "a", 1.0, 1), (2, "a", 2.0, 1), (1, "b", 3.0, 1), (1, "b", 4.0, 1), (5, "c", None, None)) == 3
    assert rows(spark, path) == [(1, "a", 1.0, 1), (1, "b", 4.0, 1), (2, "a", 2.0, 1), (5, "c", None, None)]
    before = files(path)
    assert up((2, "a", 9.0, 0), (3, "a", 7.0, 1), (1, "d", 1.0, 1)) == 2
    after = files(path)
    assert {f for f in before if f.startswith(("day=b", "day=c"))} == {f for f in after if f.startswith(("day=b", "day=c"))}
    assert all(before[f] == after[f] for f in before if f.startswith(("day=b", "day=c"))) and not any(f in after for f in before if f.startswith("day=a"))
    assert (2, "a", 9.0, 0) in rows(spark, path) and (1, "a", 1.0, 1) in rows(spark, path)
    up((1, "a", 5.0, 0), (3, "a", 8.0, 1), (5, "c", 6.0, 0), order="version")
    assert [r for r in rows(spark, path) if r[0] in (1, 3, 5) and r[1] in "ac"] == [(1, "a", 1.0, 1), (3, "a", 8.0, 1), (5, "c", 6.0, 0)]
    up((1, "a", 0.0, 9), (4, "a", 4.0, 1), keep_old=True)
    assert (1, "a", 1.0, 1) in rows(spark, path) and (4, "a", 4.0, 1) in rows(spark, path)
    held = files(path)
    assert mg.merge(spark, path, frame().limit(0), ["id", "day"], "day") == 0 and files(path) == held
    assert up((7, None, 1.0, 1)) == 1 and up((7, None, 2.0, 1)) == 1
    assert spark.read.parquet(path).filter("day is null").select("id", "v").collect() == [(7, 2.0)]


def test_refresh_equals_a_full_run(spark, tmp_path):
    """A day at a time after a first year: values as of a full run, old months untouched, a repeated day changes nothing."""
    rng = np.random.default_rng(12)
    days = [dt.date(2022, 1, 3) + dt.timedelta(i) for i in range(520)]
    price = {c: 10 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days)))) for c in ("600001", "300001")}
    made = [(c, d, float(x), float(x), float(x) * 1.01, float(x) * 0.99, 1e6, 1e7 + i, 1.0) for c, xs in price.items() for i, (d, x) in enumerate(zip(days, xs, strict=True)) if c == "600001" or i > 30]
    bars = spark.createDataFrame(made, "code string, date date, open double, close double, high double, low double, volume double, amount double, turnover double")
    store, cut = str(tmp_path / "store"), days[500]
    assert stored(spark, store, "factors") is None
    assert refresh(spark, store, bars.filter(F.col("date") < F.lit(cut)), PRICE_FACTORS) == {"bars": 17, "factors": 17}
    before = files(store)
    for i in range(500, 503):
        assert refresh(spark, store, bars.filter(F.col("date") == F.lit(days[i])), PRICE_FACTORS) == {"bars": 1, "factors": 1}
    after, month = files(store), f"month={days[500]:%Y-%m}"
    assert {f for f in before if before[f] == after.get(f)} == {f for f in before if month not in f}
    assert refresh(spark, store, bars.filter(F.col("date") == F.lit(days[501])), PRICE_FACTORS)["factors"] == 1
    want = compute_factors(p.normalize(bars.filter(F.col("date") <= F.lit(days[502]))), PRICE_FACTORS, ["close"])
    key = lambda df: {(r.code, r.date): [None if r[f] is None else pytest.approx(r[f], rel=1e-9, abs=1e-12) for f in PRICE_FACTORS] for r in df.collect()}
    got = {(r.code, r.date): [r[f] for f in PRICE_FACTORS] for r in stored(spark, store, "factors").collect()}
    assert got == key(want)
    assert refresh(spark, store, bars.limit(0), PRICE_FACTORS) == {"bars": 0, "factors": 0}


def test_a_refresh_computes_its_bars_once(spark, tmp_path):
    """One pass over new bars both merges them and tells their first day, whether the store is new or not; bars without code or date count nowhere."""
    schema = "code string, date date, open double, close double, high double, low double, volume double, amount double, turnover double"
    day = lambda i: dt.date(2023, 1, 30) + dt.timedelta(i)
    bar = lambda code, date, x: (code, date, x, x, x, x, x, x, x)
    source = spark.createDataFrame([*[bar(c, day(i), 10.0 + i) for c in ("600001", "300001") for i in range(6)], bar(None, day(-9), 1.0), bar("600001", None, 1.0)], schema)
    store, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for part, made in ((F.col("date").isNull() | (F.col("date") < F.lit(day(3))), {"bars": 2, "factors": 2}), (F.col("date") >= F.lit(day(3)), {"bars": 1, "factors": 1}), (F.lit(False), {"bars": 0, "factors": 0})):
        before = seen.value
        bars = source.filter(part)
        assert refresh(spark, store, bars.mapInArrow(counted, schema), PRICE_FACTORS) == made
        assert seen.value - before == bars.count()
    got = {(r.code, r.date): r.close for r in stored(spark, store, "factors").collect()}
    assert got == {(c, day(i)): 10.0 + i for c in ("600001", "300001") for i in range(6)}


def test_partitions_are_counted_by_their_folders(spark, tmp_path, monkeypatch):
    """A first merge counts them, a null and an escaped name too, without a scan of the table."""
    path, made = str(tmp_path / "t"), [(1, "a/b", 1.0, 1), (2, "a/b", 1.0, 1), (1, None, 1.0, 1), (1, "c=d", 1.0, 1)]
    frame = spark.createDataFrame(made, SCHEMA)
    monkeypatch.setattr(type(frame), "count", lambda self: pytest.fail("a scan"))
    assert mg.merge(spark, path, frame, ["id", "day"], "day") == 3
    assert rows(spark, path) == sorted(made, key=str)
