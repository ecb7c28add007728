import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    kind = type(x).__name__
    if kind.startswith("bool"):
        return bool(x)
    if "int" in kind:
        return int(x)
    if "float" in kind:
        return float(x)
    return str(x).removesuffix(" 00:00:00")


def same(v, w):
    return v == w or (isinstance(v, (int, float)) and isinstance(w, (int, float)) and abs(v - w) <= 1e-6 * max(1, abs(v)))


def same_rows(frame, expected):
    """Column names and rows, in any order; doubles to 1e-6 of their size.

    Rows are paired by their exact columns; among rows that agree on those, each takes the first with near doubles.
    """
    assert sorted(frame.columns) == sorted(expected.columns)
    names = sorted(frame.columns)
    tables = [[[plain(v) for v in r] for r in x[names].itertuples(index=False, name=None)] for x in (frame, expected)]
    doubles = [any(isinstance(r[i], float) for t in tables for r in t) for i in range(len(names))]
    groups = ({}, {})
    for table, group in zip(tables, groups, strict=True):
        for r in table:
            exact = tuple("" if d else str(v) for v, d in zip(r, doubles, strict=True))
            group.setdefault(exact, []).append([v + 0.0 if d and v is not None else v for v, d in zip(r, doubles, strict=True)])
    assert groups[0].keys() == groups[1].keys()
    order = lambda values: [(v is None, v if isinstance(v, float) else 0.0) for v in values]
    for exact, left in groups[0].items():
        left, right = sorted(left, key=order), sorted(groups[1][exact], key=order)
        assert len(left) == len(right), exact
        for row in left:
            at = next((i for i, other in enumerate(right) if all(map(same, row, other))), None)
            assert at is not None, (row, right[:1])
            right.pop(at)
