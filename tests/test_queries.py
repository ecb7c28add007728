"""Every registered query of the panel library against its SQL twin."""

import pytest

from tessera import registry, suite
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        same_rows(frame, duck.execute(registry.ORACLE[name]).fetchdf())


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert suite.FLAGSHIP in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["month", "rank", "code", "mom_1"]
