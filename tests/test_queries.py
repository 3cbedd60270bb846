"""Every query of the registry against its SQL on the smallest driver tables."""

import decimal
import math
import os

import pytest

from planspark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value with its kind, so that NULL, NaN, text and numbers are never taken for one another."""
    if v is None:
        return ("null", "")
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        return ("number", "nan" if math.isnan(v) else str(int(v)) if v == v // 1 else repr(float(v)))
    if isinstance(v, (list, tuple)):
        return ("list", str([plain(x) for x in v]))
    return (type(v).__name__, str(v))


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(row[i]) for i in at) for row in want.fetchall())


def test_entry_point_imports_without_the_llm_folder():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
