"""Every query with SQL against DuckDB on the smallest tables."""

from glob import glob
from math import isnan

import duckdb
import pytest

from sparkloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and isnan(value):
        return "null"
    if isinstance(value, bool) or not isinstance(value, (int, float)) and not hasattr(value, "as_tuple"):
        return str(value)
    return f"{float(value):.6g}"


def test_every_query_has_a_name_and_most_have_sql():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(ORACLE_SQL) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.columns and got.count() > 0
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in found.fetchall())
    have = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert have == want
