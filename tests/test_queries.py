"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from prismata.plans import registry
from prismata.sources.fixtures import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_query_equals_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    cur = oracle.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_other_queries_run_and_repeat(spark, name):
    first = sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    assert first and first == sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
