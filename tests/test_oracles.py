"""Every query of the registry against its DuckDB counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from marginalia.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows or got.columns
        return
    want = con.sql(sql)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda rs: sorted(([plain(v) for v in r] for r in rs), key=repr)
    at = [got.columns.index(c) for c in cols]
    a, b = order([r[i] for i in at] for r in rows), order(want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
