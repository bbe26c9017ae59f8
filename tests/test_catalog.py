"""Each query against its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import catalog

PATH = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{PATH}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return getattr(v, "asDict", lambda: v)() if not isinstance(v, dict) else tuple(sorted(v.items()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, PATH)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_page_of_slices_reads_its_tables_few_times(spark):
    """Pairs, both sides and slices are kept, not worked out again wherever the page asks for them."""
    plan = catalog.QUERIES["page_slices"](spark, PATH)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() < 60
