"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from iqlake.plans import catalog, catalog_acquisition, catalog_cellular, catalog_corrections, catalog_measurements, catalog_reports, catalog_shapes  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def key(row):
    return [repr(x) for x in row]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = duck.sql(catalog.SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_has_sql_and_reads_a_table(spark):
    assert set(catalog.SQL) == set(catalog.QUERIES)
    for name, query in catalog.QUERIES.items():
        assert query(spark, DATA).inputFiles(), name


def test_entry_module_lists_queries():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
