"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from helixframe.plans import catalog, catalog_files, catalog_models, catalog_scale, catalog_tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_modules_register_in_one_place():
    assert catalog_files.query is catalog_scale.query is catalog_tables.query is catalog_models.query is catalog.query and "ridge_line" in catalog.QUERIES and "scorecard" in catalog.QUERIES


def plain(v):
    return repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in df.columns) for r in rows) == want


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(entry.SMOKE_DIR)
