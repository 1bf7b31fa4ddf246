"""Every query of the catalogue that has SQL gives the SQL's rows; the others give rows."""

import math

import duckdb
import pytest

from tracegrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def same(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == columns
    want = sorted(repr(tuple(same(r[found.columns.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(same(v) for v in r)) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["q37_pca_variance", "q43_procrustes", "q55_flow"])
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
