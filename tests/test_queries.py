"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from docsluice import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df, cols):
    x = df[cols].astype(object)
    return x.where(x.notna(), None).astype(str).replace(r"\.0$", "", regex=True).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)  # no pairs of suppliers of one nation in the smallest tables, for one
        return
    want = duck.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert canonical(got, cols).equals(canonical(want, cols))
