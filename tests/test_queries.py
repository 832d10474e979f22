"""Every query that has SQL, against DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
