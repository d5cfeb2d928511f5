"""Every query of the catalogue against its SQL in DuckDB, as the driver compares them."""

import glob
import math
import os

import duckdb
import pytest

from trailmark.plans import QUERIES, SQL

SF = os.environ.get("CATALOGUE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    made = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(made.columns) == sorted(names)
    rows = sorted(repr(tuple(map(plain, r))) for r in made.select(names).collect())
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
