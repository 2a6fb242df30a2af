"""Every query with SQL gives the rows that the SQL gives."""

import glob
import os

import duckdb
import pytest

from marquee.plans.registry import ORACLES, QUERIES


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if v is None or v != v else repr(v) if isinstance(v, float) else str(v)
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, database, name):
    got, want = QUERIES[name](spark, sf_dir), database.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
