"""Each registered query against its DuckDB oracle at the smallest scale."""

import duckdb
import pytest

from tidemill import suites

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(suites.queries()) == set(suites.oracle_sql())


@pytest.mark.parametrize("name", sorted(suites.queries()))
def test_oracle(spark, db, name):
    got = suites.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = db.execute(suites.oracle_sql()[name])
    assert names == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == expected
