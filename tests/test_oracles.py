"""Every query with an oracle, against DuckDB on the same tables."""

import pytest
from oracle import connect, oracle_rows, spark_rows

import __spark_entry__ as entry_points
from conftest import SF

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf, duck):
    assert spark_rows(QUERIES[name](spark, sf)) == oracle_rows(duck, ORACLES[name])


def test_entry_runs(spark):
    rows = entry_points.entry(spark).collect()
    assert {(r.split, r.label) for r in rows} == {
        (s, y) for s in ("train", "val", "test") for y in (0, 1)
    }
