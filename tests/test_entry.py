"""The driver contract on sf0.001: the flagship runs, and every query with an
oracle matches DuckDB on the same parquet tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ridecast.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def _rows(names, records):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(_norm(r[i]) for i in at) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ride_id", "travel_date", "travel_from", "car_type", "number_of_tickets", "month", "week",
                          "is_weekend"]


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF)
    exp = con.execute(E.oracle_sql()[name])
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in exp.description], exp.fetchall())
