"""Every registered query against its SQL, on the smallest given tables."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import database, difference

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
SLOW = {"m04_speed_and_class_forecasts", "m01_congestion_model_quality", "m04_forecasts_held_out", "t14_live_pipeline"}


@pytest.fixture(scope="module")
def db(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, small, db, name):
    rows = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        assert difference(rows, db.execute(SQL[name]).df()) is None
    else:
        assert len(rows) > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_headline_query_is_registered():
    assert entry_points.HEADLINE and set(entry_points.HEADLINE) <= set(QUERIES)
