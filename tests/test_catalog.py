"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from deckloom.plans import catalog

from .compare import assert_same, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


def test_only_clusters_have_no_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"q_cluster", "q_holdout", "q_blind"}


def test_clusters_number_every_deck(spark):
    rows = catalog.QUERIES["q_cluster"](spark, SF)
    assert rows.count() == rows.select("deck_id").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
