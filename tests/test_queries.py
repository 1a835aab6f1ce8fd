"""Every query of the catalogue: against its SQL, or for rows of a stable schema."""

import pytest

import known_results
from quillmesh import catalog

#: queries that don't read the tables may have few rows; these may be empty at the smallest size
MAY_BE_EMPTY = {"marker_wrap", "marker_round_trip"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, spark, data, same_as_sql):
    n = same_as_sql(catalog.QUERIES[name](spark, data), catalog.ORACLES[name])
    assert n > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(known_results.QUERIES))
def test_known_results(name, spark, data, same_as_sql):
    assert same_as_sql(known_results.QUERIES[name](spark, data), known_results.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(name, spark, data):
    assert catalog.QUERIES[name](spark, data).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["page_id", "classification", "n_blocks"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
