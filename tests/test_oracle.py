"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import compare as C
from factloom import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.collect()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return C.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    got, want = C.compare(spark, con, QUERIES[name], SQL[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Twice the same rows, some of them, each once."""
    first, again = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first == again and first and len(set(first)) == len(first)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
