"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

from pathlib import Path

import pytest

import compare as C
from factloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name not in queries.SQL:
        first, again = (sorted(map(str, queries.QUERIES[name](spark, SF).collect())) for _ in range(2))
        assert first == again and first and len(set(first)) == len(first)
        return
    got, want = C.compare(spark, C.duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert got == want
