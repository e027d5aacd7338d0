"""Every registered query of the reference's operators runs; those with oracle SQL agree with DuckDB."""

from __future__ import annotations

import pytest
from tests.compare import oracle_rows, spark_rows

from timetide.jobs import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    columns, rows = spark_rows(catalog.queries()[name](spark, SF))
    assert rows, "no rows"
    if name in catalog.oracles():
        want_columns, want = oracle_rows(catalog.oracles()[name], SF)
        assert columns == want_columns
        assert len(rows) == len(want)
        assert rows == want
