"""Every registered query of the library's own against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from lodeframe.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, smallest, rows_of, duck_rows, name):
    got = rows_of(registry.QUERIES[name](spark, smallest))
    if name in registry.ORACLES:
        assert got == duck_rows(registry.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["ym", "v", "n", "diff", "pct"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
