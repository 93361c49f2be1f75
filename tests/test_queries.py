"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from loamgrid.plans import registry
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 11 and set(registry.QUERIES) <= set(__spark_entry__.queries())
