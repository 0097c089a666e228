"""Every registered query of the library proper runs; those with SQL agree with it row by row."""

from __future__ import annotations

import pytest

from provenant.plans import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        assert oracle.check(df, oracle.connect(sf_dir), registry.ORACLES[name]) > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
