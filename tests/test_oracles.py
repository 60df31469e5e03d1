"""Every core query with an oracle agrees with DuckDB; every other one runs."""

from __future__ import annotations

import pytest

from rankloom.plans import registry

from . import compare

#: The smallest tables hold no search with enough judged candidates.
NONE_HERE = {"oof_preferences", "oof_summary"}
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    assert compare.differ(registry.queries()[name](spark, sf), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0 or name in NONE_HERE
