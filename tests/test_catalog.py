"""Every registered query of the panel against its SQL, or for its rows where SQL can't express it."""

import pytest
from compare import connect, differences

from tidepanel import catalog

ENTRIES = catalog.entries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ENTRIES.items() if sql))
def test_matches_sql(spark, sf, con, name):
    query, sql = ENTRIES[name]
    assert not differences(query(spark, sf), sql, con)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ENTRIES.items() if not sql))
def test_runs(spark, sf, name):
    """At registered settings, boosted trees and the tuner included."""
    assert ENTRIES[name][0](spark, sf).count() > 0
