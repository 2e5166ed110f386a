"""Every registered study query that has SQL gives what the SQL gives."""

import pytest

from helixmill import queries, queries_packed, queries_sources, queries_studies  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(name, agree):
    agree(queries.QUERIES[name], queries.ORACLES[name])
