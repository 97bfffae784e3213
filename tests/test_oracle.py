"""Every registered query against its SQL on the supplied tables."""

from __future__ import annotations

import pytest
from conftest import agree

from emberlog.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    agree(registry.queries()[name](spark, sf_dir), sf_dir, SQL[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)
