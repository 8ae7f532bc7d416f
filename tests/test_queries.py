"""Every registered query of the engine against its DuckDB SQL."""

import pytest

from cairnlake.plans import registry
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in registry().items() if sql))
def test_query_equals_sql(spark, sf, duck, name):
    query, sql = registry()[name]
    same(query(spark, sf), duck, sql)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
