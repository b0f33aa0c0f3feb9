"""Every query that has SQL gives the SQL's rows."""

import pytest

from sondera.plans import registry

from .conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, duck, name):
    assert rows_of(registry.queries()[name](spark, data)) == rows_of_sql(duck, registry.oracle_sql()[name])


def test_names_are_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_filter_parse(spark, data):
    rows = registry.queries()["filter_parse"](spark, data).collect()
    assert rows and all(r.f_vid in (0.0, 1.0) and r.f_tip in (0.0, 1.0) for r in rows)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
