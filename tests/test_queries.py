"""Every query that SQL can express, against DuckDB over the smallest tables."""

import os

import pytest
from conftest import compare

from quillmark.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_merged_invariants(spark):
    from quillmark.plans.views import derived

    rows = derived(spark, SF, "occurrences")
    kept = rows.filter("delegate_id IS NOT NULL AND delegate_id NOT IN ('-1', '-20')").count()
    assert queries.queries()["merged_rows"](spark, SF).count() == kept
    summary = queries.queries()["person_summary"](spark, SF)
    assert summary.count() == summary.select("delegate_id").distinct().count() == derived(spark, SF, "persons").count()
