"""Every query of the analytics part: against its SQL where there is one, else that it runs."""

import compare
import pytest

import __spark_entry__
from lectern.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, sf, name):
    compare.same(plans.QUERIES[name](spark, sf), plans.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "type", "severity", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
