import pytest

from corpusweave import catalogue
from tests.oracle import compare, connection


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, name):
    compare(catalogue.queries()[name](spark, sf_dir), connection(sf_dir), catalogue.oracle_sql()[name])


def test_queries_without_oracle_give_rows(spark, sf_dir):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
