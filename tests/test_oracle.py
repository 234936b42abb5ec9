import pytest

from millrace import registry

from .oracle import connect, differences


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, tiny, con, name):
    assert not differences(registry.QUERIES[name](spark, tiny), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["corpus_id", "documents", "bytes", "characters"]
    assert set(e.oracle_sql()) <= set(e.queries())
