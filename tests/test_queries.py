"""Every registered query against its SQL statement; queries without SQL must give rows."""

import pytest
from compare import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert len(df.take(1)) == 1


@pytest.mark.parametrize("name", ["entity_positions", "candidate_topk", "vector_topk", "local_context"])
def test_query_on_more_rows(spark, name):
    """Rounding and ties that the smallest tables don't show."""
    from compare import duck

    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), duck(sf), SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
