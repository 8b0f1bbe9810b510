"""The driver's entry, with whatever optional parts are there."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "rank", "score"]


def test_queries_and_sql():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) >= 55
