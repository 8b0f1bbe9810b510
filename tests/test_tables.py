"""Tables of a corpus that queries make on the way."""

from pyspark.sql import functions as F

from lexispark.plans import catalogue


def test_tables_of_a_corpus_are_not_written(spark, sf):
    posts, lex, stats = catalogue.tables_of(catalogue.docs_of(spark, sf))
    assert "MapInArrow" in posts._jdf.queryExecution().executedPlan().toString()
    assert stats.sum_dl == posts.agg(F.sum("tf")).first()[0] and lex.count() == posts.select("term").distinct().count()
