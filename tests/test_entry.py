"""The driver's contract: every query has a builder, and SQL twins name the same columns."""

import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns and rows.count() >= 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
