import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "quality_score", "drop_reason"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())
