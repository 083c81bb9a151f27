import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
