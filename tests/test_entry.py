import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["column", "value", "n"] and df.count() > 0


def test_every_sql_has_a_query():
    runs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(runs) and len(runs) > 90 and len(sql) > 80
