import importlib


def test_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "timeline_health" in queries
    assert entry.entry(spark).count() > 0
