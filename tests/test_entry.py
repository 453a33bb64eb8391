import __spark_entry__ as entry


def test_registries():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0
