import __spark_entry__


def test_flagship_and_registry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and rows[0].score > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())
