import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 70
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["rank"] for r in rows] == list(range(1, 11))
