import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())
    assert {"p2_found", "p3_found", "p7_found"} <= set(q)
