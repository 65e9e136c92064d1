import __spark_entry__ as entry


def test_names_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
