from conftest import SMALL


def test_entry(spark):
    import __spark_entry__ as e

    assert e.queries()["redact_text"](spark, SMALL).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
