"""The driver contract."""

import __spark_entry__


def test_entry_has_rows_and_names_agree(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
