"""The registered queries as the driver sees them."""

import __spark_entry__ as spark_entry
from catalog.registry import QUERIES


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert rows and {"day", "n", "dprime"} <= set(rows[0].asDict())


def test_every_catalogue_query_has_sql():
    assert not set(QUERIES) - set(spark_entry.oracle_sql())
    assert set(QUERIES) <= set(spark_entry.queries())
