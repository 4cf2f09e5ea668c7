"""Every query of the graph engine against its SQL on the smallest tables."""

import pytest

from conftest import SF, same_rows
from loomgraph.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SF), duck.sql(ORACLE[name]))


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
