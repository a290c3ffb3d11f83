import pytest
from oracle import differences

from apexlake.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_is_its_sql(spark, name):
    assert differences(spark, name, QUERIES[name], ORACLES[name], SMALL) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
