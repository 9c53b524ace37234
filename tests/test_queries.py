import pytest

import __spark_entry__
from siteloom.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, compare):
    compare(QUERIES[name], ORACLE[name])


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["chrom", "site_start", "site_end", "site_strand", "fragments"] and got.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
