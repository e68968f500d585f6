"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from wayline.plans.catalog import ORACLE, QUERIES
from wayline.plans.verify import check

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = check(spark, DATA, name)
    assert got["ok"], got
    # the smallest table has too few raters with complete answers
    assert got["rows"] > 0 or name == "vote_tally"


def test_contract(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert QUERIES.items() <= contract.queries().items() and ORACLE.items() <= contract.oracle_sql().items()
    assert contract.entry(spark).columns[-1] == "instruction"
