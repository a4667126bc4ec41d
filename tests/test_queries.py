import os

import pytest

from __spark_entry__ import entry
from repoaudit.plans import oracles
from repoaudit.plans.queries import ALL
from tests.oracle_check import difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"repo", "category", "severity", "n"}


def test_every_query_has_an_oracle():
    assert set(ALL) == set(oracles.all_sql())


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_its_oracle(spark, name):
    assert difference(spark, SF, ALL[name], oracles.all_sql()[name]) is None


@pytest.mark.parametrize("name", ["dependency_findings", "registry_npm", "api_findings"])
def test_other_ways_of_joining_change_nothing(spark, monkeypatch, name):
    """Frequent keys apart, no broadcast of known names, names in several arrays."""
    from repoaudit.operators import apicheck, joins

    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    monkeypatch.setattr(apicheck, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(apicheck, "ARRAY_NAMES", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert difference(spark, SF, ALL[name], oracles.all_sql()[name]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
