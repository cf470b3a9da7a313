"""Every registered query against its SQL on the driver's tables, whole results compared."""

from __future__ import annotations

import os

import pytest

from workload.catalog import ORACLES, QUERIES
from workload.check import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problem, _ = compare(spark, SF_DIR, QUERIES[name], ORACLES[name])
    assert not problem


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)
