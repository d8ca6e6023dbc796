"""Every registered query beside its SQL, on the smallest tables."""

import pytest

from checks.oracle import ORACLES
from checks.queries import REGISTRY
from checks.verify import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_but_two_has_sql():
    assert set(REGISTRY) - set(ORACLES) == {"cf_recommend", "end_to_end_batch"}
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(REGISTRY[name](spark, SF).toArrow(), con.sql(ORACLES[name]).to_arrow_table()) == ""


def test_svd_recommendations_have_rows(spark):
    rows = REGISTRY["cf_recommend"](spark, SF).collect()
    assert rows and all(r["score"] >= 0.5 for r in rows)
