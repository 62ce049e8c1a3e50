"""Every registered query against its SQL twin, with blocks of seven rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import compare, oracle

from catalog.registry import ORACLES, QUERIES
# Queries that fit a model or follow an order-dependent rule; their tests are in test_vectors.
WITHOUT_ORACLE = {"leader_cluster", "global_identity", "frame_scorer", "frame_scorer_folds"}


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_blocks, con, name):
    ok, note = compare(spark, SF, con, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["video_id", "clips", "first_start", "seconds"]
    assert df.count() > 0
