"""The driver contract, and a sample of queries against their SQL."""

import pytest
from parity import compare, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["density_by_class", "channel_angle", "match_tiers", "apply_rules", "product_coverage", "budget_topk", "filter_bank", "read_detections",
          "read_geojson", "read_scene_labels", "sufficient_stats", "product_orbit"]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SMALL), duck, entry.oracle_sql()[name]) is None
