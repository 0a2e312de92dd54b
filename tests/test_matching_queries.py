"""The queries that match by postcode look at pairs in bounded groups."""

import os

import pytest

from streetwise.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["cache_store", "combine_core_custom", "match_alias_filter_both", "match_alias_filter_null", "match_custom_weights", "match_postcode_bounded", "match_postcode_top1", "match_postcode_topk3", "match_summary", "match_unmatched_status"])
def test_no_row_of_a_pair_is_made(spark, name):
    """As a row for each pair of a postcode, these grew with the square of the tables."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == (2 if name == "combine_core_custom" else 1)
