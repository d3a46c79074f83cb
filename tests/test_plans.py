"""Physical plans: pushed filters, pruned columns, no cross joins, bounded top-k."""

import pytest

from ratingloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_filter_and_prunes_columns(spark):
    text = plan(spark, "item_view_counts")
    assert "EqualTo(event_type,purchase)" in text
    assert "ReadSchema: struct<" in text
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "ts:" not in schema
    assert "partial_count" in text


NO_CROSS = [
    "popular_unseen_per_user",
    "order_popular_unseen",
    "pearson_pairs",
    "nearest_users",
    "cf_candidates",
    "cf_nb_recommend",
    "hybrid_serve",
    "precision_at_k",
    "mean_centered_ratings",
    "user_history",
]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", ["nearest_users", "user_likes", "cf_nb_recommend", "hybrid_serve", "recent_items"])
def test_top_k_per_group_is_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_global_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "most_viewed_topk")
