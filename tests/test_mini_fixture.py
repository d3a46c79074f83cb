"""Worked values of the small example, default and compatible mode."""

import math

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import classify, collaborative, popularity, similarity
from ratingloom.operators import ratings as rating_ops
from ratingloom.params import NeighbourParams, PopularityParams
from ratingloom.plans.recommenders import NaiveBayesHybrid, Neighbourhood, PopularityRecommender

PARAMS = NeighbourParams(min_common=2, top_n=2)


def _short(similarity):
    return similarity if similarity is None else round(similarity, 6)


def _shortened(neighbours):
    """Similarities to the six digits that the worked example gives."""
    return neighbours.withColumn("similarity", F.round("similarity", 6))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def queries(spark, *users, num=2, ids="bigint"):
    return spark.createDataFrame([(u, num) for u in users], f"user {ids}, num int")


@pytest.fixture(scope="module")
def default(mini):
    return Neighbourhood.build(mini, PARAMS)


@pytest.fixture(scope="module")
def compat(mini):
    return Neighbourhood.build(mini, PARAMS, compat=True)


def test_means(mini):
    latest = dict(rows(rating_ops.user_means(rating_ops.latest_ratings(mini)), "user", "mean_rating"))
    assert latest == pytest.approx({1: 3, 2: 3.5, 9: 3.25, 10: 3.4, 11: 10 / 3})
    every = dict(rows(rating_ops.user_means(mini), "user", "mean_rating"))
    assert every == pytest.approx({1: 3, 2: 3.2, 9: 3.25, 10: 3.4, 11: 10 / 3})


EXPECTED_PAIRS = {
    (1, 2): 1.0, (1, 9): -1.0, (1, 10): 0.960769, (1, 11): None, (2, 9): -1.0, (2, 10): 0.960769,
    (2, 11): None, (9, 10): -0.695978, (9, 11): None, (10, 11): -0.944911,
}


def test_pearson(mini):
    found = {(r.user_a, r.user_b): _short(r.similarity) for r in similarity.pearson_pairs(mini, PARAMS).collect()}
    assert found == EXPECTED_PAIRS


def test_pearson_compat_orders_ids_as_text(mini):
    found = {(r.user_a, r.user_b): _short(r.similarity) for r in similarity.pearson_pairs(mini, PARAMS, True).collect()}
    assert found[(10, 2)] == 0.960769 and (2, 10) not in found
    assert math.isnan(found[(1, 11)])


def test_text_ids_give_the_same_pairs(mini_text):
    found = similarity.pearson_pairs(mini_text, PARAMS).collect()
    assert {(int(r.user_a), int(r.user_b)): _short(r.similarity) for r in found} == EXPECTED_PAIRS


def test_neighbours(default):
    assert rows(_shortened(default.neighbours), "user", "rank", "neighbour", "similarity") == [
        (1, 1, 2, 1.0), (1, 2, 10, 0.960769), (2, 1, 1, 1.0), (2, 2, 10, 0.960769),
        (10, 1, 1, 0.960769), (10, 2, 2, 0.960769),
    ]


def test_neighbours_compat(compat):
    assert rows(_shortened(compat.neighbours), "user", "neighbour", "similarity") == [
        (1, 2, 1.0), (1, 10, 0.960769), (10, 2, 0.960769),
    ]


@pytest.mark.parametrize("mode", ["default", "compat"])
def test_likes(mode, request):
    lists = request.getfixturevalue(mode)
    assert rows(lists.likes, "user", "item", "rating") == [
        (1, 10, 5), (2, 10, 4), (2, 13, 5), (9, 12, 5), (9, 14, 4), (10, 10, 5), (10, 14, 5), (11, 15, 4),
    ]


def test_candidates(default, compat):
    found = collaborative.cf_candidates(default.neighbours, default.likes, default.seen)
    found = found.withColumn("score", F.round("score", 6))
    assert rows(found, "user", "item", "score") == [(1, 13, 5), (1, 14, 4.803845), (2, 14, 4.803845), (10, 13, 4.803845 + 0)]
    found = collaborative.cf_candidates(compat.neighbours, compat.likes, compat.seen)
    found = found.withColumn("score", F.round("score", 6))
    assert rows(found, "user", "item", "score") == [(1, 13, 5), (1, 14, 4.803845), (10, 13, 4.803845)]


@pytest.mark.parametrize(
    ("latest", "expected"),
    [
        (True, {0: (10, 66, 115, -0.646627, -1.004794, -0.455896), 1: (9, 64, 109, -0.741937, -0.990399, -0.464306)}),
        (False, {0: (11, 68, 128, -0.606136, -1.054161, -0.428455), 1: (9, 64, 109, -0.788457, -0.990399, -0.464306)}),
    ],
)
def test_naive_bayes(mini, latest, expected):
    labeled = rating_ops.labeled_ratings(rating_ops.latest_ratings(mini) if latest else mini)
    table = classify.naive_bayes_table(classify.fit_naive_bayes(labeled), labeled)
    names = ("n_rows", "sum_user", "sum_item", "pi", "theta_user", "theta_item")
    found = {int(r.label): tuple(r[n] for n in names) for r in table.collect()}
    for label, values in expected.items():
        assert found[label] == pytest.approx(values, abs=1e-6)


def test_naive_bayes_hybrid_rejects_all(spark, mini):
    model = NaiveBayesHybrid(PARAMS).fit(mini)
    assert model.recommend(queries(spark, 1, 2, 9, 10, 11)).isEmpty()
    compat = NaiveBayesHybrid(PARAMS, compat=True).fit(mini)
    found = compat.recommend(queries(spark, 1))
    assert rows(found, "user", "item", "score") == [(1, 13, math.inf), (1, 14, math.inf)]


def test_views_and_pruning(mini):
    counts = rating_ops.item_view_counts(mini)
    assert dict(rows(counts, "item", "views")) == {10: 5, 11: 5, 12: 4, 13: 2, 14: 2, 15: 2}
    assert popularity.prune_threshold(counts, 2) == pytest.approx(20 / 6)
    assert {r.item for r in popularity.popularity_mean_prune(counts, 2).collect()} == {10, 11, 12}
    assert rows(popularity.most_viewed(counts, 2), "rank", "item") == [(1, 10), (2, 11)]


def test_pruning_of_equal_views_leaves_none(make_ratings):
    counts = rating_ops.item_view_counts(make_ratings([(u, i, 1) for u in (1, 2) for i in range(9)]))
    assert popularity.popularity_mean_prune(counts, 2).isEmpty()
    assert popularity.popularity_mean_prune(counts, 5).count() == 9


def test_popularity(spark, mini):
    model = PopularityRecommender(PopularityParams(2)).fit(mini)
    assert rows(model.recommend(queries(spark, 1, 99)), "user", "item", "score", "rank") == [
        (99, 10, 0.5, 1), (99, 11, 0.5, 2),
    ]
    compat = PopularityRecommender(PopularityParams(2), compat=True).fit(mini)
    assert rows(compat.recommend(queries(spark, 1, 99)), "user", "item", "score") == [
        (1, 10, 0.0), (1, 11, 0.0), (99, 10, 0.0), (99, 11, 0.0),
    ]
    single = compat.recommend(queries(spark, 99, num=1))
    assert rows(single, "item", "score") == [(10, 1.0)]


def test_popularity_skips_seen_items_in_the_middle(spark, mini):
    model = PopularityRecommender(PopularityParams(6)).fit(mini)
    found = model.recommend(queries(spark, 11, num=3))
    assert rows(found, "rank", "item") == [(1, 12), (2, 13), (3, 14)]
    assert found.agg(F.sum("score")).first()[0] == pytest.approx(1)


def test_text_ids_rank_by_number(spark, make_ratings):
    ratings = make_ratings([("1", "9", 1), ("1", "10", 1), ("1", "b", 1)], "string")
    top = popularity.most_viewed(rating_ops.item_view_counts(ratings), 3)
    assert rows(top, "rank", "item") == [(1, "9"), (2, "10"), (3, "b")]
