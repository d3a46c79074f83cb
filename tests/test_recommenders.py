import os
import random

import pytest
from pyspark.sql import functions as F

from ratingloom.operators import factorization
from ratingloom.operators.classify import (
    classify,
    fit_forest,
    forest_nodes,
    rejected_features,
    unsound_nodes,
    with_features,
    with_leaves,
)
from ratingloom.operators.collaborative import cf_candidates
from ratingloom.operators.ratings import id_index, labeled_ratings, latest_ratings, prepare, user_history
from ratingloom.operators.serving import blend
from ratingloom.params import AlgorithmSpec, ALSParams, EngineParams, NeighbourParams, PopularityParams
from ratingloom.plans.engine import HybridEngine, HybridModel, make_recommender
from ratingloom.plans.recommenders import ALSRecommender, ForestHybrid
from ratingloom.session import shared_folder

NEIGHBOURS = NeighbourParams(min_common=2, top_n=5)


@pytest.fixture(scope="module")
def ratings(make_ratings):
    rng = random.Random(5)
    rows = [(u, 20 + rng.randrange(15), rng.randint(1, 10) / 2) for u in range(25) for _ in range(8)]
    return make_ratings(rows).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(u, 3) for u in (0, 3, 24, 999)], "user bigint, num int")


@pytest.fixture(scope="module")
def fitted(ratings):
    return factorization.fit_als(latest_ratings(ratings), ALSParams(rank=4, num_iterations=5))


def lists(df):
    found = {}
    for r in df.orderBy("user", "rank").collect():
        found.setdefault(r.user, []).append((r.rank, r.item, r.score))
    return found


def test_als_recommends_known_users_in_order(fitted, queries):
    raw = lists(factorization.als_recommend(fitted, queries, normalize=False))
    assert set(raw) == {0, 3, 24}
    for rows in raw.values():
        assert [r[0] for r in rows] == [1, 2, 3]
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
    shares = lists(factorization.als_recommend(fitted, queries))
    for rows in shares.values():
        assert sum(r[2] for r in rows) == pytest.approx(1)


def test_als_lists_match_scores_of_single_pairs(fitted, queries, spark):
    raw = factorization.als_recommend(fitted, queries, normalize=False)
    items = fitted.items.select(F.col("id").alias("item"))
    every = items.withColumn("user", F.lit(3).cast("bigint"))
    scores = {r.item: r.score for r in factorization.score_pairs(fitted, every).collect()}
    best = sorted(scores.values(), reverse=True)[:3]
    assert [r.score for r in raw.filter("user = 3").orderBy("rank").collect()] == pytest.approx(best, rel=1e-5)


def test_als_batch_keeps_every_query(fitted, spark):
    asked = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (3, 999, 4)], "qid int, user bigint, num int")
    found = {r.qid: r.item_scores for r in factorization.als_batch_predict(fitted, asked).collect()}
    assert [len(found[q]) for q in (1, 2, 3)] == [2, 1, 0]
    assert found[1][0] == found[2][0]


def test_als_is_repeatable(ratings, queries):
    recommender = ALSRecommender(ALSParams(rank=3, num_iterations=3, seed=3))
    one, two = (lists(recommender.fit(ratings).recommend(queries)) for _ in range(2))
    assert {u: [r[1] for r in rows] for u, rows in one.items()} == {u: [r[1] for r in rows] for u, rows in two.items()}


def test_many_iterations_warn(ratings, monkeypatch):
    class NoFit:
        def __init__(self, **_):
            pass

        def fit(self, _):
            return None

    monkeypatch.setattr(factorization, "ALS", NoFit)
    with pytest.warns(UserWarning, match="num_iterations > 30"):
        factorization.fit_als(ratings, ALSParams(num_iterations=31))


def test_empty_ratings_are_refused(ratings):
    none = ratings.limit(0)
    for spec in (AlgorithmSpec("als", ALSParams()), AlgorithmSpec("nb", NEIGHBOURS), AlgorithmSpec("prt", NEIGHBOURS)):
        with pytest.raises(ValueError, match="empty"):
            make_recommender(spec).fit(none)


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_index_is_dense_and_unique(make_ratings, ids):
    index = id_index(make_ratings([(u % 97, 0, 1) for u in range(300)], ids), "user", buckets=8)
    rows = index.collect()
    assert sorted(r.idx for r in rows) == list(range(97))
    assert len({r.id for r in rows}) == 97


def test_forest_hybrid_shares_sum_to_weight(ratings, queries):
    model = ForestHybrid(NEIGHBOURS).fit(ratings)
    found = model.recommend(queries)
    seen = ratings.select("user", "item")
    assert found.join(seen, ["user", "item"]).isEmpty()
    for rows in lists(found).values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert sum(r[2] for r in rows) == pytest.approx(1)


def test_forest_settings(ratings):
    model = fit_forest(labeled_ratings(ratings))
    assert model.getNumTrees == 5 and max(t.depth for t in model.trees) <= 5
    assert {r.prediction for r in classify(model, ratings).select("prediction").collect()} <= {0.0, 1.0}


def test_forest_as_a_table_of_nodes(spark, ratings):
    """Rows routed by hand through the nodes end where the expressions say, and are judged as by the model."""
    labeled = labeled_ratings(latest_ratings(ratings))
    model = fit_forest(labeled)
    nodes = forest_nodes(model, spark)
    table = {(n.tree, n.node): n for n in nodes.collect()}
    assert len({t for t, _ in table}) == 5 and len(table) > 20
    assert unsound_nodes(nodes).isEmpty()
    bad = nodes.withColumn("n_one", F.when((F.col("tree") == 1) & (F.col("node") == 0), 9999.0).otherwise(F.col("n_one")))
    assert {(r.tree, r.node) for r in unsound_nodes(bad).collect()} == {(1, 0)}
    for row in classify(model, with_leaves(model, labeled)).collect():
        share = 0.0
        for tree, leaf in enumerate(row.leaves):
            node = table[tree, 0]
            while node.feature is not None:
                value = (row.user, row.item)[node.feature]
                node = table[tree, node.left if value <= node.threshold else node.right]
            assert node.node == leaf
            share += node.n_one / (node.n_zero + node.n_one) / 5
        assert row.liked_share == pytest.approx(share)
        assert row.prediction == (share > 0.5) or abs(share - 0.5) < 1e-9


def test_text_ids_without_numbers(make_ratings):
    pairs = make_ratings([("1", "7", 1), ("x", "8", 1)], "string").select("user", "item")
    assert [r.user for r in with_features(pairs, strict=False).collect()] == ["1"]
    assert [tuple(r) for r in rejected_features(pairs).collect()] == [("x", "8", "user is not a number")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        with_features(pairs).collect()


def test_blend_sums_and_ranks(spark, queries):
    columns = "user bigint, num int, item bigint, score double"
    one = spark.createDataFrame([(0, 3, 1, 0.5), (0, 3, 2, 0.5)], columns)
    two = spark.createDataFrame([(0, 3, 2, 0.3), (0, 3, 3, 0.7), (0, 3, 4, 0.1)], columns)
    assert lists(blend([one, two], queries)) == {0: [(1, 2, 0.8), (2, 3, 0.7), (3, 1, 0.5)]}


ALL = (
    AlgorithmSpec("nb", NEIGHBOURS),
    AlgorithmSpec("als", ALSParams(rank=3, num_iterations=3)),
    AlgorithmSpec("prt", NEIGHBOURS),
    AlgorithmSpec("mv", PopularityParams(5)),
)


def test_engine_round_trip(spark, ratings, queries, tmp_path):
    model = HybridEngine(EngineParams(algorithms=ALL)).fit(ratings)
    served = {r.user: r.item_scores for r in model.serve(queries).collect()}
    assert set(served) == {0, 3, 24, 999} and all(len(v) <= 3 for v in served.values())
    assert len(served[999]) == 3  # unknown users still get popular items
    model.save(spark, str(tmp_path / "model"))
    loaded = HybridModel.load(spark, str(tmp_path / "model"))
    assert [name for name, _ in loaded.parts] == ["nb", "als", "prt", "mv"]
    assert {r.user: r.item_scores for r in loaded.serve(queries).collect()} == served


def test_saving_that_breaks_off_leaves_the_version_before(spark, ratings, queries, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    models = [HybridEngine(EngineParams(algorithms=(AlgorithmSpec("mv", PopularityParams(n)),))).fit(ratings) for n in (2, 5)]
    with pytest.raises(FileNotFoundError):
        HybridModel.load(spark, path)
    models[0].save(spark, path)
    size = lambda: HybridModel.load(spark, path).parts[0][1].max_items
    with monkeypatch.context() as m:
        m.setattr(type(models[1].parts[0][1]), "save", lambda self, p: self.top.write.parquet(f"{p}/top") or 1 / 0)
        with pytest.raises(ZeroDivisionError):
            models[1].save(spark, path)
    assert size() == 2
    models[1].save(spark, path)
    assert size() == 5
    # the last two published versions stay
    for _ in range(2):
        models[0].save(spark, path)
    assert size() == 2
    assert sum((tmp_path / "model" / n / "manifest.json").exists() for n in os.listdir(path)) == 2
    newest = max(n for n in os.listdir(path) if (tmp_path / "model" / n / "manifest.json").exists())
    next((tmp_path / "model" / newest / "part-0" / "seen").glob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="1 files are missing or cut"):
        HybridModel.load(spark, path)


def test_prepare_step(ratings):
    assert prepare(ratings) is ratings
    assert prepare(ratings, lambda df: df.filter("rating > 4")).filter("rating <= 4").isEmpty()


def test_candidates_of_a_hub_neighbour(spark):
    """One user is everybody's neighbour; every user still gets its items."""
    neighbours = spark.range(1, 2001).selectExpr("id AS user", "0L AS neighbour", "0.5D AS similarity", "1 AS rank")
    likes = spark.createDataFrame([(0, i, float(i)) for i in range(1, 4)], "user bigint, item bigint, rating double")
    seen = spark.range(1, 2001).selectExpr("id AS user", "1L AS item")
    found = cf_candidates(neighbours, likes, seen)
    assert found.count() == 4000
    assert {(r.item, r.score) for r in found.select("item", "score").distinct().collect()} == {(2, 1.0), (3, 1.5)}


def test_long_history_is_split_and_whole(make_ratings):
    ratings = make_ratings([(1, i, 1) for i in range(500)] + [(2, 5, 1), (2, 5, 2)])
    rows = user_history(ratings, items_per_row=50).collect()
    assert sorted(i for r in rows if r.user == 1 for i in r["items"]) == list(range(500))
    assert len([r for r in rows if r.user == 1]) == 10
    assert max(len(r["items"]) for r in rows) < 100
    assert [r["items"] for r in rows if r.user == 2] == [[5]]


@pytest.mark.parametrize("compat", [False, True])
def test_each_query_is_answered_as_if_alone(spark, ratings, compat):
    """A user who asks for two and for five items gets both lists, from every recommender and the blend."""
    model = HybridEngine(EngineParams(algorithms=ALL), compat=compat).fit(ratings)
    users = [0, 3, 24, 999]

    def answers(recommender, nums):
        asked = spark.createDataFrame([(u, n) for u in users for n in nums], "user bigint, num int")
        rows = recommender.recommend(asked).drop("rank").collect()
        return sorted((r.user, r.num, r.item, str(r.score)) for r in rows)

    for recommender in [m for _, m in model.parts] + [model]:
        assert answers(recommender, [2, 5]) == sorted(answers(recommender, [2]) + answers(recommender, [5]))
    asked = spark.createDataFrame([(u, n) for u in users for n in (2, 5)], "user bigint, num int")
    served = model.serve(asked).collect()
    assert len(served) == 8 and all(len(r.item_scores) <= r.num for r in served)


def test_recommend_reads_stored_lists_only(ratings, queries):
    model = HybridEngine(EngineParams(algorithms=ALL)).fit(ratings)
    for name, part in model.parts:
        plan = part.recommend(queries)._jdf.queryExecution().optimizedPlan().toString()
        # the ratings of the fixture are cached; nothing of them may be read again
        assert "InMemoryRelation" not in plan, name


def test_blocks_follow_the_cluster(spark, ratings):
    slots = spark.sparkContext.defaultParallelism
    assert factorization.automatic_blocks(ratings) == slots
    assert factorization.automatic_blocks(ratings, rows_per_block=5) == max(slots, 40)
    fitted = factorization.fit_als(latest_ratings(ratings), ALSParams(rank=2, num_iterations=1, user_blocks=3, item_blocks=2))
    assert fitted.model.userFactors.rdd.getNumPartitions() == 3
    assert fitted.model.itemFactors.rdd.getNumPartitions() == 2


def test_lists_without_positive_total_have_no_shares(spark, make_ratings):
    low = make_ratings([(u, i, -1 - (u * i) % 3) for u in range(6) for i in range(6)])
    fitted = factorization.fit_als(latest_ratings(low), ALSParams(rank=2, num_iterations=3))
    asked = spark.createDataFrame([(1, 3)], "user bigint, num int")
    found = factorization.als_recommend(fitted, asked)
    assert [r.score for r in found.collect()] == [None] * 3
    assert [tuple(r) for r in factorization.shareless_queries(found).collect()] == [(1, 3)]


def test_closing_a_model_deletes_what_it_stored(spark, ratings, queries):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    model = HybridEngine(EngineParams(algorithms=ALL)).fit(ratings)
    assert model.serve(queries).count() == 4 and model.summary().count() == 16
    assert len(set(os.listdir(folder)) - before) >= 1
    model.close(spark)
    assert {n for n in set(os.listdir(folder)) - before if not n.startswith("rdd-")} == set()
