"""Registered queries: every operator over the driver's tables.

Ratings are the purchase events (user, item ``k``, value); settings are small
enough for the test scales and the same in :mod:`ratingloom.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.functions.scoring import SCORE_DECIMALS
from ratingloom.operators import block_search, classify, collaborative, evaluation, factorization, folds, popularity, similarity
from ratingloom.operators import ratings as rating_ops
from ratingloom.params import (
    AlgorithmSpec,
    ALSParams,
    EngineParams,
    EvalParams,
    NeighbourParams,
    PopularityParams,
)
from ratingloom.plans.engine import HybridEngine, HybridModel
from ratingloom.plans.evaluation import DEFAULT_SWEEP, cross_validate, param_sweep
from ratingloom.plans.recommenders import (
    ForestHybrid,
    NaiveBayesHybrid,
    Neighbourhood,
    PopularityRecommender,
)
from ratingloom.session import fresh_path
from ratingloom.sources.csv_import import import_ratings_csv, rejected_csv_lines
from ratingloom.sources.events import (
    CLICKSTREAM,
    dataset_summary,
    read_event_store,
    rejected_events,
    scan_ratings,
)

PURCHASE = ("purchase",)
NEIGHBOURS = NeighbourParams(min_common=3, top_n=20)
POPULAR = PopularityParams(max_items=20)
ALS_SETTINGS = ALSParams()
NUM = 5
MIXED_NUMS = (2, 5)
DEFAULT_NUM = EvalParams().query_num
FOLDS = EvalParams(k_fold=5, query_num=NUM)
SWEEP_ITEMS = (2, 10, 50)
#: Shared items and length of the lists.
SWEEP_NEIGHBOURS = ((3, 20), (3, 5), (5, 150), (10, 50))
FOLD_TOPS = {NEIGHBOURS.min_common: NEIGHBOURS.top_n, NEIGHBOURS.min_common + 2: 5}
BLEND = (AlgorithmSpec("nb", NEIGHBOURS), AlgorithmSpec("mv", POPULAR))
ORDER_POPULAR = PopularityParams(max_items=300)
ORDER_NUM = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_ratings(_table(spark, sf_dir, "events"), PURCHASE, CLICKSTREAM)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_ops.latest_ratings(_ratings(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per user of any event, so also for users without purchases."""
    users = _table(spark, sf_dir, "events").select(F.col("user_id").alias("user")).distinct()
    return users.withColumn("num", F.lit(NUM))


def _order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer, supplier and quantity of every order line."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user"),
        F.col("l_suppkey").alias("item"),
        F.col("l_quantity").alias("rating"),
        F.col("o_orderdate").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, SCORE_DECIMALS) for c in columns})


def _labelled_numbers(df: DataFrame, column: str) -> DataFrame:
    """Split a column into a finite value and its kind, for comparison by text."""
    value = F.col(column)
    infinite = value.isin(float("inf"), float("-inf"))
    kind = F.when(value.isNull(), "null").when(F.isnan(value), "nan").when(infinite, "infinite").otherwise("finite")
    return df.withColumn(f"{column}_kind", kind).withColumn(column, F.when(F.col(f"{column}_kind") == "finite", value))


# -- sources ---------------------------------------------------------------


@query
def event_rating_scan(spark, sf_dir):
    return _ratings(spark, sf_dir)


@query
def event_reject_report(spark, sf_dir):
    return rejected_events(_table(spark, sf_dir, "events"), PURCHASE, CLICKSTREAM)


@query
def dataset_summary_rows(spark, sf_dir):
    return dataset_summary(_ratings(spark, sf_dir))


@query
def csv_rating_import(spark, sf_dir):
    """Ratings written as a rating file, imported as events and scanned again."""
    path, store = fresh_path(spark, "csv"), fresh_path(spark, "events")
    _ratings(spark, sf_dir).select(
        F.col("user").alias("userId"),
        F.col("item").alias("movieId"),
        "rating",
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("timestamp"),
    ).write.option("header", True).csv(path)
    import_ratings_csv(spark, path, store, "shop")
    rows = scan_ratings(read_event_store(spark, store, "shop"))
    return rows.select("user", "item", "rating", F.unix_seconds("ts").alias("seconds"))


@query
def csv_import_rejects(spark, sf_dir):
    """Lines a tolerant import leaves out: some ratings and times of the file are words."""
    path = fresh_path(spark, "csv")
    _ratings(spark, sf_dir).select(
        F.col("user").alias("userId"),
        F.col("item").alias("movieId"),
        F.when(F.col("event_id") % 7 == 0, "good").otherwise(F.col("event_id").cast("string")).alias("rating"),
        F.when(F.col("event_id") % 11 == 0, "late").otherwise(F.col("event_id").cast("string")).alias("timestamp"),
    ).write.option("header", True).csv(path)
    return rejected_csv_lines(spark, path)


# -- ratings ---------------------------------------------------------------


@query
def rating_dedup_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


@query
def user_rating_stats(spark, sf_dir):
    return rating_ops.user_rating_stats(_ratings(spark, sf_dir))


@query
def user_history(spark, sf_dir):
    rows = rating_ops.user_history(_ratings(spark, sf_dir), items_per_row=10)
    return rows.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query
def item_view_counts(spark, sf_dir):
    return rating_ops.item_view_counts(_ratings(spark, sf_dir))


@query
def labeled_ratings(spark, sf_dir):
    return rating_ops.labeled_ratings(_latest(spark, sf_dir))


@query
def labeled_ratings_compat(spark, sf_dir):
    return rating_ops.labeled_ratings(_ratings(spark, sf_dir))


@query
def preference_coefficient(spark, sf_dir):
    return _rounded(rating_ops.preference_coefficient(_latest(spark, sf_dir)), "preference")


@query
def mean_centered_ratings(spark, sf_dir):
    return _rounded(rating_ops.mean_centered_ratings(_latest(spark, sf_dir)), "centered")


@query
def recent_items(spark, sf_dir):
    return rating_ops.recent_items(_ratings(spark, sf_dir), NUM)


# -- popularity ------------------------------------------------------------


@query
def popularity_mean_prune(spark, sf_dir):
    counts = rating_ops.item_view_counts(_ratings(spark, sf_dir))
    return popularity.popularity_mean_prune(counts, POPULAR.max_items)


@query
def most_viewed_topk(spark, sf_dir):
    return popularity.item_views_top(_ratings(spark, sf_dir), POPULAR.max_items)


@query
def popular_unseen_per_user(spark, sf_dir):
    return PopularityRecommender(POPULAR).fit(_ratings(spark, sf_dir)).recommend(_asked(spark, sf_dir)).drop("num")


@query
def popular_per_user_compat(spark, sf_dir):
    model = PopularityRecommender(POPULAR, compat=True).fit(_ratings(spark, sf_dir))
    return model.recommend(_asked(spark, sf_dir)).drop("num")


@query
def order_user_stats(spark, sf_dir):
    return rating_ops.user_rating_stats(_order_ratings(spark, sf_dir))


@query
def order_rating_latest(spark, sf_dir):
    return rating_ops.latest_ratings(_order_ratings(spark, sf_dir))


@query
def order_most_viewed(spark, sf_dir):
    return popularity.item_views_top(_order_ratings(spark, sf_dir), ORDER_POPULAR.max_items)


@query
def order_popular_unseen(spark, sf_dir):
    ratings = _order_ratings(spark, sf_dir)
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    asked = customers.withColumn("num", F.lit(ORDER_NUM))
    return PopularityRecommender(ORDER_POPULAR).fit(ratings).recommend(asked).drop("num")


# -- similar users ---------------------------------------------------------


@query
def pearson_pairs(spark, sf_dir):
    return _rounded(similarity.pearson_pairs(_ratings(spark, sf_dir), NEIGHBOURS), "similarity")


@query
def cosine_pairs(spark, sf_dir):
    return _rounded(similarity.cosine_pairs(_ratings(spark, sf_dir), NEIGHBOURS), "similarity")


@query
def nearest_users(spark, sf_dir):
    return _rounded(block_search.similar_users(_ratings(spark, sf_dir), NEIGHBOURS), "similarity")


@query
def nearest_users_compat(spark, sf_dir):
    return _rounded(block_search.similar_users(_ratings(spark, sf_dir), NEIGHBOURS, compat=True), "similarity")


@query
def nearest_users_all_events(spark, sf_dir):
    """Every event as a rating, default settings: most users share most items."""
    events = _table(spark, sf_dir, "events")
    names = ("view", "signup", "click", "error", "purchase")
    found = block_search.similar_users(scan_ratings(events, names, CLICKSTREAM), NeighbourParams())
    return _rounded(found, "similarity")



@query
def user_likes(spark, sf_dir):
    return rating_ops.user_likes(_latest(spark, sf_dir), NEIGHBOURS.top_n)


@query
def user_likes_compat(spark, sf_dir):
    return rating_ops.user_likes(_ratings(spark, sf_dir), NEIGHBOURS.top_n).drop("rank")


def _neighbourhood(spark, sf_dir, compat=False):
    return Neighbourhood.build(_ratings(spark, sf_dir), NEIGHBOURS, compat)


@query
def cf_candidates(spark, sf_dir):
    lists = _neighbourhood(spark, sf_dir)
    return collaborative.cf_candidates(lists.neighbours, lists.likes, lists.seen)


@query
def cf_candidates_compat(spark, sf_dir):
    lists = _neighbourhood(spark, sf_dir, compat=True)
    return collaborative.cf_candidates(lists.neighbours, lists.likes, lists.seen)


# -- classifiers -----------------------------------------------------------


@query
def nb_fit(spark, sf_dir):
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    table = classify.naive_bayes_table(classify.fit_naive_bayes(labeled), labeled)
    return _rounded(table, "pi", "theta_user", "theta_item")


@query
def nb_fit_compat(spark, sf_dir):
    labeled = rating_ops.labeled_ratings(_ratings(spark, sf_dir))
    table = classify.naive_bayes_table(classify.fit_naive_bayes(labeled), labeled)
    return _rounded(table, "pi", "theta_user", "theta_item")


@query
def nb_classify(spark, sf_dir):
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    return classify.classify(classify.fit_naive_bayes(labeled), labeled)


@query
def rf_fit(spark, sf_dir):
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    return classify.forest_table(classify.fit_forest(labeled), labeled)


@query
def rf_classify(spark, sf_dir):
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    return classify.classify(classify.fit_forest(labeled), labeled)


@query
def chi_square_features(spark, sf_dir):
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    table = classify.chi_square_features(labeled)
    return table.withColumns({c: F.round(c, 6) for c in ("statistic", "z_score")})


# -- recommenders ----------------------------------------------------------


@query
def cf_nb_recommend(spark, sf_dir):
    return NaiveBayesHybrid(NEIGHBOURS).fit(_ratings(spark, sf_dir)).recommend(_asked(spark, sf_dir)).drop("num")


@query
def cf_nb_recommend_compat(spark, sf_dir):
    model = NaiveBayesHybrid(NEIGHBOURS, compat=True).fit(_ratings(spark, sf_dir))
    return _labelled_numbers(model.recommend(_asked(spark, sf_dir)).drop("num"), "score")


@query
def cf_rf_recommend(spark, sf_dir):
    return ForestHybrid(NEIGHBOURS).fit(_ratings(spark, sf_dir)).recommend(_asked(spark, sf_dir)).drop("num")


def _index_facts(ids: DataFrame, side: str) -> DataFrame:
    return ids.agg(
        F.lit(side).alias("side"),
        F.count(F.lit(1)).alias("n"),
        F.min("idx").alias("min_idx"),
        F.max("idx").alias("max_idx"),
        F.count_distinct("idx").alias("n_idx"),
        F.count_distinct("id").alias("n_ids"),
    )


@query
def als_id_index(spark, sf_dir):
    rows = _ratings(spark, sf_dir)
    users = _index_facts(rating_ops.id_index(rows, "user"), "user")
    return users.unionByName(_index_facts(rating_ops.id_index(rows, "item"), "item"))


def _factorized(spark, sf_dir):
    data = rating_ops.TrainingData(_ratings(spark, sf_dir))
    return factorization.fit_als(data.latest, ALS_SETTINGS)


@query
def als_fit(spark, sf_dir):
    return factorization.factors(_factorized(spark, sf_dir))


@query
def als_score_pairs(spark, sf_dir):
    return factorization.score_pairs(_factorized(spark, sf_dir), _latest(spark, sf_dir).select("user", "item"))


@query
def als_recommend(spark, sf_dir):
    return factorization.als_recommend(_factorized(spark, sf_dir), _asked(spark, sf_dir)).drop("num")


@query
def als_batch_predict(spark, sf_dir):
    return factorization.als_batch_predict(_factorized(spark, sf_dir), _asked(spark, sf_dir))


def _blend_model(spark, sf_dir, compat=False):
    engine = HybridEngine(EngineParams(algorithms=BLEND), compat=compat)
    return engine.fit(_ratings(spark, sf_dir))


@query
def hybrid_serve(spark, sf_dir):
    return _blend_model(spark, sf_dir).recommend(_asked(spark, sf_dir)).drop("num")


def _asked_default(spark, sf_dir):
    return _asked(spark, sf_dir).withColumn("num", F.lit(DEFAULT_NUM))


@query
def cf_nb_recommend_default(spark, sf_dir):
    """Default settings: five shared items, 150 neighbours, ten items a query."""
    return NaiveBayesHybrid().fit(_ratings(spark, sf_dir)).recommend(_asked_default(spark, sf_dir)).drop("num")


@query
def hybrid_serve_default(spark, sf_dir):
    """The blend with default settings, the top list with 300 items."""
    algorithms = (AlgorithmSpec("nb", NeighbourParams()), AlgorithmSpec("mv", PopularityParams()))
    model = HybridEngine(EngineParams(algorithms=algorithms)).fit(_ratings(spark, sf_dir))
    return model.recommend(_asked_default(spark, sf_dir)).drop("num")


@query
def hybrid_serve_mixed_num(spark, sf_dir):
    """Every user asks twice in one batch; each query gets the list it would get alone."""
    asked = _asked(spark, sf_dir)
    both = asked.withColumn("num", F.explode(F.array(*(F.lit(n) for n in MIXED_NUMS))))
    return _blend_model(spark, sf_dir).recommend(both)


@query
def hybrid_serve_compat(spark, sf_dir):
    blended = _blend_model(spark, sf_dir, compat=True).recommend(_asked(spark, sf_dir)).drop("num")
    return _labelled_numbers(blended, "score")


@query
def model_roundtrip(spark, sf_dir):
    """The blend again, from models saved and loaded."""
    path = fresh_path(spark, "model")
    _blend_model(spark, sf_dir).save(spark, path)
    return HybridModel.load(spark, path).recommend(_asked(spark, sf_dir)).drop("num")


@query
def hybrid_serve_all(spark, sf_dir):
    """All four recommenders blended, nested result."""
    algorithms = (
        AlgorithmSpec("nb", NEIGHBOURS),
        AlgorithmSpec("als", ALS_SETTINGS),
        AlgorithmSpec("prt", NEIGHBOURS),
        AlgorithmSpec("mv", POPULAR),
    )
    model = HybridEngine(EngineParams(algorithms=algorithms)).fit(_ratings(spark, sf_dir))
    return model.serve(_asked(spark, sf_dir))


# -- checks of fitted models, whose values have no SQL ---------------------


@query
def als_fit_check(spark, sf_dir):
    """Factors of every user and item, of full rank."""
    sizes = factorization.factors(_factorized(spark, sf_dir)).withColumn("size", F.size("features"))
    return sizes.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.min("size").alias("least"),
        F.max("size").alias("most"),
    )


@query
def als_solved_check(spark, sf_dir):
    """Per user, whether the factors solve the least-squares equations of the user's ratings."""
    fitted, latest = _factorized(spark, sf_dir), _latest(spark, sf_dir)
    rest = factorization.normal_equation_rest(fitted, latest, ALS_SETTINGS)
    return rest.select("user", "n_ratings", (F.col("rest") < 1e-3).alias("solved"))


@query
def als_lists_check(spark, sf_dir):
    """Per known user: length of the list, whether ranks run from one and follow the predictions, and shares add up."""
    fitted, asked = _factorized(spark, sf_dir), _asked(spark, sf_dir)
    shares = factorization.als_recommend(fitted, asked)
    raw = factorization.als_recommend(fitted, asked, normalize=False).select(
        "user", "item", "rank", F.col("score").alias("prediction")
    )
    pairs = factorization.score_pairs(fitted, raw.select("user", "item")).withColumnRenamed("score", "product")
    rows = raw.join(shares.select("user", "item", "score"), ["user", "item"]).join(pairs, ["user", "item"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "prediction")))
    falling = F.aggregate(
        ordered,
        F.struct(F.lit(True).alias("ok"), F.lit(float("inf")).alias("last")),
        lambda a, x: F.struct((a["ok"] & (x["prediction"] <= a["last"])).alias("ok"), x["prediction"].alias("last")),
    )["ok"]
    return rows.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("rank") == F.count(F.lit(1)) * (F.count(F.lit(1)) + 1) / 2).alias("ranks_ok"),
        falling.alias("order_ok"),
        (F.max(F.abs(F.col("prediction") - F.col("product"))) < 1e-4).alias("products_ok"),
        F.coalesce(F.abs(F.sum("score") - 1) < 1e-6, F.lit(True)).alias("shares_ok"),
    )


@query
def als_batch_check(spark, sf_dir):
    """Batch lists of customers and users of any event, unknown ones included, each asking twice.

    Per query: length of the list, distinct items in it, and places that differ from the ranked rows.
    """
    fitted = _factorized(spark, sf_dir)
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    asked = _asked(spark, sf_dir).select("user").union(customers).distinct()
    asked = asked.withColumn("num", F.explode(F.array(*(F.lit(n) for n in MIXED_NUMS))))
    lists = factorization.als_batch_predict(fitted, asked)
    placed = lists.select("user", "num", F.posexplode_outer("item_scores").alias("place", "entry"))
    placed = placed.select("user", "num", (F.col("place") + 1).alias("rank"), "entry.item", "entry.score")
    rows = factorization.als_recommend(fitted, asked, normalize=False)
    rows = rows.select("user", "num", "rank", F.col("item").alias("row_item"), F.col("score").alias("row_score"))
    both = placed.join(rows, ["user", "num", "rank"], "full")
    same = F.col("item").eqNullSafe(F.col("row_item")) & F.col("score").eqNullSafe(F.col("row_score"))
    return both.groupBy("user", "num").agg(
        F.count("item").alias("n"),
        F.count_distinct("item").alias("n_items"),
        F.count(F.when(~same, 1)).alias("n_different"),
    )


@query
def rf_lists_check(spark, sf_dir):
    """Per asked user: forest recommendations that are no candidates, or not predicted as liked; and whether shares add up."""
    model = ForestHybrid(NEIGHBOURS).fit(_ratings(spark, sf_dir))
    asked = _asked(spark, sf_dir)
    judged = classify.classify(model.classifier, model.neighbourhood.candidates(asked))
    fine = judged.where("prediction = 1").select("user", "item", F.lit(1).alias("fine"))
    rows = model.recommend(asked).join(fine, ["user", "item"], "left")
    found = rows.groupBy("user").agg(
        F.sum(F.when(F.col("fine").isNull(), 1).otherwise(0)).alias("outside"), F.sum("score").alias("total")
    )
    total_ok = F.coalesce(F.abs(F.col("total") - model.weight) < 1e-6, F.lit(True))
    return asked.join(found, "user", "left").select(
        "user", F.coalesce("outside", F.lit(0)).alias("outside"), total_ok.alias("total_ok")
    )


@query
def rf_classify_check(spark, sf_dir):
    """Rows that the forest judged, per label of the training rows, all judged zero or one."""
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    judged = classify.classify(classify.fit_forest(labeled), labeled)
    return judged.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").isin(0.0, 1.0)).alias("valid")
    )


@query
def rf_nodes_check(spark, sf_dir):
    """Per tree: training rows routed to a leaf by its nodes, liked ones, nodes that do not add up, and rows judged unlike the model."""
    labeled = rating_ops.labeled_ratings(_latest(spark, sf_dir))
    model = classify.fit_forest(labeled)
    nodes = classify.forest_nodes(model, spark)
    routed = classify.classify(model, classify.with_leaves(model, labeled))
    judged = F.when(F.col("liked_share") > 0.5, 1.0).otherwise(0.0)
    # half and half is up to the last bit of the model's own sum
    differs = (judged != F.col("prediction")) & (F.abs(F.col("liked_share") - 0.5) > 1e-12)
    ends = routed.select("label", differs.alias("differs"), F.posexplode("leaves").alias("tree", "node"))
    leaves = nodes.where("feature IS NULL").select("tree", "node")
    rows = ends.join(F.broadcast(leaves), ["tree", "node"]).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_liked"), F.count_if("differs").alias("n_different")
    )
    unsound = classify.unsound_nodes(nodes).groupBy("tree").agg(F.count(F.lit(1)).alias("n_unsound"))
    return rows.join(unsound, "tree", "left").withColumn("n_unsound", F.coalesce("n_unsound", F.lit(0)))


@query
def rf_lists_lengths(spark, sf_dir):
    """Per asked user: candidates of the forest hybrid, and items that its list lacks or has beyond the best accepted ones."""
    model = ForestHybrid(NEIGHBOURS).fit(_ratings(spark, sf_dir))
    asked = _asked(spark, sf_dir)
    judged = classify.classify(model.classifier, model.neighbourhood.candidates(asked))
    order = Window.partitionBy("user").orderBy((F.col("prediction") == 1.0).desc(), F.col("score").desc(), "item")
    place = F.row_number().over(order)
    best = judged.withColumn("place", place).where((F.col("prediction") == 1.0) & (F.col("place") <= NUM))
    listed = model.recommend(asked).select("user", "item", F.lit(1).alias("listed"))
    both = best.select("user", "item", F.lit(1).alias("wanted")).join(listed, ["user", "item"], "full")
    off = both.groupBy("user").agg(F.count_if(F.col("listed").isNull() | F.col("wanted").isNull()).alias("n_off"))
    sizes = judged.groupBy("user").agg(F.count(F.lit(1)).alias("n_candidates"))
    rows = asked.select("user").join(sizes, "user", "left").join(off, "user", "left")
    return rows.select("user", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_off")))


@query
def model_summaries(spark, sf_dir):
    """Sizes and settings of all four fitted recommenders."""
    algorithms = (
        AlgorithmSpec("nb", NEIGHBOURS),
        AlgorithmSpec("als", ALS_SETTINGS),
        AlgorithmSpec("prt", NEIGHBOURS),
        AlgorithmSpec("mv", POPULAR),
    )
    return HybridEngine(EngineParams(algorithms=algorithms)).fit(_ratings(spark, sf_dir)).summary()


@query
def stored_models_check(spark, sf_dir):
    """All four recommenders give the same lists after saving and loading: rows that differ, per recommender."""
    algorithms = (
        AlgorithmSpec("nb", NEIGHBOURS),
        AlgorithmSpec("als", ALS_SETTINGS),
        AlgorithmSpec("prt", NEIGHBOURS),
        AlgorithmSpec("mv", POPULAR),
    )
    model = HybridEngine(EngineParams(algorithms=algorithms)).fit(_ratings(spark, sf_dir))
    path, asked = fresh_path(spark, "models"), _asked(spark, sf_dir)
    model.save(spark, path)
    parts = None
    for (name, before), (_, after) in zip(model.parts, HybridModel.load(spark, path).parts):
        one, two = before.recommend(asked), after.recommend(asked)
        differ = one.exceptAll(two).unionByName(two.exceptAll(one))
        row = differ.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("differ"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


# -- evaluation ------------------------------------------------------------


@query
def kfold_split(spark, sf_dir):
    return evaluation.kfold_split(_ratings(spark, sf_dir), FOLDS.k_fold)


@query
def order_kfold_split(spark, sf_dir):
    return evaluation.kfold_split(_order_ratings(spark, sf_dir), EvalParams().k_fold)


@query
def eval_ground_truth(spark, sf_dir):
    return evaluation.eval_ground_truth(evaluation.with_folds(_ratings(spark, sf_dir), FOLDS.k_fold), FOLDS.query_num)


@query
def eval_ground_truth_lists(spark, sf_dir):
    """Every query with its held-out ratings as text, in parts of about four so that parts occur."""
    folded = evaluation.with_folds(_ratings(spark, sf_dir), FOLDS.k_fold)
    lists = evaluation.held_out_lists(folded, FOLDS.query_num, part_size=4)
    rating = lambda r: F.concat_ws(":", r["event_id"].cast("string"), r["item"].cast("string"), F.round(r["rating"], 6).cast("decimal(20,6)").cast("string"))
    return lists.withColumn("ratings", F.concat_ws(",", F.transform("ratings", rating)))


def _popular_hits(spark, sf_dir, max_items):
    algorithms = (AlgorithmSpec("mv", PopularityParams(max_items)),)
    return cross_validate(_ratings(spark, sf_dir), algorithms, FOLDS)


@query
def precision_at_k(spark, sf_dir):
    rows = evaluation.precision_recall(_popular_hits(spark, sf_dir, POPULAR.max_items))
    return rows.select("fold", "n_queries", "n_scored", "precision")


@query
def recall_at_k(spark, sf_dir):
    rows = evaluation.precision_recall(_popular_hits(spark, sf_dir, POPULAR.max_items))
    return rows.select("fold", "n_queries", "recall")


@query
def precision_at_k_compat(spark, sf_dir):
    """A top list of two leaves users who saw both without recommendations."""
    rows = evaluation.precision_recall(_popular_hits(spark, sf_dir, 2), compat=True)
    return _labelled_numbers(rows.select("fold", "n_queries", "precision"), "precision")


@query
def precision_at_k_compat_lists(spark, sf_dir):
    """Lists and precision both of the compat mode: pruned per fold, seen items kept."""
    algorithms = (AlgorithmSpec("mv", PopularityParams(POPULAR.max_items)),)
    hits = cross_validate(_ratings(spark, sf_dir), algorithms, FOLDS, compat=True)
    rows = evaluation.precision_recall(hits, compat=True)
    return _labelled_numbers(rows.select("fold", "n_queries", "precision", "recall"), "precision")


@query
def precision_unscored(spark, sf_dir):
    """The same by default: such users stay out of the mean."""
    rows = evaluation.precision_recall(_popular_hits(spark, sf_dir, 2))
    return rows.select("fold", "n_queries", "n_scored", "precision", "recall")


@query
def param_sweep_popularity(spark, sf_dir):
    settings = [(AlgorithmSpec("mv", PopularityParams(n)),) for n in SWEEP_ITEMS]
    return param_sweep(_ratings(spark, sf_dir), settings, FOLDS).drop("params")


@query
def fold_neighbours(spark, sf_dir):
    """Similar users in the training part of every fold, for two settings, from one search."""
    values = folds.training_values(evaluation.with_folds(_ratings(spark, sf_dir), FOLDS.k_fold), FOLDS.k_fold)
    return _rounded(folds.fold_neighbours(values, FOLDS.k_fold, FOLD_TOPS), "similarity")


@query
def precision_at_k_hybrid(spark, sf_dir):
    """The naive Bayes hybrid in every fold."""
    hits = cross_validate(_ratings(spark, sf_dir), (AlgorithmSpec("nb", NEIGHBOURS),), FOLDS)
    return evaluation.precision_recall(hits)


@query
def precision_at_k_blend(spark, sf_dir):
    """The blend of hybrid and popularity in every fold."""
    return evaluation.precision_recall(cross_validate(_ratings(spark, sf_dir), BLEND, FOLDS))


@query
def param_sweep_neighbours(spark, sf_dir):
    """Hybrids of several settings beside popularity, ten folds and ten items; all come from one search."""
    settings = [(AlgorithmSpec("nb", NeighbourParams(*s)),) for s in SWEEP_NEIGHBOURS]
    settings.append((AlgorithmSpec("mv", PopularityParams()),))
    return param_sweep(_ratings(spark, sf_dir), settings, EvalParams()).drop("params")


@query
def param_sweep_engines(spark, sf_dir):
    """Factorisation, forest hybrid and popularity compared: the default sweep, ten folds and ten items."""
    return param_sweep(_ratings(spark, sf_dir), DEFAULT_SWEEP, EvalParams())


# two queries share their names with imported functions
QUERIES["dataset_summary"] = QUERIES.pop("dataset_summary_rows")
QUERIES["param_sweep"] = QUERIES.pop("param_sweep_popularity")
