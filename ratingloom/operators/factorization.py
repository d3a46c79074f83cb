"""Matrix factorisation (ALS) with string or integer ids."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.ml.recommendation import ALSModel as SparkALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions import id_order, share, top_k
from ratingloom.functions.scoring import SCORE_DECIMALS
from ratingloom.operators.ratings import id_index, require_ratings
from ratingloom.operators.requests import Requests, requests_of
from ratingloom.params import ALSParams
from ratingloom.session import shared_folder, write_shared


@dataclass(frozen=True)
class Factorization:
    """Fitted factors and the dictionaries ``(id, idx)`` of both sides."""

    model: SparkALSModel
    users: DataFrame
    items: DataFrame


def indexed_ratings(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Replace ids by dense integers."""
    return (
        ratings.join(users.select(F.col("id").alias("user"), F.col("idx").alias("user_idx")), "user")
        .join(items.select(F.col("id").alias("item"), F.col("idx").alias("item_idx")), "item")
        .select("user_idx", "item_idx", F.col("rating").cast("float").alias("rating"))
    )


def automatic_blocks(ratings: DataFrame, rows_per_block: int = 2_000_000) -> int:
    """Blocks of factors: one for each task slot, and more once the ratings of a block grow large."""
    slots = ratings.sparkSession.sparkContext.defaultParallelism
    return max(slots, -(-ratings.count() // rows_per_block))


def fit_als(ratings: DataFrame, params: ALSParams = ALSParams()) -> Factorization:
    """Explicit ALS; factors are checkpointed every tenth iteration."""
    if params.num_iterations > 30:
        warnings.warn(
            f"num_iterations > 30 ({params.num_iterations}): the lineage of ALS grows with each iteration",
            stacklevel=2,
        )
    require_ratings(ratings)
    shared_folder(ratings.sparkSession)  # ALS checkpoints only if a folder is set
    users = write_shared(id_index(ratings, "user"), "users")
    items = write_shared(id_index(ratings, "item"), "items")
    rows = indexed_ratings(ratings, users, items)
    blocks = automatic_blocks(ratings)
    als = ALS(
        rank=params.rank,
        maxIter=params.num_iterations,
        regParam=params.reg,
        seed=params.seed,
        implicitPrefs=False,
        alpha=1.0,
        checkpointInterval=10,
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="rating",
        coldStartStrategy="drop",
        numUserBlocks=params.user_blocks or blocks,
        numItemBlocks=params.item_blocks or blocks,
    )
    return Factorization(als.fit(rows), users, items)


def factors(fitted: Factorization) -> DataFrame:
    """Factor vectors with the original ids."""
    sides = (("user", fitted.model.userFactors, fitted.users), ("item", fitted.model.itemFactors, fitted.items))
    parts = [
        vectors.join(ids.select(F.col("id").cast("string").alias("name"), "idx"), vectors["id"] == F.col("idx"))
        .select(F.lit(side).alias("side"), F.col("name").alias("id"), "features")
        for side, vectors, ids in sides
    ]
    return parts[0].unionByName(parts[1])


def score_pairs(fitted: Factorization, pairs: DataFrame) -> DataFrame:
    """Predicted rating of given ``(user, item)`` pairs; unknown ids drop out."""
    indexed = pairs.join(
        fitted.users.select(F.col("id").alias("user"), F.col("idx").alias("user_idx")), "user"
    ).join(fitted.items.select(F.col("id").alias("item"), F.col("idx").alias("item_idx")), "item")
    return fitted.model.transform(indexed).select("user", "item", F.col("prediction").alias("score"))


def normal_equation_rest(fitted: Factorization, ratings: DataFrame, params: ALSParams) -> DataFrame:
    """How far each user's factors are from solving their regularised least squares: ``(user, n_ratings, rest)``.

    ``rest`` is the largest component of the gradient against the largest of
    the right-hand side. Users are solved last, so theirs are near zero.
    """
    model = fitted.model
    rows = indexed_ratings(ratings, fitted.users, fitted.items)
    rows = rows.join(model.userFactors.select(F.col("id").alias("user_idx"), F.col("features").alias("x")), "user_idx")
    rows = rows.join(model.itemFactors.select(F.col("id").alias("item_idx"), F.col("features").alias("y")), "item_idx")
    product = F.aggregate(
        F.zip_with("x", "y", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda total, v: total + v
    )
    each = rows.withColumn("error", product - F.col("rating")).select(
        "user_idx", "rating", "error", "x", F.posexplode("y").alias("k", "y")
    )
    sums = each.groupBy("user_idx", "k").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.sum(F.col("error") * F.col("y")).alias("slope"),
        F.sum(F.col("rating") * F.col("y")).alias("right"),
        F.first(F.get("x", F.col("k"))).alias("own"),
    )
    gradient = F.abs(F.col("slope") + F.lit(params.reg) * F.col("n_ratings") * F.col("own"))
    rest = sums.groupBy("user_idx").agg(
        F.max("n_ratings").alias("n_ratings"),
        (F.max(gradient) / F.greatest(F.max(F.abs("right")), F.lit(1e-9))).alias("rest"),
    )
    users = fitted.users.select(F.col("id").alias("user"), F.col("idx").alias("user_idx"))
    return rest.join(users, "user_idx").select("user", "n_ratings", "rest")


def als_recommend(fitted: Factorization, queries: DataFrame | Requests, normalize: bool = True) -> DataFrame:
    """Top ``num`` items per known queried user; seen items are not left out.

    The factor product is blocked and keeps only the best per user. Scores are
    shares of the returned list, or raw predictions. Predictions are unbounded,
    and shares of a total that is not positive would turn the order round: such
    lists have null shares, which add nothing to a blend, and a warning in
    ``shareless_queries``. The rank follows the predictions.
    """
    requests = requests_of(queries)
    wanted = requests.rows.select("user").distinct()
    known = wanted.join(fitted.users.select(F.col("id").alias("user"), "idx"), "user")
    longest = max(requests.most, 1)
    user_idx = fitted.model.getUserCol()
    lists = fitted.model.recommendForUserSubset(known.select(F.col("idx").alias(user_idx)), longest)
    scored = (
        lists.select(F.col(user_idx).alias("idx"), F.explode("recommendations").alias("r"))
        .select("idx", F.col("r.item_idx").alias("item_idx"), F.col("r.rating").cast("double").alias("score"))
        .join(known, "idx")
        .join(fitted.items.select(F.col("id").alias("item"), F.col("idx").alias("item_idx")), "item_idx")
    )
    order = [F.col("score").desc(), *id_order(scored, "item")]
    ranked = top_k(scored, ["user"], order, longest)
    best = ranked.join(requests.rows, "user").filter(F.col("rank") <= F.col("num"))
    total = F.sum("score").over(Window.partitionBy("user", "num"))
    parts = F.when(total > 0, F.round(share(F.col("score"), ["user", "num"]), SCORE_DECIMALS))
    return best.select("user", "num", "item", (parts if normalize else F.col("score")).alias("score"), "rank")


def shareless_queries(recommended: DataFrame) -> DataFrame:
    """Queries whose predictions add up to zero or less, so that they have no shares."""
    return recommended.filter(F.col("score").isNull()).select("user", "num").distinct()


def als_batch_predict(fitted: Factorization, queries: DataFrame, normalize: bool = False) -> DataFrame:
    """One row per query with its ordered item list, empty for unknown users."""
    rows = als_recommend(fitted, queries.select("user", "num"), normalize)
    lists = rows.groupBy("user", "num").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("ranked")
    )
    joined = queries.join(lists, ["user", "num"], "left")
    scores = F.transform("ranked", lambda s: F.struct(s["item"].alias("item"), s["score"].alias("score")))
    return joined.select(*queries.columns, F.coalesce(scores, F.array()).alias("item_scores"))
