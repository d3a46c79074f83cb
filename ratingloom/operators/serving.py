"""Blending the lists of several recommenders into one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import id_order, top_k
from ratingloom.functions.scoring import SCORE_DECIMALS
from ratingloom.operators.requests import Requests, most_asked


def blend(
    recommendations: Sequence[DataFrame], queries: DataFrame | Requests, by: Sequence[str] = ()
) -> DataFrame:
    """Sum the scores per query and item and keep the best ``num`` of each query.

    A query is a ``(user, num)``, per ``by``; one user may ask several times.
    """
    query = [*by, "user", "num"]
    parts = [r.select(*query, "item", "score") for r in recommendations]
    merged = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*query, "item")
        .agg(F.round(F.sum("score"), SCORE_DECIMALS).alias("score"))
    )
    order = [F.col("score").desc(), *id_order(merged, "item")]
    best = top_k(merged, query, order, most_asked(queries))
    return best.filter(F.col("rank") <= F.col("num")).select(*query, "item", "score", "rank")


def as_results(recommendations: DataFrame, queries: DataFrame) -> DataFrame:
    """Nested form: per query the ordered array of ``(item, score)``.

    Lists hold at most ``num`` items; queries without any get an empty one.
    """
    lists = recommendations.groupBy("user", "num").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("ranked")
    )
    scores = F.transform("ranked", lambda s: F.struct(s["item"].alias("item"), s["score"].alias("score")))
    return queries.join(lists, ["user", "num"], "left").select(
        *queries.columns, F.coalesce(scores, F.array()).alias("item_scores")
    )
