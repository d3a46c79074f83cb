"""Per-rating, per-user and per-item steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions import id_order, md5_part, top_k
from ratingloom.functions.scoring import SCORE_DECIMALS
from ratingloom.session import write_shared


def prepare(ratings: DataFrame, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hook between reading and training; does nothing unless given a step."""
    return ratings.transform(step) if step else ratings


def require_ratings(ratings: DataFrame) -> DataFrame:
    if ratings.isEmpty():
        raise ValueError("the ratings are empty; check the source and its event filter")
    return ratings


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """Last rating per user and item; partial aggregation collapses hot pairs."""
    last = F.max(F.struct("ts", "event_id", "rating"))
    return (
        ratings.groupBy("user", "item")
        .agg(last.alias("last"))
        .select("user", "item", "last.rating", "last.ts", "last.event_id")
    )


class TrainingData:
    """Rating events, and their latest per user and item.

    Several training steps read the latest ratings, so they are stored once,
    when first asked for.
    """

    def __init__(self, events: DataFrame):
        self.events = events
        self._latest: DataFrame | None = None

    @property
    def latest(self) -> DataFrame:
        if self._latest is None:
            self._latest = write_shared(latest_ratings(self.events), "latest")
        return self._latest

    def rated(self, compat: bool) -> DataFrame:
        """What means, likes and labels count: ``compat`` counts re-ratings too."""
        return self.events if compat else self.latest


def user_rating_stats(ratings: DataFrame) -> DataFrame:
    """Count, mean, least and greatest rating per user."""
    return ratings.groupBy("user").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.round(F.avg("rating"), SCORE_DECIMALS).alias("mean_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
    )


def user_means(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean per user (and ``by``), rounded so that a rating equal to the mean stays equal
    to it whatever order the parts were summed in."""
    return ratings.groupBy(*by, "user").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.round(F.avg("rating"), SCORE_DECIMALS).alias("mean_rating"),
    )


def with_user_mean(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``n_ratings`` and ``mean_rating``.

    An aggregate joined back, not a window: a user with a large part of all
    rows is combined map-side and split in the join.
    """
    return ratings.join(user_means(ratings, by), [*by, "user"])


def user_history(ratings: DataFrame, items_per_row: int = 1000) -> DataFrame:
    """Items each user rated, as sorted lists.

    Histories longer than ``items_per_row`` go over several rows ``part``
    (about equal in size), so no list grows with the data.
    """
    pairs = ratings.select("user", "item").distinct()
    sizes = pairs.groupBy("user").agg(F.count(F.lit(1)).alias("history_size"))
    parts = F.ceil(F.col("history_size") / F.lit(items_per_row)).cast("bigint")
    placed = pairs.join(sizes, "user").withColumn("part", md5_part("item", parts))
    return placed.groupBy("user", "part", "history_size").agg(F.array_sort(F.collect_list("item")).alias("items"))


def item_view_counts(ratings: DataFrame) -> DataFrame:
    """Events per item; repeats by one user count."""
    return ratings.groupBy("item").agg(F.count(F.lit(1)).alias("views"))


def labeled_ratings(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Label 1 where the rating is strictly above its user's mean, else 0."""
    liked = (F.col("rating") > F.col("mean_rating")).cast("double")
    return with_user_mean(ratings, by).select(*by, "user", "item", "rating", liked.alias("label"))


def user_likes(ratings: DataFrame, top_n: int, by: Sequence[str] = ()) -> DataFrame:
    """Best-rated ``top_n`` items above the user's own mean.

    Users with fewer than ``top_n`` ratings keep all of them, as liked.
    """
    kept = with_user_mean(ratings, by).filter(
        (F.col("n_ratings") < top_n) | (F.col("rating") > F.col("mean_rating"))
    )
    order = [F.col("rating").desc(), *id_order(ratings, "item")]
    return top_k(kept, [*by, "user"], order, top_n).select(*by, "user", "item", "rating", "rank")


def preference_coefficient(ratings: DataFrame) -> DataFrame:
    """(mean - least) / (greatest - least) of each user's ratings."""
    spread = F.col("max_rating") - F.col("min_rating")
    return user_rating_stats(ratings).select(
        "user",
        F.try_divide(F.col("mean_rating") - F.col("min_rating"), spread).alias("preference"),
    )


def mean_centered_ratings(ratings: DataFrame, midpoint: float = 2.5) -> DataFrame:
    """Shift each user's ratings so that their mean becomes ``midpoint``."""
    shifted = F.col("rating") + (F.lit(midpoint) - F.col("mean_rating"))
    return with_user_mean(ratings).select("user", "item", "rating", shifted.alias("centered"))


def recent_items(ratings: DataFrame, num: int) -> DataFrame:
    """The ``num`` items each user rated last, newest first."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return top_k(latest_ratings(ratings), ["user"], order, num).select("user", "item", "rank")


def id_index(ids: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """Dense ids ``0..n-1`` for the distinct values of a column.

    Values are numbered inside hash buckets; each bucket starts after the
    sizes of those before it. Only the ``buckets`` sizes meet in one task.
    """
    values = ids.select(F.col(column).alias("id")).filter(F.col("id").isNotNull()).distinct()
    values = values.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = values.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    in_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    return (
        values.withColumn("place", in_bucket)
        .join(F.broadcast(starts), "bucket")
        .select("id", (F.col("start") + F.col("place")).cast("int").alias("idx"))
    )
