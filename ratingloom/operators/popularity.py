"""Most-viewed items, and those of them a user has not seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions import id_order, top_k
from ratingloom.functions.scoring import SCORE_DECIMALS
from ratingloom.operators.ratings import item_view_counts
from ratingloom.session import BROADCAST_ROW_BOUND, write_shared


def prune_threshold(counts: DataFrame, max_items: int) -> float | None:
    """Views an item must exceed after repeated above-the-mean pruning.

    A pass keeps items viewed more than the mean of those left, while more
    than ``2 * max_items`` are left. The means only grow, so the state is one
    number. Passes run on the histogram of view counts, which has far fewer
    rows than there are items.
    """
    histogram = counts.groupBy("views").agg(F.count(F.lit(1)).alias("items")).persist()
    try:
        threshold = None
        while True:
            left = histogram if threshold is None else histogram.filter(F.col("views") > F.lit(threshold))
            row = left.agg(
                F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
                F.sum(F.col("items") * F.col("views")).alias("views"),
            ).first()
            if row["items"] <= 2 * max_items:
                return threshold
            threshold = row["views"] / row["items"]
    finally:
        histogram.unpersist()


def popularity_mean_prune(counts: DataFrame, max_items: int) -> DataFrame:
    """Items left by the pruning; none where all are viewed equally often.

    The counts are stored first, so that the ratings are counted once.
    """
    counts = write_shared(counts, "views")
    threshold = prune_threshold(counts, max_items)
    return counts if threshold is None else counts.filter(F.col("views") > F.lit(threshold))


def most_viewed(counts: DataFrame, max_items: int, by: Sequence[str] = ()) -> DataFrame:
    """Top ``max_items`` items by views with their rank, per ``by`` group."""
    order = [F.col("views").desc(), *id_order(counts, "item")]
    if by:
        return top_k(counts, by, order, max_items).select(*by, "item", "views", "rank")
    # TakeOrdered keeps max_items rows per task; only those are numbered
    best = counts.orderBy(*order).limit(max_items)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("item", "views", "rank")


def popular_unseen(
    queries: DataFrame,
    top: DataFrame,
    seen: DataFrame | None,
    max_items: int,
    by: Sequence[str] = (),
    groups: int = 1,
    weight: float = 1.0,
    compat: bool = False,
) -> DataFrame:
    """First ``num`` items of the top list each queried user has not seen, per ``(user, num)``.

    ``queries`` has ``(user, num)``, ``seen`` ``(user, item)`` and ``top`` the
    ranked list, one for each of the ``groups`` values of ``by``. The seen
    items become a set of at most ``max_items`` ranks per user; the free ranks
    follow from it, so queries are never paired with the whole list. Users
    without history get the head of the list.

    ``compat`` recommends seen items again and scores with integer division.
    """
    keys = ["user", *by]
    small = F.broadcast(top) if max_items * groups <= BROADCAST_ROW_BOUND else top
    asked = queries.select(*keys, "num").distinct()
    wanted = asked.select(*keys).distinct()
    all_ranks = F.sequence(F.lit(1), F.lit(max_items))
    if compat:
        free = wanted.withColumn("free", all_ranks)
    else:
        taken = (
            seen.select(*keys, "item")
            .join(small.select(*by, "item", "rank"), [*by, "item"])
            .groupBy(*keys)
            .agg(F.collect_set("rank").alias("taken"))
        )
        none = F.array().cast("array<int>")
        free = wanted.join(taken, keys, "left").withColumn(
            "free", F.array_except(all_ranks, F.coalesce("taken", none))
        )
    picks = free.join(asked, keys).select(
        *keys, "num", F.posexplode(F.slice("free", F.lit(1), F.col("num"))).alias("place", "top_rank")
    )
    listed = small.select(*by, "item", "views", F.col("rank").alias("top_rank"))
    total = F.sum("views").over(Window.partitionBy(*keys, "num"))
    part = F.expr("views div total").cast("double") if compat else F.try_divide("views", "total")
    return (
        picks.join(listed, [*by, "top_rank"])
        .withColumn("total", total)
        .select(
            *keys,
            "num",
            "item",
            F.round(part * F.lit(weight), SCORE_DECIMALS).alias("score"),
            (F.col("place") + 1).alias("rank"),
        )
    )


def item_views_top(ratings: DataFrame, max_items: int, pruned: bool = False) -> DataFrame:
    """Top list straight from ratings; ``pruned`` applies the mean pruning first."""
    counts = item_view_counts(ratings)
    if pruned:
        counts = popularity_mean_prune(counts, max_items)
    return most_viewed(counts, max_items)
