"""Similar users from the items they rated in common.

Two users are compared only if they share ``min_common`` items, and the join
makes use of it. Order all items by popularity. Of every user, set apart the
``min_common - 1`` most popular items (the user's *tail*); the rest is the
user's *body*. A pair that shares ``min_common`` items must share one that is
in both bodies: the least popular shared item has ``min_common - 1`` more
popular shared items beside it in either history. So

* raters of an item who all hold it in their tail are never paired with each
  other. That is what happens to an item that nearly everybody rated, and to
  users with few ratings;
* the join emits body/body and body/tail meetings, which also carry the sums;
* tail/tail meetings are at most ``min_common - 1`` per pair and are added
  from the two short tail arrays once the pair is known to be a candidate.

Items with many raters are cut into slots of ``raters_per_slot`` raters, and
every two slots of an item are a join group of their own, so a hot item is
spread over many tasks. The sums are combined map-side before the shuffle by
pair. No candidate is dropped or sampled. Where users meet over most items even
so, :mod:`~ratingloom.operators.block_product` gives the same pairs without that shuffle.

All sums are sums of integers: ratings are put on a grid (:class:`Grid`), for
decimal ratings that of their last decimal. So a sum is the same whatever
order executors add it up in, variances are zero or not without doubt, and
similarities are ranked at full precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.functions import hash_slot, id_order, top_k
from ratingloom.functions.ids import has_numeric_ids, id_precedes, user_hash
from ratingloom.operators.block_product import Packed, packed_blocks, pairs_of_product, worth_a_product
from ratingloom.operators.ratings import latest_ratings, user_means
from ratingloom.operators.sums import EXACT, cosine, pearson
from ratingloom.params import NeighbourParams
from ratingloom.session import write_shared

#: Ratings on the grid stay below this, their products fit a long.
GRID_BOUND = 1 << 30
#: Decimals that ratings may have to be on the grid as they are.
GRID_DECIMALS = 6

MEETINGS_PER_TASK = 2_000_000
MAX_JOIN_TASKS = 200_000


@dataclass(frozen=True)
class Grid:
    """Integers for ratings: ``rating * scale``, rounded.

    ``exact`` ratings are decimal fractions that lose nothing; others keep 30 bits. With ``wide``, sums
    over shared items may outgrow a long and are decimals.
    """

    scale: float
    exact: bool
    wide: bool

    def of(self, rating: Column) -> Column:
        return F.rint(rating * F.lit(self.scale)).cast("bigint")

    def total(self, value: Column) -> Column:
        return F.sum(self.number(value))

    def number(self, value: Column) -> Column:
        return value.cast("decimal(38,0)") if self.wide else value


def rating_grid(rows: DataFrame, center: bool) -> Grid:
    """The coarsest decimal grid that holds all ratings of ``rows``, or else one of 30 bits."""
    rating = F.col("rating")

    def fits(decimals: int) -> Column:
        scaled = rating * F.lit(10.0**decimals)
        return F.bool_and(F.abs(scaled - F.rint(scaled)) <= F.lit(1e-9) * F.greatest(F.abs(scaled), F.lit(1.0)))

    found = rows.agg(
        F.max(F.abs(rating)).alias("most"),
        (F.max(rating) - F.min(rating)).alias("span"),
        F.max("n_ratings").alias("items"),
        *(fits(d).alias(f"d{d}") for d in range(GRID_DECIMALS + 1)),
    ).first()
    most = found["most"] or 1.0
    scales = [10.0**d for d in range(GRID_DECIMALS + 1) if found[f"d{d}"] and most * 10.0**d <= GRID_BOUND]
    scale = scales[0] if scales else 2.0 ** math.floor(math.log2(GRID_BOUND / most))
    largest = (found["span"] if center else most) or 0.0
    wide = ((largest * scale + 1) * (found["items"] or 0)) ** 2 >= 2.0**62
    return Grid(scale, bool(scales), wide)


def small_sums(rows: DataFrame, grid: Grid, times: int = 1, center: bool = True) -> bool:
    """Whether ``times`` the sums of any pair stay exact in doubles, and their products in longs."""
    if grid.wide:
        return False
    rating = F.col("rating")
    largest = F.max(rating) - F.min(rating) if center else F.max(F.abs(rating))
    largest, items = rows.agg(largest, F.max("n_ratings")).first()
    return ((largest or 0.0) * grid.scale + 1) ** 2 * (items or 0) * times < EXACT


def stored_latest(ratings: DataFrame) -> DataFrame:
    """The latest ratings, stored: users, items and ratings are counted, and the events are read once for all of it."""
    return write_shared(latest_ratings(ratings).select("user", "item", "rating"), "latest")


def _comparable_ratings(latest: DataFrame, min_common: int, *carry: str) -> DataFrame:
    """Ratings that can take part in a pair: ``(user, item, rating, mean_rating, n_ratings, raters)``.

    Users with fewer than ``min_common`` items and items with one rater are left out.
    """
    latest = latest.select("user", "item", "rating", *carry)
    active = user_means(latest).filter(F.col("n_ratings") >= min_common)
    rows = latest.join(active, "user")
    raters = rows.groupBy("item").agg(F.count(F.lit(1)).alias("raters")).filter(F.col("raters") > 1)
    return rows.join(raters, "item").select("user", "item", "rating", *carry, "mean_rating", "n_ratings", "raters")


def _on_grid(rows: DataFrame, grid: Grid, center: bool) -> DataFrame:
    """``(user, item, x, raters)``; ``x`` is the rating on the grid, less its user's mean with ``center``.

    That leaves Pearson unchanged and keeps the sums small.
    """
    x = grid.of(F.col("rating"))
    x = x - grid.of(F.col("mean_rating")) if center else x
    return rows.select("user", "item", x.alias("x"), "raters")


def _tails(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` most popular items of each user as one short array."""
    order = [F.col("raters").desc(), *id_order(rows, "item")]
    return top_k(rows, ["user"], order, size).groupBy("user").agg(
        F.collect_list(F.struct("item", "x")).alias("tail")
    )


def _placed_ratings(rows: DataFrame, tails: DataFrame | None, raters_per_slot: int) -> DataFrame:
    """Ratings with the sort order of their user, their part (tail or body) and slot.

    ``(user, item, x, h, in_tail, slot, body_slots, tail_slots, body_raters,
    tail_raters)``; items without a pair to form are left out.
    """
    if tails is None:
        marked = rows.withColumn("in_tail", F.lit(False))
    else:
        tail_items = F.transform("tail", lambda s: s["item"])
        in_tail = F.coalesce(F.array_contains(tail_items, F.col("item")), F.lit(False))
        marked = rows.join(tails, "user").select("user", "item", "x", in_tail.alias("in_tail"))
    parts = (
        marked.groupBy("item")
        .agg(F.count_if(~F.col("in_tail")).alias("body_raters"), F.count_if("in_tail").alias("tail_raters"))
        .filter((F.col("body_raters") > 0) & (F.col("body_raters") + F.col("tail_raters") > 1))
        .withColumn("body_slots", F.ceil(F.col("body_raters") / F.lit(raters_per_slot)).cast("int"))
        .withColumn("tail_slots", F.ceil(F.col("tail_raters") / F.lit(raters_per_slot)).cast("int"))
    )
    slots = F.when(F.col("in_tail"), F.col("tail_slots")).otherwise(F.col("body_slots"))
    return (
        marked.join(parts, "item")
        .withColumn("h", user_hash("user"))
        .withColumn("slot", hash_slot(F.col("h"), slots))
    )


def _join_tasks(placed: DataFrame) -> int:
    """Number of join tasks, from the meetings they produce.

    Input bytes say little about the work of a self-join.
    """
    meetings = _number_of_meetings(placed)
    least = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, math.ceil(meetings / MEETINGS_PER_TASK)), MAX_JOIN_TASKS)


def _number_of_meetings(placed: DataFrame) -> float:
    per_body = (F.col("body_raters") - 1) / 2 + F.col("tail_raters")
    return placed.filter(~F.col("in_tail")).agg(F.sum(per_body)).first()[0] or 0


def _most_set_apart(rows: DataFrame, ratings: int) -> float:
    """The most meetings that so many ratings can have among themselves: those of the items with most raters.

    Items are counted by their number of raters, of which there are few: so many different ones need half the square in ratings.
    """
    items = rows.groupBy("raters").agg((F.count(F.lit(1)) / F.col("raters")).cast("bigint").alias("items"))
    met = 0.0
    for raters, n in sorted((tuple(r) for r in items.collect()), reverse=True):
        whole = min(n, ratings // raters)
        met += whole * raters * (raters - 1) / 2
        ratings -= whole * raters
        if whole < n:
            return met + ratings * (ratings - 1) / 2
    return met


def many_meetings(rows: DataFrame, params: NeighbourParams) -> bool:
    """Whether users of comparable ratings meet so often over items that a product of blocks costs less."""
    users, most = rows.agg(F.count_distinct("user"), F.sum((F.col("raters") - 1) / 2)).first()
    if not worth_a_product(most or 0, users):
        return False
    if worth_a_product(most - _most_set_apart(rows, users * (params.min_common - 1)), users):
        return True
    plain = rows.select("user", "item", F.lit(0).alias("x"), "raters")
    tails = _tails(plain, params.min_common - 1) if params.min_common > 1 else None
    return worth_a_product(_number_of_meetings(_placed_ratings(plain, tails, params.raters_per_slot)), users)


def _meetings(placed: DataFrame, tasks: int) -> DataFrame:
    """Co-ratings ``(a, b, x, y, bodies)``, each unordered pair and item once.

    Every two body slots of an item, and every body and tail slot, are one
    join group. Users are ordered by hash and body slots follow that order, so
    the lower slot holds the first user of a pair.
    """
    slot, body_slots, tail_slots = F.col("slot"), F.col("body_slots"), F.col("tail_slots")

    def cells(with_tail: bool, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(with_tail).alias("with_tail"), lo.alias("lo"), hi.alias("hi"))

    up = F.transform(F.sequence(slot, body_slots - 1), lambda i: cells(False, slot, i))
    down = F.transform(F.sequence(F.lit(0), slot), lambda i: cells(False, i, slot))
    empty = F.filter(up, lambda _: F.lit(False))
    beside_tails = F.when(
        tail_slots > 0, F.transform(F.sequence(F.lit(0), tail_slots - 1), lambda i: cells(True, slot, i))
    ).otherwise(empty)
    beside_bodies = F.transform(F.sequence(F.lit(0), body_slots - 1), lambda i: cells(True, i, slot))

    keys = ["item", "with_tail", "lo", "hi"]
    # an explicit number keeps adaptive planning from merging these partitions
    first = (
        placed.filter(~F.col("in_tail"))
        .select("item", F.inline(F.concat(up, beside_tails)), F.col("h").alias("ha"), F.col("user").alias("a"), "x")
        .repartition(tasks, *keys)
    )
    second = placed.select(
        "item",
        F.inline(F.when(F.col("in_tail"), beside_bodies).otherwise(down)),
        F.col("h").alias("hb"),
        F.col("user").alias("b"),
        F.col("x").alias("y"),
    ).repartition(tasks, *keys)
    ordered = (F.col("ha") < F.col("hb")) | ((F.col("ha") == F.col("hb")) & (F.col("a") < F.col("b")))
    # never broadcast: the size estimate knows nothing of the copies per slot
    met = first.join(second.hint("merge"), keys).filter(F.col("with_tail") | ordered)

    def oriented(one: str, other: str) -> Column:
        return F.when(ordered, F.col(one)).otherwise(F.col(other))

    return met.select(
        oriented("a", "b").alias("a"),
        oriented("b", "a").alias("b"),
        oriented("x", "y").alias("x"),
        oriented("y", "x").alias("y"),
        (~F.col("with_tail")).alias("bodies"),
    )


def _with_tail_meetings(pairs: DataFrame, tails: DataFrame, grid: Grid) -> DataFrame:
    """Add the items that both users of a pair hold in their tails."""

    def total(common: Column, value) -> Column:
        zero = grid.number(F.lit(0).cast("bigint"))
        return F.aggregate(common, zero, lambda acc, s: (acc + grid.number(value(s))).cast("decimal(38,0)" if grid.wide else "bigint"))

    joined = pairs.join(tails.select(F.col("user").alias("a"), F.col("tail").alias("ta")), "a").join(
        tails.select(F.col("user").alias("b"), F.col("tail").alias("tb")), "b"
    )

    def same_item(s: Column) -> Column:
        return F.filter("tb", lambda t: t["item"] == s["item"])

    matched = F.transform("ta", lambda s: F.struct(s["x"].alias("x"), F.get(same_item(s), F.lit(0))["x"].alias("y")))
    joined = joined.withColumn("common", F.filter(matched, lambda s: s["y"].isNotNull())).drop("ta", "tb")
    common = F.col("common")
    added = F.struct(
        (F.col("n_common") + F.size(common)).alias("n_common"),
        (F.col("sx") + total(common, lambda s: s["x"])).alias("sx"),
        (F.col("sy") + total(common, lambda s: s["y"])).alias("sy"),
        (F.col("sxx") + total(common, lambda s: s["x"] * s["x"])).alias("sxx"),
        (F.col("syy") + total(common, lambda s: s["y"] * s["y"])).alias("syy"),
        (F.col("sxy") + total(common, lambda s: s["x"] * s["y"])).alias("sxy"),
    )
    # filters are not pushed below a generator, so the sums are evaluated once
    return joined.select("a", "b", F.inline(F.array(added)))


def _packed(comparable: DataFrame, grid: Grid, params: NeighbourParams, center: bool) -> Packed | None:
    """Blocks for a product, where that costs less than meetings and its sums are exact."""
    if not small_sums(comparable, grid, center=center) or not many_meetings(comparable, params):
        return None
    return packed_blocks(_on_grid(comparable, grid, center))


def common_rating_sums(comparable: DataFrame, grid: Grid, params: NeighbourParams, center: bool = True) -> DataFrame:
    """Sums over the shared items of every pair that shares ``min_common``."""
    min_common, raters_per_slot = params.min_common, params.raters_per_slot
    rows = _on_grid(comparable, grid, center)
    tails = write_shared(_tails(rows, min_common - 1), "tails") if min_common > 1 else None
    placed = write_shared(_placed_ratings(rows, tails, raters_per_slot), "placed")
    x, y = F.col("x"), F.col("y")
    pairs = (
        _meetings(placed, _join_tasks(placed))
        .groupBy("a", "b")
        .agg(
            F.count(F.lit(1)).alias("n_common"),
            grid.total(x).alias("sx"),
            grid.total(y).alias("sy"),
            grid.total(x * x).alias("sxx"),
            grid.total(y * y).alias("syy"),
            grid.total(x * y).alias("sxy"),
            F.max("bodies").alias("candidate"),
        )
        .filter("candidate")
        .drop("candidate")
    )
    if tails is not None:
        pairs = _with_tail_meetings(pairs, tails, grid)
    return pairs.filter(F.col("n_common") >= min_common)


def _as_pairs(sums: DataFrame, similarity: Column, string_order: bool = False) -> DataFrame:
    """Name the users of each pair so that ``user_a`` sorts before ``user_b``."""
    a, b = F.col("a"), F.col("b")
    if string_order:
        first = a.cast("string") < b.cast("string")
    else:
        first = id_precedes(has_numeric_ids(sums, "a"), a, b)
    return sums.select(
        F.when(first, a).otherwise(b).alias("user_a"),
        F.when(first, b).otherwise(a).alias("user_b"),
        "n_common",
        similarity.alias("similarity"),
    )


def pearson_pairs(
    ratings: DataFrame,
    params: NeighbourParams = NeighbourParams(),
    compat: bool = False,
    latest_only: bool = False,
) -> DataFrame:
    """Pearson correlation over shared items, per pair with enough of them.

    Re-ratings are reduced to the latest first, unless ``latest_only`` says
    that has been done. Without variance on either side the similarity is null (``compat``: NaN).
    Pairs are ordered by id; ``compat`` orders ids as text.
    """
    latest = ratings if latest_only else stored_latest(ratings)
    comparable = write_shared(_comparable_ratings(latest, params.min_common), "comparable")
    grid = rating_grid(comparable, True)
    packed = _packed(comparable, grid, params, center=True)
    if packed is None:
        return _pearson_by_meetings(comparable, grid, params, compat)
    pairs = pairs_of_product(packed, pearson, params.min_common, by_text=compat)
    return pairs.fillna(float("nan"), ["similarity"]) if compat else pairs


def _pearson_by_meetings(comparable: DataFrame, grid: Grid, params: NeighbourParams, compat: bool) -> DataFrame:
    sums = common_rating_sums(comparable, grid, params)
    n = grid.number(F.col("n_common"))
    covariance = n * F.col("sxy") - F.col("sx") * F.col("sy")
    x_part = n * F.col("sxx") - F.col("sx") * F.col("sx")
    y_part = n * F.col("syy") - F.col("sy") * F.col("sy")
    # one root of the product: the quotient of proportional parts is one to the last bit
    root = F.sqrt(x_part.cast("double") * y_part.cast("double"))
    value = F.when((x_part > 0) & (y_part > 0), covariance.cast("double") / root)
    if compat:
        value = F.coalesce(value, F.lit(float("nan")))
    return _as_pairs(sums, value, string_order=compat)


def cosine_pairs(ratings: DataFrame, params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """Cosine of the two users' ratings over shared items."""
    comparable = write_shared(_comparable_ratings(stored_latest(ratings), params.min_common), "comparable")
    grid = rating_grid(comparable, False)
    packed = _packed(comparable, grid, params, center=False)
    if packed is not None:
        return pairs_of_product(packed, cosine, params.min_common)
    sums = common_rating_sums(comparable, grid, params, center=False)
    root = F.sqrt(F.col("sxx").cast("double") * F.col("syy").cast("double"))
    return _as_pairs(sums, F.try_divide(F.col("sxy").cast("double"), root))


def nearest_users(pairs: DataFrame, top_n: int, compat: bool = False) -> DataFrame:
    """The ``top_n`` most similar users of each user, positive only.

    Each pair serves both users. ``compat`` lets it serve only the one whose
    id sorts first as text, which :func:`pearson_pairs` put first.
    """
    # NaN compares greater than any number in Spark
    positive = pairs.filter((F.col("similarity") > 0) & ~F.isnan("similarity"))
    forward = F.struct(F.col("user_a").alias("user"), F.col("user_b").alias("neighbour"))
    backward = F.struct(F.col("user_b").alias("user"), F.col("user_a").alias("neighbour"))
    ways = F.array(forward) if compat else F.array(forward, backward)
    sides = positive.select(F.explode(ways).alias("way"), "similarity").select("way.*", "similarity")
    order = [F.col("similarity").desc(), *id_order(sides, "neighbour")]
    return top_k(sides, ["user"], order, top_n).select("user", "neighbour", "similarity", "rank")
