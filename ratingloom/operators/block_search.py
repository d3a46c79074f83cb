"""Similar users of moderate numbers of users, by blocks: the best of each block before any exchange by pair.

Users are dealt into blocks, and every two blocks (and each with itself) are a
group, which gets the ratings of both: one exchange. A group sums up all its
pairs in arrays, and hands on no pair but only the ``top_n`` best of the other
block for each user: users * top_n * blocks rows at most. A second exchange, by
user, picks the best of those.

Ratings are sent once for each block, so the search is for numbers of blocks
up to ``MAX_BLOCKS``. Beyond, :mod:`~ratingloom.operators.block_product` compares packed
blocks where most users share items; else :mod:`~ratingloom.operators.similarity`
shuffles pairs that share a not so popular item. Sums are of whole numbers on the
grid of ratings, so all ways give the same neighbours to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ratingloom.functions import hash_slot, id_order, top_k
from ratingloom.functions.ids import has_numeric_ids, user_hash
from ratingloom.operators.block_product import Meeting, Packed, best_of_product, packed_blocks
from ratingloom.operators.similarity import (
    _comparable_ratings,
    _on_grid,
    _pearson_by_meetings,
    many_meetings,
    nearest_users,
    rating_grid,
    small_sums,
    stored_latest,
)
from ratingloom.operators.sums import Entries, correlation, pair_sums
from ratingloom.params import NeighbourParams
from ratingloom.session import write_shared

USERS_PER_BLOCK = 1024
MAX_BLOCKS = 64
#: A group holds the ratings of two blocks.
RATINGS_PER_BLOCK = 2_000_000


def similar_users(
    ratings: DataFrame, params: NeighbourParams = NeighbourParams(), compat: bool = False, latest_only: bool = False
) -> DataFrame:
    """``(user, neighbour, similarity, rank)``: the ``top_n`` most similar users of each user, positive only.

    The same rows as :func:`nearest_users` of :func:`pearson_pairs`, whichever way they are found.
    """
    latest = ratings if latest_only else stored_latest(ratings)
    rows = write_shared(_comparable_ratings(latest, params.min_common), "comparable")
    grid = rating_grid(rows, True)
    if small_sums(rows, grid):
        blocks = number_of_blocks(rows)
        if blocks is not None:
            return block_neighbours(_on_grid(rows, grid, True), blocks, params, compat)
        if many_meetings(rows, params):
            packed = packed_blocks(_on_grid(rows, grid, True))
            if packed is not None:
                return _neighbours_of_product(packed, params, compat)
    return nearest_users(_pearson_by_meetings(rows, grid, params, compat), params.top_n, compat)


def _neighbours_of_product(packed: Packed, params: NeighbourParams, compat: bool) -> DataFrame:
    def compare(met: Meeting) -> Iterator[tuple[int, np.ndarray]]:
        met.leave_out(params.min_common, compat)
        yield 0, met.similarity(met.all_sums(), params.min_common, compat)

    found = best_of_product(packed, [params.top_n], compare).drop("list")
    _, _, strips = packed
    return found if strips == 1 else _ranked(found.drop("rank"), params.top_n)


def _ranked(found: DataFrame, top_n: int) -> DataFrame:
    order = [F.col("similarity").desc(), *id_order(found, "neighbour")]
    return top_k(found, ["user"], order, top_n)


def number_of_blocks(rows: DataFrame) -> int | None:
    """Blocks of users, enough for the cluster's tasks; None where they would be too many or too large."""
    users, ratings = rows.agg(F.count_distinct("user"), F.count(F.lit(1))).first()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(
        math.ceil(users / USERS_PER_BLOCK),
        math.ceil(2 * ratings / RATINGS_PER_BLOCK),
        min(math.ceil(math.sqrt(2 * tasks)), math.ceil(users / 64)),
        1,
    )
    if wanted > MAX_BLOCKS:
        return None
    sizes = rows.groupBy(_block(wanted).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return wanted if (sizes.agg(F.max("n")).first()[0] or 0) <= RATINGS_PER_BLOCK else None


def _block(blocks: int):
    return hash_slot(user_hash("user"), F.lit(blocks))


def block_neighbours(rows: DataFrame, blocks: int, params: NeighbourParams, compat: bool = False) -> DataFrame:
    """Neighbours from ratings on the grid (user, item, x), in groups of every two of ``blocks`` blocks."""
    kind = rows.schema["user"].dataType.simpleString()
    numeric = has_numeric_ids(rows, "user")

    def search(table: pa.Table) -> pa.Table:
        return _best_of_group(table, params, numeric, compat)

    groups = block_groups(rows.select("user", "item", "x"), blocks)
    found = groups.applyInArrow(search, f"user {kind}, neighbour {kind}, similarity double")
    return _ranked(found, params.top_n)


def block_groups(rows: DataFrame, blocks: int) -> GroupedData:
    """``rows`` in a group for every two blocks of users, and each with itself."""
    number = F.col("user").cast("bigint") if has_numeric_ids(rows, "user") else F.col("user").try_cast("bigint")
    block, other = F.col("block"), F.col("other")
    dealt = rows.select(*rows.columns, number.alias("number"), _block(blocks).alias("block"), F.lit(0).alias("zero"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.col("zero"), F.lit(blocks - 1)))).select(
        F.least(block, other).alias("lo"), F.greatest(block, other).alias("hi"), "block", "number", *rows.columns
    )
    return dealt.groupBy("lo", "hi")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    found = column.combine_chunks().dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


class Group:
    """Two blocks of users, or one and itself: users and items by number, the users of each side, the order of ids."""

    def __init__(self, table: pa.Table, numeric: bool):
        self.user, self.ids = _codes(table["user"])
        self.item, items = _codes(table["item"])
        self.n_items = len(items)
        late = table["block"].to_numpy() == table["hi"].to_numpy()
        first = np.unique(self.user, return_index=True)[1]
        numbers, texts = table["number"].take(pa.array(first)).to_pylist(), self.ids.to_pylist()
        # places of the users in the order of ids, and in that of ids as text
        key = (lambda u: numbers[u]) if numeric else (lambda u: (numbers[u] is None, numbers[u] or 0, texts[u].encode()))
        self.place, self.by_text = (
            _places(sorted(range(len(texts)), key=k)) for k in (key, lambda u: str(texts[u]).encode())
        )
        self.own = table["lo"][0].as_py() == table["hi"][0].as_py()
        self.sides = [np.flatnonzero(np.bincount(self.user, late if s else ~late, len(texts)) > 0) for s in (0, 1)]
        self.rows = [np.ones(len(self.user), bool) if self.own else ~late, late]
        if self.own:
            self.sides[0] = self.sides[1]
        self.shape = (len(self.sides[0]), len(self.sides[1]))
        self.local = []
        for members in self.sides:
            local = np.full(len(texts), -1)
            local[members] = np.arange(len(members))
            self.local.append(local)

    def entries(self, side: int, chosen: np.ndarray, x: np.ndarray, weight: float = 1.0) -> Entries:
        """The chosen rows of one side with their values ``x``, all of the same weight."""
        chosen = chosen & self.rows[side]
        return self.local[side][self.user[chosen]], self.item[chosen], x[chosen], np.full(chosen.sum(), weight)

    def sums(self, left: Entries, right: Entries) -> list[np.ndarray]:
        return pair_sums(left, right, self.shape, self.n_items)

    def similarity(self, sums: list[np.ndarray], min_common: int) -> np.ndarray:
        """Pearson correlation of every two users; 0 where it is not positive or they share too little."""
        similarity = correlation(sums, min_common)
        if self.own:
            np.fill_diagonal(similarity, 0.0)
        return similarity

    def best(self, similarity: np.ndarray, top_n: int, compat: bool) -> list[np.ndarray]:
        """Users, neighbours and similarities: the best of the other side for each user."""
        a, b = self.sides
        out = []
        for mine, others, table_of in ((a, b, similarity), (b, a, similarity.T))[: 1 if self.own else 2]:
            if compat:  # a pair serves the user whose id sorts first as text
                table_of = np.where(self.by_text[mine][:, None] < self.by_text[others][None], table_of, 0.0)
            out.append(_best(mine, others, table_of, self.place, top_n))
        return [np.concatenate(c) for c in zip(*out)]


def _best_of_group(table: pa.Table, params: NeighbourParams, numeric: bool, compat: bool) -> pa.Table:
    group = Group(table, numeric)
    if not all(group.shape):
        return _rows(group.ids, [], [], [])
    x = table["x"].to_numpy().astype(np.float64)
    sums = group.sums(*(group.entries(s, np.ones(len(x), bool), x) for s in (0, 1)))
    return _rows(group.ids, *group.best(group.similarity(sums, params.min_common), params.top_n, compat))


def _places(order: list[int]) -> np.ndarray:
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _rows(ids: pa.Array, users, neighbours, similarity) -> pa.Table:
    columns = [ids.take(pa.array(u, pa.int64())) for u in (users, neighbours)]
    return pa.table([*columns, pa.array(similarity, pa.float64())], names=["user", "neighbour", "similarity"])


def _best(mine, others, similarity, place, top_n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of ``others`` for each of ``mine``, ties to the earlier id."""
    row, column = np.nonzero(similarity > 0)
    value = similarity[row, column]
    order = np.lexsort((place[others[column]], -value, row))
    row, column, value = row[order], column[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < top_n
    return mine[row[kept]], others[column[kept]], value[kept]
