"""Candidate items from similar users."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import hash_slot, id_order, jvm_divide, share, top_k
from ratingloom.functions.ids import user_hash
from ratingloom.functions.scoring import SCORE_DECIMALS
from ratingloom.operators.requests import Requests, requests_of
from ratingloom.operators.sums import spans
from ratingloom.session import write_shared

#: From so many neighbours on, their liked items are added up where the lists are, not sent to the users one by one.
MANY_NEIGHBOURS = 5_000_000
#: A task holds a strip of packed likes, and so many neighbours beside it, some at a time.
LIKES_PER_STRIP = 8_000_000
NEIGHBOURS_PER_ROW = 400_000
NEIGHBOURS_AT_ONCE = 50_000
#: Sums go through an array of users by items that has so many times as many places as there are summands at most.
PLACES = 8


def many_neighbours(neighbours: DataFrame) -> bool:
    return neighbours.count() >= MANY_NEIGHBOURS


def candidate_scores(
    neighbours: DataFrame, likes: DataFrame, by: Sequence[str] = (), groups: Sequence[int] = ()
) -> DataFrame:
    """Items liked by a user's neighbours, seen ones too, with the sum of neighbour rating times similarity.

    With ``groups``, the values of the one column ``by``, the lists stay where they are and meet the packed likes of
    their group: for many neighbours, whose liked items are many times the sums.
    """
    if groups:
        return _scores_by_strips(neighbours, likes, *by, groups)
    liked = likes.select(*by, F.col("user").alias("neighbour"), "item", "rating")
    return (
        neighbours.select(*by, "user", "neighbour", "similarity")
        .join(liked, [*by, "neighbour"])
        .groupBy(*by, "user", "item")
        .agg(F.round(F.sum(F.col("rating") * F.col("similarity")), SCORE_DECIMALS).alias("score"))
    )


def _scores_by_strips(neighbours: DataFrame, likes: DataFrame, by: str, groups: Sequence[int]) -> DataFrame:
    user, item = (likes.schema[c].dataType.simpleString() for c in ("user", "item"))
    strips = max(1, math.ceil(likes.count() / (LIKES_PER_STRIP * max(1, len(groups)))))
    dealt = likes.select(by, hash_slot(user_hash("user"), F.lit(strips)).alias("strip"), "user", "item", "rating")
    schema = f"{by} int, strip int, ids array<{user}>, items array<{item}>, starts binary, item binary, rating binary"

    def pack(table: pa.Table) -> pa.Table:
        return _packed_likes(table, by)

    packed = write_shared(dealt.groupBy(by, "strip").applyInArrow(pack, schema), "likes", by)
    lists = f"users array<{user}>, user binary, neighbours array<{user}>, similarity binary"
    parts = []
    for group in groups:
        left = neighbours.where(F.col(by) == group).select("user", "neighbour", "similarity").mapInArrow(_packed_lists, lists)
        # never broadcast: a strip is no small table
        met = left.hint("shuffle_replicate_nl").crossJoin(packed.where(F.col(by) == group).drop(by))
        found = met.mapInArrow(_sums_of_strips, f"user {user}, item {item}, part double")
        parts.append(found.select(F.lit(group).alias(by), "*"))
    # dealt out as the seen items are
    sums = reduce(DataFrame.unionByName, parts).repartition("user", "item").groupBy(by, "user", "item")
    return sums.agg(F.round(F.sum("part"), SCORE_DECIMALS).alias("score"))


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers for values, and the values."""
    found = column.combine_chunks().dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed_likes(table: pa.Table, by: str) -> pa.Table:
    (user, ids), (item, items) = _coded(table["user"]), _coded(table["item"])
    order = np.argsort(user, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(user, minlength=len(ids)))])
    numbers = {"starts": starts, "item": item[order].astype(np.int32), "rating": table["rating"].to_numpy()[order]}
    columns = {c: table[c].slice(0, 1) for c in (by, "strip")} | {"ids": _list_of(ids), "items": _list_of(items)}
    return pa.table(columns | {c: pa.array([n.tobytes()], pa.binary()) for c, n in numbers.items()})


def _packed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours as they come, many to a row."""
    waiting: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        user, users = _coded(table["user"])
        neighbours = table["neighbour"].combine_chunks()
        if isinstance(neighbours, pa.ChunkedArray):
            neighbours = pa.concat_arrays(neighbours.chunks)
        similarity = table["similarity"].to_numpy().astype(np.float64)
        numbers = (pa.array([n.tobytes()], pa.binary()) for n in (user.astype(np.int32), similarity))
        columns = [_list_of(users), next(numbers), _list_of(neighbours), next(numbers)]
        return pa.record_batch(columns, names=["users", "user", "neighbours", "similarity"])

    for batch in batches:
        waiting += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in waiting) >= NEIGHBOURS_PER_ROW:
            yield packed()
            waiting = []
    if waiting:
        yield packed()


def _sums_of_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours of each row over the likes beside them."""
    for batch in batches:
        for row in range(batch.num_rows):
            value = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
            starts, item, rating, user, similarity = (
                np.frombuffer(value[c].as_buffer(), kind)
                for c, kind in (("starts", np.int64), ("item", np.int32), ("rating", np.float64), ("user", np.int32), ("similarity", np.float64))
            )
            items, users = value["items"].values, value["users"].values
            liked = pc.index_in(value["neighbours"].values, value_set=value["ids"].values)
            liked = liked.fill_null(-1).to_numpy(zero_copy_only=False)
            here = np.flatnonzero(liked >= 0)
            for at in range(0, len(here), NEIGHBOURS_AT_ONCE):
                some = here[at : at + NEIGHBOURS_AT_ONCE]
                sizes = (starts[1:] - starts[:-1])[liked[some]]
                rows = spans(starts, liked[some])
                cell = np.repeat(user[some].astype(np.int64), sizes) * len(items) + item[rows]
                found, total = _added(cell, np.repeat(similarity[some], sizes) * rating[rows])
                columns = [users.take(pa.array(found // len(items))), items.take(pa.array(found % len(items))), pa.array(total)]
                yield pa.record_batch(columns, names=["user", "item", "part"])


def _added(cell: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells, each once, and their sums."""
    first = cell.min()
    size = int(cell.max() - first) + 1
    if size > PLACES * len(cell):
        found, cell = np.unique(cell, return_inverse=True)
        return found, np.bincount(cell, value)
    found = np.flatnonzero(np.bincount(cell - first, minlength=size))
    return found + first, np.bincount(cell - first, value, size)[found]


def cf_candidates(neighbours: DataFrame, likes: DataFrame, seen: DataFrame) -> DataFrame:
    """Items liked by a user's neighbours and not yet seen by the user.

    ``seen`` holds each user and item once. The score is summed before the
    seen items go out: the sums are far fewer and arrive partitioned as the
    join needs them. (An anti-join would be moved below the aggregate and sort
    every summand.)
    """
    scored = candidate_scores(neighbours, likes)
    known = seen.select("user", "item", F.lit(True).alias("known"))
    return scored.join(known, ["user", "item"], "left").filter(F.col("known").isNull()).drop("known")


def ranked_shares(
    candidates: DataFrame,
    queries: DataFrame | Requests,
    accepted: str,
    weight: float,
    compat: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Best ``num`` accepted candidates per query (and ``by``), scored by their share.

    ``accepted`` names a boolean column. ``compat`` returns every candidate,
    accepted or not, over the total of the accepted top list; without any
    accepted one the scores are infinite.
    """
    requests = requests_of(queries)
    keys = [*by, "user"]
    query = [*keys, "num"]
    users = candidates.join(requests.rows.select(*keys).distinct(), keys, "left_semi")
    order = [F.col("score").desc(), *id_order(candidates, "item")]
    # ranked once per user; every query of the user takes the head of that list
    ranked = top_k(users.filter(accepted), keys, order, requests.most)
    best = ranked.join(requests.rows, keys).filter(F.col("rank") <= F.col("num"))
    if not compat:
        part = F.round(share(F.col("score"), query, weight), SCORE_DECIMALS)
        return best.select(*query, "item", part.alias("score"), "rank")
    totals = best.groupBy(*query).agg(F.sum("score").alias("total"))
    part = jvm_divide(F.col("score"), F.coalesce("total", F.lit(0.0))) * F.lit(float(weight))
    every = users.join(requests.rows, keys).join(totals, query, "left")
    return every.select(*query, "item", F.round(part, SCORE_DECIMALS).alias("score"))
