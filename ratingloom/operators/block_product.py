"""Similar users of many users who share many items: every block of users against all others, without a shuffle of pairs.

Where most users share items, the pairs that :mod:`~ratingloom.operators.similarity` shuffles are nearly all there
are, and the copies of ratings for each block that :mod:`~ratingloom.operators.block_search` sends grow with the
square of the users. Here the ratings of each block of users are packed into one row, once, and a product of the
packed blocks hands every two of them to a task. What is sent are the packed ratings only:

* for neighbours, a task meets one block with a strip of the others (:data:`RATINGS_PER_STRIP`), one after the other,
  and keeps the ``top_n`` best of each user so far: users * ``top_n`` * strips rows leave it. Those of a single strip
  are the lists, and go through no exchange. Where few pairs share enough items, only these get sums;
* pairs are handed on as they are found, each by one task, in no need of an exchange.

The work is that of all pairs of users. So this way is taken only where pairs that share an item are not far fewer
(:func:`worth_a_product`). Sums are of whole numbers, so all ways give the same values to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions import hash_slot, id_order
from ratingloom.functions.ids import user_hash
from ratingloom.operators.ratings import id_index
from ratingloom.operators.sums import (
    CHUNK,
    POWERS,
    Entries,
    Pairs,
    correlation,
    pair_sums,
    products_of_pairs,
    shared_items,
    sums_of_pairs,
)
from ratingloom.session import write_shared

USERS_PER_BLOCK = 1024
#: A task holds one block in full, and a strip of packed ones.
RATINGS_PER_BLOCK = 1_000_000
RATINGS_PER_STRIP = 8_000_000
#: Fewer meetings than this are shuffled.
LEAST_MEETINGS = 50_000_000
#: Meetings of pairs cost so many times one pair of a product.
COST_OF_MEETING = 16
#: Where less than one of so many pairs shares enough items, sums are found pair by pair.
FEW_PAIRS = 64
#: And where less than one of so many does, correlations of these only are found.
SOME_PAIRS = 2

#: Packed blocks, their number and that of strips.
Packed = tuple[DataFrame, int, int]
IDS = ("ids", "place", "text")
#: As packed and as read. Of exact sums the values have 26 bits at most; ``y`` may be NaN.
NUMBERS = {
    "user": (np.int32, np.int64), "item": (np.int32, np.int64), "fold": (np.int16, np.int64),
    "x": (np.int32, np.float64), "y": (np.float64, np.float64),
}


def worth_a_product(meetings: float, users: int) -> bool:
    return meetings >= max(LEAST_MEETINGS, users**2 / COST_OF_MEETING)


def packed_blocks(rows: DataFrame, carry: Sequence[str] = ()) -> Packed | None:
    """Blocks of users, one row each, with their number and that of strips; None where one would be too large.

    ``rows`` are (user, item, x) on the grid, and the columns to ``carry``. A row has the users of a block as
    ``ids``, with their places in the order of ids and of ids as text, and the ratings by item as packed numbers.
    """
    users, ratings = rows.agg(F.count_distinct("user"), F.count(F.lit(1))).first()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(
        math.ceil(users / USERS_PER_BLOCK), math.ceil(4 * ratings / RATINGS_PER_BLOCK), min(2 * tasks, users // 64), 1
    )
    block = hash_slot(user_hash("user"), F.lit(blocks))
    sizes = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > RATINGS_PER_BLOCK:
        return None
    items = id_index(rows, "item").select(F.col("id").alias("item"), F.col("idx"))
    places = _places(rows.select("user").distinct())
    packed = ("x", *carry)
    dealt = rows.join(items, "item").join(places, "user").select(
        block.alias("block"), "user", "place", "text", F.col("idx").alias("item"), *packed
    )
    kind = rows.schema["user"].dataType.simpleString()
    columns = ", ".join(f"{c} binary" for c in ("user", "item", *packed))
    schema = f"block int, ids array<{kind}>, place array<bigint>, text array<bigint>, {columns}"

    def pack(table: pa.Table) -> pa.Table:
        return _pack(table, packed)

    stored = write_shared(dealt.groupBy("block").applyInArrow(pack, schema), "blocks")
    return stored, blocks, max(1, math.ceil(ratings / RATINGS_PER_STRIP))


def _places(users: DataFrame) -> DataFrame:
    """``(user, place, text)``: numbers that rise in the order of ids, and in that of ids as text."""
    # of sorted partitions, the numbers rise from row to row
    by_id = users.orderBy(*id_order(users, "user")).withColumn("place", F.monotonically_increasing_id())
    by_text = users.orderBy(F.col("user").cast("string")).withColumn("text", F.monotonically_increasing_id())
    return write_shared(by_id, "places").join(write_shared(by_text, "places"), "user")


def _pack(table: pa.Table, packed: Sequence[str]) -> pa.Table:
    numbers = {c: table[c].to_numpy() for c in ("place", "text", "item", *packed)}
    place, first, user = np.unique(numbers["place"], return_index=True, return_inverse=True)
    order = np.argsort(numbers["item"], kind="stable")
    numbers["user"] = user
    lists = {
        "ids": table["user"].combine_chunks().take(pa.array(first)),
        "place": pa.array(place),
        "text": pa.array(numbers["text"][first]),
    }
    columns = {"block": table["block"].slice(0, 1)}
    for name, values in lists.items():
        columns[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), _whole(values))
    for name in ("user", "item", *packed):
        columns[name] = pa.array([numbers[name][order].astype(NUMBERS[name][0]).tobytes()], pa.binary())
    return pa.table(columns)


def _whole(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


class Block:
    """A block of users and their ratings, by item."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.number = row["block"].as_py()
        self.ids, place, text = (row[c].values for c in IDS)
        self.place, self.text = place.to_numpy(), text.to_numpy()
        for name, (packed, kind) in NUMBERS.items():
            if name in row:
                setattr(self, name, np.frombuffer(row[name].as_buffer(), packed).astype(kind))
        self.size = len(self.ids)
        self.items = np.unique(self.item)


class Meeting:
    """Two blocks, or one and itself."""

    def __init__(self, left: Block, right: Block):
        self.left, self.right = left, right
        self.items = np.intersect1d(left.items, right.items, assume_unique=True)
        self.shape = (left.size, right.size)
        self.own = left.number == right.number
        self.sides = (left, right)
        #: The only pairs that sums are for, or all; and whether they are few.
        self.pairs: Pairs | None = None
        self.few = False

    def leave_out(self, min_common: int, compat: bool) -> None:
        """Give sums to pairs that share ``min_common`` items only, where items go through arrays together and most pairs don't."""
        if len(self.items) > CHUNK:
            return
        enough = shared_items(*self._every(), self.shape, len(self.items)) >= min_common
        if compat:
            enough &= self.left.text[:, None] < self.right.text[None]
        elif self.own:
            np.fill_diagonal(enough, False)
        found = np.count_nonzero(enough)
        self.few = FEW_PAIRS * found < enough.size
        if self.few or SOME_PAIRS * found < enough.size:
            self.pairs = np.nonzero(enough)

    def _every(self) -> list[Entries]:
        return [self.entries(s, np.ones(len(b.x), bool), b.x) for s, b in enumerate(self.sides)]

    def entries(self, side: int, chosen: np.ndarray, x: np.ndarray, weight: float = 1.0) -> Entries:
        """The chosen ratings of one side of items that both have, with values ``x``, all of the same weight."""
        block = self.sides[side]
        at = np.searchsorted(self.items, block.item)
        kept = chosen & (at < len(self.items))
        kept[kept] = self.items[at[kept]] == block.item[kept]
        return block.user[kept], at[kept], x[kept], np.full(np.count_nonzero(kept), weight)

    def sums(self, left: Entries, right: Entries) -> list[np.ndarray]:
        if self.pairs is None:
            return pair_sums(left, right, self.shape, len(self.items))
        if not len(self.pairs[0]):
            return [np.empty(0) for _ in POWERS]
        found = sums_of_pairs if self.few else products_of_pairs
        return found(left, right, self.shape, len(self.items), self.pairs)

    def all_sums(self) -> list[np.ndarray]:
        return self.sums(*self._every())

    def similarity(self, sums: list[np.ndarray], min_common: int, compat: bool) -> np.ndarray:
        """Of every two users, or of ``pairs``; 0 where it is not positive or they share too little, or it serves the other one only."""
        found = correlation(sums, min_common)
        if self.pairs is not None:  # which leave_out() chose
            return found
        if self.own:
            np.fill_diagonal(found, 0.0)
        if compat:  # a pair serves the user whose id sorts first as text
            found[self.left.text[:, None] >= self.right.text[None]] = 0.0
        return found


class Best:
    """The best ``top_n`` neighbours so far of every user of a block, ties to the earlier id."""

    def __init__(self, users: int, top_n: int):
        self.top_n = top_n
        self.user, self.place, self.value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.ids: pa.Array | None = None
        # the last one of a full list, which a better one replaces
        self.least, self.last = np.full(users, np.nextafter(0.0, 1.0)), np.full(users, np.iinfo(np.int64).max)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, similarity: np.ndarray, others: Block, pairs: Pairs | None = None) -> None:
        """Similarities of all users to all ``others``, or of ``pairs``."""
        if pairs is None:
            user, column = np.nonzero(similarity >= self.least[:, None])
            value = similarity[user, column]
        else:
            good = similarity >= self.least[pairs[0]]
            user, column, value = pairs[0][good], pairs[1][good], similarity[good]
        place = others.place[column]
        better = (value > self.least[user]) | (place < self.last[user])
        if better.any():
            ids = others.ids.take(pa.array(column[better]))
            self.waiting.append((user[better], place[better], value[better], ids))
        # sorted once as many wait as lists hold
        if sum(len(w[0]) for w in self.waiting) > max(len(self.user), len(self.least)):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        users, places, values = (
            np.concatenate([held, *(w[i] for w in self.waiting)])
            for i, held in enumerate((self.user, self.place, self.value))
        )
        ids = pa.concat_arrays([*([] if self.ids is None else [self.ids]), *(w[3] for w in self.waiting)])
        order = np.lexsort((places, -values, users))
        counts = np.bincount(users, minlength=len(self.least))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = order[rank < self.top_n]
        self.user, self.place, self.value = users[order], places[order], values[order]
        self.ids, self.waiting = ids.take(pa.array(order)), []
        counts = np.minimum(counts, self.top_n)
        full = np.flatnonzero(counts == self.top_n)
        ends = np.cumsum(counts)[full] - 1
        self.least[full], self.last[full] = self.value[ends], self.place[ends]


def _met(packed: DataFrame, blocks: int, strips: int, condition: Column | None = None) -> DataFrame:
    """Every block beside the blocks of each strip."""
    sides = []
    for side, parts in (("a", blocks), ("b", strips)):
        named = packed.select(*(F.col(c).alias(f"{side}_{c}") for c in packed.columns))
        sides.append(named.repartitionByRange(parts, f"{side}_block"))
    # never broadcast: tasks are to be as many as blocks
    return sides[0].hint("shuffle_replicate_nl").join(sides[1], condition, "inner" if condition is not None else "cross")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[Meeting]:
    """The blocks of a task; a block that meets several in a row is read once."""
    left: Block | None = None
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            one, two = ({n[2:]: c[i] for n, c in columns.items() if n.startswith(s)} for s in ("a_", "b_"))
            if left is None or one["block"].as_py() != left.number:
                left = Block(one)
            yield Meeting(left, Block(two))


def best_of_product(
    packed: Packed, tops: Sequence[int], compare: Callable[[Meeting], Iterator[tuple[int, np.ndarray]]]
) -> DataFrame:
    """``(list, user, neighbour, similarity, rank)``: the best of each strip for every user, of ``tops[list]`` at most.

    ``compare`` gives the similarities of two blocks, or of the pairs that it left, each with the list that they are
    for. Ranks are within a strip, so they are final where there is one.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = None
        best: list[Best] = []
        for met in _meetings(batches):
            if met.left is not block:
                yield from _rows(block, best)
                block, best = met.left, [Best(met.left.size, n) for n in tops]
            for i, similarity in compare(met):
                best[i].add(similarity, met.right, met.pairs)
        yield from _rows(block, best)

    kind = _id_type(packed)
    return _met(*packed).mapInArrow(search, f"list int, user {kind}, neighbour {kind}, similarity double, rank int")


def _id_type(packed: Packed) -> str:
    return packed[0].schema["ids"].dataType.elementType.simpleString()


def _rows(block: Block | None, best: Sequence[Best]) -> Iterator[pa.RecordBatch]:
    for i, b in enumerate(best):
        b.settle()
        if b.ids is not None:
            rank = np.arange(len(b.user)) - np.searchsorted(b.user, b.user) + 1
            lists = pa.array(np.full(len(b.user), i, np.int32))
            columns = [lists, block.ids.take(pa.array(b.user)), b.ids, pa.array(b.value), pa.array(rank.astype(np.int32))]
            yield pa.record_batch(columns, names=["list", "user", "neighbour", "similarity", "rank"])


def pairs_of_product(
    packed: Packed, value: Callable[[list[np.ndarray]], np.ndarray], min_common: int, by_text: bool = False
) -> DataFrame:
    """``(user_a, user_b, n_common, similarity)`` of every two users who share ``min_common`` items.

    ``value`` gives the similarity from the sums, NaN where there is none, which becomes null.
    """
    a, b = F.col("a_block"), F.col("b_block")
    # of (a, b) and (b, a) one is met; every block meets about half of the others
    once = (a == b) | ((a < b) == ((a + b) % 2 == 0))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _meetings(batches):
            sums = met.all_sums()
            shared = sums[0] >= min_common
            if met.own:
                shared &= np.arange(met.left.size)[:, None] < np.arange(met.right.size)[None]
            one, two = np.nonzero(shared)
            if not len(one):
                continue
            similarity = value([s[one, two] for s in sums])
            order = "text" if by_text else "place"
            first = getattr(met.left, order)[one] < getattr(met.right, order)[two]
            ids = pa.concat_arrays([met.left.ids, met.right.ids])
            two = two + met.left.size
            columns = [
                ids.take(pa.array(np.where(first, one, two))),
                ids.take(pa.array(np.where(first, two, one))),
                pa.array(sums[0][shared].astype(np.int64)),
                pa.array(similarity, mask=np.isnan(similarity)),
            ]
            whole = pa.record_batch(columns, names=["user_a", "user_b", "n_common", "similarity"])
            yield from (whole.slice(at, 100_000) for at in range(0, whole.num_rows, 100_000))

    kind = _id_type(packed)
    schema = f"user_a {kind}, user_b {kind}, n_common bigint, similarity double"
    return _met(*packed, once).mapInArrow(search, schema)
