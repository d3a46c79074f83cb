"""N-gram Jaccard join of documents by vertical partitioning.

A document is its set of word n-grams. All n-grams stand in one global order,
the rare before the frequent, and that order is cut into fragments. The
overlap of two documents is the sum of their overlaps in the fragments, which
are counted apart: a row for each pair and fragment, added up per pair. So a
long document never has to be in one place, and a set is read only for pairs
that can be linked at all.

* **Order.** A sketch, one count for each of ``2**sketch_bits`` hash buckets of
  n-grams, is added up over all documents. An n-gram's number in the order
  holds the logarithm of its bucket's count and then its hash. Any such order
  gives right results; a good one has the rare ones first.
* **Classes.** Documents with equal sets are one class, and classes are joined.
* **Candidates.** Two sets that are similar enough share an n-gram among the
  first ``n - ceil(t * n) + 1`` of either; these are its early ones. At the
  first n-gram that two classes share, the overlap is at most what is left of
  either set from there on. Classes meet at all early n-grams they share, but
  only those where this bound and the sizes let them be similar are looked at.
* **Hubs first.** In small groups of classes that share an early n-gram all of
  them meet. A large group is first joined with one of its members, the one
  that has most of its set left, which links most near copies as stars. Only
  classes that are then in different components meet, with a few more members
  or, once little is left, with each other. No group is cut off, and a large
  group of near copies does not give all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.components import components
from ratingloom.session import write_shared

#: Bits of an n-gram's hash in its number; the bits above are its level.
HASH_BITS = 57
#: Levels of the logarithm per doubling.
LEVELS = 2
#: The sketch is added up in this many pieces.
PIECES = 64


@dataclass(frozen=True)
class JoinParams:
    """Sets of ``size`` words are linked at ``percent`` of their union. The order is cut into ``fragments``
    and sketched in ``2**sketch_bits`` counts. Up to ``hub_rounds`` rounds join each group of more than ``small``
    classes with one of them; all pairs of what is left meet then, or as soon as about ``few_meetings`` a row are left.
    A filter of up to ``2**filter_bits`` bits tells which texts are read again.
    """

    size: int = 5
    percent: int = 80
    fragments: int = 16
    sketch_bits: int = 23
    small: int = 32
    hub_rounds: int = 3
    few_meetings: int = 8
    filter_bits: int = 27


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, in order; the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    if not size:
        return hashes
    sums = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        sums += hashes[i : i + len(sums)] * _FACTORS[i]
    sums = np.sort(_mix(sums))
    return sums[np.concatenate(([True], sums[1:] != sums[:-1]))]


def class_of(found: np.ndarray) -> int:
    """Key of a set, as a signed long."""
    key = xxhash.xxh3_64_intdigest(found.tobytes())
    return key - (1 << 64) if key >> 63 else key


def _bucket(found: np.ndarray, bits: int) -> np.ndarray:
    return (found & np.uint64((1 << bits) - 1)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Every batch with the sets of its column ``text``."""
    for batch in batches:
        yield batch, [shingles(t, size) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


# -- classes and order -----------------------------------------------------


def _classes_and_sketch(docs: DataFrame, params: JoinParams) -> DataFrame:
    """(doc_id, print, n, class) of each document, and rows (piece, counts) of each task's sketch."""
    names = ["doc_id", "print", "n", "class", "piece", "counts"]
    kinds = [None, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind, any_rows = np.zeros(1 << params.sketch_bits, np.uint32), None, False
        for batch, found in _sets(batches, params.size):
            kind, any_rows = batch.column(0).type, any_rows or batch.num_rows > 0
            for s in found:
                counts[_bucket(s, params.sketch_bits)] += 1  # buckets that meet twice in a set count once
            n = len(found)
            columns = [batch.column(0), batch.column(2), [len(s) for s in found], [class_of(s) for s in found]]
            columns += [[None] * n, [None] * n]
            yield _batch(columns, kinds, names)
        if any_rows:
            press = zstandard.ZstdCompressor(level=3).compress
            for i, part in enumerate(np.split(counts, PIECES)):
                planes = part.view(np.uint8).reshape(-1, 4).T.tobytes()
                yield _batch([pa.nulls(1, kind), [None], [None], [None], [i], [press(planes)]], kinds, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    return rows.mapInArrow(run, f"doc_id {kind}, print long, n int, class long, piece int, counts binary")


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1).astype(np.int64)


@dataclass(frozen=True)
class Order:
    """The global order: a level for each bucket, from which tokens are hot, and where fragments begin."""

    levels: bytes
    hot_level: int
    borders: tuple[int, ...]

    def tokens(self, found: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams of a set in the global order, sorted."""
        levels = np.frombuffer(self.levels, np.uint8)
        bits = (len(levels) - 1).bit_length()
        level = levels[_bucket(found, bits)].astype(np.int64)
        # the bucket's own bits are the lowest
        return np.sort(level << HASH_BITS | (found & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64))


def global_order(sketch: DataFrame, params: JoinParams) -> Order:
    """Add up the pieces of all tasks' sketches; one level for each bucket comes to the driver (8 MB)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = _counts(data.as_py())
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            level = np.minimum(np.log2(1.0 + part) * LEVELS, 63).astype(np.uint8)
            weight = np.bincount(level, part, minlength=64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([weight.tolist()])],
                ["piece", "levels", "weight"],
            )

    dealt = sketch.repartition(PIECES, "piece").sortWithinPartitions("piece")
    # a bounded number of bytes, whatever the input
    pieces = sorted(dealt.mapInArrow(add, "piece int, levels binary, weight array<long>").collect())
    if not pieces:
        return Order(bytes(1 << params.sketch_bits), 64, ())
    weight = np.sum([p["weight"] for p in pieces], axis=0)
    total = int(weight.sum())
    # tokens in buckets of more than this may be in very many documents
    many = max(4096, 8 * total >> params.sketch_bits)
    hot = int(np.log2(1.0 + many) * LEVELS)
    # hashes are even inside a level, so a share of a level is a share of its range
    before, borders = np.cumsum(weight) - weight, []
    for i in range(1, params.fragments):
        at = total * i / params.fragments
        level = int(np.searchsorted(before, at, side="right")) - 1
        part = min(max((at - before[level]) / max(weight[level], 1), 0.0), 1.0)
        borders.append(level << HASH_BITS | min(int(part * (1 << HASH_BITS)), (1 << HASH_BITS) - 1))
    return Order(b"".join(bytes(p["levels"]) for p in pieces), hot, tuple(sorted(borders)))


# -- candidates ------------------------------------------------------------


def prefix_length(n: int, percent: int) -> int:
    """How many first n-grams of a set of ``n`` must hold one of every set similar to it."""
    return n + (-percent * n // 100) + 1 if n else 0


def _early_tokens(docs: DataFrame, order: Broadcast[Order], params: JoinParams) -> DataFrame:
    """(token, class, place): the first n-grams of every set, once for each task that has the class.

    ``place`` is ``n << 32 | pos``, the size of the set and where the n-gram stands in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = order.value, set()
        for _, found in _sets(batches, params.size):
            tokens, classes, places = [], [], []
            for s in found:
                key = class_of(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                first = held.tokens(s)[: prefix_length(len(s), params.percent)]
                tokens.append(first)
                classes.append(np.full(len(first), key))
                places.append((len(s) << 32) + np.arange(len(first)))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (tokens, classes, places)], ["token", "class", "place"]
                )

    return docs.select("text").mapInArrow(run, "token long, class long, place long")


def shared_tokens(docs: DataFrame, order: Broadcast[Order], params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Early n-grams that more than one class has, as (large groups, meetings in small groups).

    Rows (token, class, n, pos, reach) of groups of more than ``small`` classes, and of tokens of hot buckets, which are
    spread over salts and kept unasked. In the other groups classes meet at once, as far as they are plausible.
    ``reach`` is what is left of the set from the token on: a bound on the overlap with classes that share
    no earlier one.
    """
    early = _early_tokens(docs, order, params)
    hot = F.col("token") >= F.lit(min(order.value.hot_level, 63) << HASH_BITS)
    salt = F.when(hot, F.pmod(F.col("class"), F.lit(64))).otherwise(F.lit(0)).cast("int")
    group = Window.partitionBy("token", "salt")
    ends = early.withColumn("salt", salt).select(
        "*", F.min("class").over(group).alias("least"), F.max("class").over(group).alias("most")
    )
    n, pos = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    ends = ends.where(hot | (F.col("least") < F.col("most"))).select(
        "token", "salt", "class", n.alias("n"), pos.alias("pos"), (n - pos).alias("reach")
    )
    # of a small group the frame holds all classes before the row, of a large one it is not used
    before = group.orderBy("class").rowsBetween(1 - params.small, -1)
    facts = F.struct(*(F.col(c).alias(f"{c}2") for c in ("class", "n", "pos", "reach")))
    rows = ends.select(
        *("token", "class", "n", "pos", "reach"),
        (hot | (F.count(F.lit(1)).over(group) > params.small)).alias("large"),
        F.collect_list(facts).over(before).alias("others"),
    )
    near = F.filter(
        "others",
        lambda o: (o["class2"] != F.col("class"))
        & _enough(F.least("reach", o["reach2"]), F.col("n"), o["n2"], params.percent),
    )
    none = F.filter("others", lambda _: F.lit(False))
    rows = rows.withColumn("others", F.when(F.col("large"), none).otherwise(near))
    rows = write_shared(rows.where("large OR size(others) > 0"), "shared")
    names = ["token", "class", "n", "pos", "reach"]
    small = rows.where("NOT large").select(*names, F.inline("others")).distinct()
    return rows.where("large").select(*names).distinct(), small


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def _plausible(params: JoinParams) -> Column:
    """Whether sizes and reaches of two classes (the second has names with a 2) let them be similar."""
    return _enough(F.least("reach", "reach2"), F.col("n"), F.col("n2"), params.percent)


def _second(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}2" for c in df.columns if c != "token"})


def _meeting(met: DataFrame) -> DataFrame:
    return met.select("token", "class", "n", "pos", "class2", "n2", "pos2")


def _pairs(met: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b, n, n2) from rows in which two classes meet at a token, unless their places rule them out.

    What they share up to the last common early n-gram is counted, and after it no more can follow than the shorter rest.
    """
    swap = F.col("class") > F.col("class2")
    sides = met.select(
        F.least("class", "class2").alias("a"),
        F.greatest("class", "class2").alias("b"),
        *(F.when(swap, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("n", "pos")),
        *(F.when(swap, F.col(c)).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in ("n", "pos")),
    )
    grouped = sides.groupBy("a", "b").agg(
        F.max("n").alias("n"),
        F.max("n2").alias("n2"),
        F.count(F.lit(1)).alias("common"),
        F.max("pos").alias("pos"),
        F.max("pos2").alias("pos2"),
    )
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) - 1
    return grouped.where(_enough(F.col("common") + rest, F.col("n"), F.col("n2"), params.percent)).select(
        "a", "b", "n", "n2"
    )


def _hub_meetings(met: DataFrame, params: JoinParams, number: int) -> DataFrame:
    """Rows of each token's group beside one of its classes: that with most reach, or one drawn by hash."""
    facts = F.struct(*(c for c in met.columns if c != "token"))
    by = F.col("reach") / F.col("n") if number == 0 else F.lit(0.0)
    draw = F.xxhash64("class", F.lit(number))
    hub = F.max_by(facts, F.struct(by, draw)).alias("hub")
    hubs = met.groupBy("token").agg(hub, F.count(F.lit(1)).alias("size"))
    hubs = hubs.select("token", "size", *(F.col(f"hub.{c}").alias(f"{c}2") for c in met.columns if c != "token"))
    joined = met.join(hubs, "token")
    return joined.where((F.col("class") != F.col("class2")) & (F.col("label") != F.col("label2")) & _plausible(params))


def _all_meetings(met: DataFrame, params: JoinParams) -> DataFrame:
    """All pairs of classes that share a token and are still apart."""
    return met.join(_second(met), "token").where((F.col("label") < F.col("label2")) & _plausible(params))


# -- overlaps --------------------------------------------------------------


def _marks(chosen: DataFrame, params: JoinParams) -> np.ndarray:
    """Bits of the hashes in column ``print``, as a filter of bounded size that lets all of them pass, and few others."""
    wanted = chosen.count()
    bits = 1 << min(max(64 * wanted, 1 << 20).bit_length(), params.filter_bits)
    place = F.pmod("print", F.lit(bits)) + 1  # bitmaps count from one
    bitmaps = chosen.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )
    found = np.zeros(bits + (1 << 15), bool)
    # at most ``bits`` bits come to the driver
    for row in bitmaps.toLocalIterator():
        at = (row["bucket"] - 1) << 15
        found[at : at + (1 << 15)] = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8), bitorder="little")
    return np.packbits(found[:bits])


def segments(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, order: Broadcast[Order], params: JoinParams
) -> DataFrame:
    """(class, fragment, tokens): sets of all classes of ``pairs``, cut at the borders of the fragments.

    Of each class one text is wanted, known by its hash. Texts that the filter lets pass are read once more; it may
    let other classes pass, which meet no pair.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen = classes.join(wanted, "class").groupBy("class").agg(F.min("print").alias("print"))
    marks = _marks(write_shared(chosen, "chosen"), params)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, seen = order.value, shared.value, set()
        for batch in batches:
            place = batch.column(1).to_numpy() % (8 * len(marks))
            batch = batch.filter(pa.array(marks[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 == 1))
            keys, numbers, parts = [], [], []
            for text in batch.column(0):
                found = shingles(text.as_py(), params.size)
                key = class_of(found)
                if key in seen:
                    continue
                seen.add(key)
                tokens = held.tokens(found)
                for i, part in enumerate(np.split(tokens, np.searchsorted(tokens, held.borders))):
                    if len(part):
                        keys.append(key)
                        numbers.append(i)
                        parts.append(part)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32))
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
                ["class", "fragment", "tokens"],
            )

    rows = docs.select("text", F.xxhash64("text").alias("print"))
    cut = rows.mapInArrow(run, "class long, fragment int, tokens array<long>")
    # dealt by class, for the copies to drop and for the join that follows
    return cut.repartition("class").dropDuplicates(["class", "fragment"])


def linked(pairs: DataFrame, cut: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b, n, n2) that are similar: partial overlaps per fragment, summed per pair."""
    one = cut.select(F.col("class").alias("a"), "fragment", F.col("tokens").alias("tokens_a"))
    two = cut.select(F.col("class").alias("b"), "fragment", F.col("tokens").alias("tokens_b"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"])
    partial = partial.select("a", "b", "n", "n2", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("overlap"))
    sums = partial.groupBy("a", "b", "n", "n2").agg(F.sum("overlap").alias("overlap"))
    return sums.where(_enough(F.col("overlap"), F.col("n"), F.col("n2"), params.percent)).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    """(class, root): components of linked classes."""
    return write_shared(components(links).select(F.col("node").alias("class"), F.col("label").alias("root")), "roots")


def _labelled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of groups that have classes of different components, with the component as ``label``."""
    rows = met.drop("label").join(roots, "class", "left")
    rows = write_shared(rows.select(*met.columns[:5], F.coalesce("root", "class").alias("label")), "labelled")
    apart = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    return write_shared(rows.join(apart.select("token"), "token", "left_semi"), "apart")


def _still_apart(small: DataFrame, roots: DataFrame) -> DataFrame:
    """Meetings of classes of different components."""
    one, two = roots.withColumnRenamed("root", "label"), _second(roots)
    rows = small.join(one, "class", "left").join(two, "class2", "left")
    return rows.where(F.coalesce("label", "class") != F.coalesce("root2", "class2"))


def class_links(docs: DataFrame, classes: DataFrame, order: Broadcast[Order], params: JoinParams) -> DataFrame:
    """Links (a, b) that connect all classes that are connected by similar sets."""

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = write_shared(pairs, "pairs")
        return write_shared(linked(pairs, segments(docs, classes, pairs, order, params), params), "links")

    large, small = shared_tokens(docs, order, params)
    met, links, roots = write_shared(large.withColumn("label", F.col("class")), "large"), None, None
    for number in range(params.hub_rounds):
        if met.isEmpty():
            break
        meetings = _hub_meetings(met, params, number)
        if number and _few_meetings(met, meetings, params):
            break
        found = similar(_distinct_pairs(meetings))
        links = found if links is None else links.unionByName(found)
        roots = _roots(links)
        met = _labelled(met, roots)
    # the places of a hub's pairs are known for its tokens only, so just this last round can use them
    rest = _meeting(_all_meetings(met, params)).unionByName(_meeting(_still_apart(small, roots) if roots else small))
    found = similar(_pairs(rest, params))
    return found if links is None else links.unionByName(found)


def _few_meetings(apart: DataFrame, meetings: DataFrame, params: JoinParams) -> bool:
    """Whether all meetings are not many more than the rows, judged by those with a hub drawn by hash."""
    return (meetings.agg(F.sum("size")).first()[0] or 0) / 2 <= params.few_meetings * apart.count()


def _distinct_pairs(meetings: DataFrame) -> DataFrame:
    swap = F.col("class") > F.col("class2")
    return meetings.select(
        F.least("class", "class2").alias("a"),
        F.greatest("class", "class2").alias("b"),
        F.when(swap, F.col("n2")).otherwise(F.col("n")).alias("n"),
        F.when(swap, F.col("n")).otherwise(F.col("n2")).alias("n2"),
    ).distinct()


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_shingles, component_id).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. A text of fewer words than
    an n-gram has is one n-gram; one without words, or null, has an empty set and is linked with
    nothing, so its component is its own doc_id. component_id is the smallest doc_id that links lead to (null if all
    of the component are null). Repeated rows and copies are linked, and answered each time; rows with
    equal ids are told apart by their texts. Whole texts count, however long. An empty table gives none;
    other columns are not read. Sets are compared by 57-bit hashes of n-grams, classes by 64-bit hashes.
    """
    found = write_shared(_classes_and_sketch(docs, params), "classes")
    classes = found.where("piece IS NULL").select("doc_id", "print", "n", "class")
    order = global_order(found.where("piece IS NOT NULL").select("piece", "counts"), params)
    order = docs.sparkSession.sparkContext.broadcast(order)
    roots = _roots(class_links(docs, classes.where("n > 0"), order, params))
    rows = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")
    )
