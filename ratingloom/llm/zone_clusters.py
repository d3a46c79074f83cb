"""Centroid clustering over zone maps: blocks along a space-filling curve, with min/max boxes.

Vectors are turned into integers and sorted along a Hilbert curve through
their first principal axes, so that neighbours on the curve are neighbours in
space. Consecutive vectors make a block, stored with the box that holds it:
its least and greatest coordinate on every principal axis. Axes come from the
second moments of all vectors.

In each round a block first asks its box which centroids it can need. How much
further a point is from centroid c than from the centroid c0 nearest to the
box is linear in the point, so its least value over the box is a sum over
axes; where that is positive, no vector of the block can choose c. Vectors are
compared exactly, in integers, with the centroids that are left. Blocks add up
their vectors per cluster, tasks add up their blocks, and Spark the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import write_shared

#: Components are kept within this bound, so that squared distances stay in 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class ClusterParams:
    """``k`` centroids, moved in ``rounds`` rounds; components become floor(``scale`` * x); vectors of other
    than ``dim`` components are left out. The curve runs through ``axes`` axes of ``bits`` bits each; a block
    holds ``block`` vectors. ``seed`` picks the first centroids.
    """

    k: int = 40
    rounds: int = 5
    scale: float = 256.0
    dim: int = 64
    axes: int = 7
    bits: int = 8
    block: int = 256
    seed: int = 2


def usable(vectors: DataFrame, params: ClusterParams) -> DataFrame:
    """(vec_id, v): integer vectors of the right length, without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bound = F.lit(float(LARGEST))
    whole = F.transform("x", lambda c: F.greatest(F.least(F.floor(c * params.scale), bound), -bound).cast("int"))
    rows = vectors.select("vec_id", x.alias("x")).where((F.size("x") == params.dim) & ~odd)
    return rows.select("vec_id", whole.alias("v"))


def first_centroids(rows: DataFrame, params: ClusterParams) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # k rows
    found = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(params.k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(-1, params.dim)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows of coordinates below ``2**bits``), as 64-bit numbers.

    The coordinates are turned into the transposed index (Skilling, 2004), all rows at once, and
    its bits are then read across the axes.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & high) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        carry ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= carry
    place = np.zeros_like(carry)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


@dataclass(frozen=True)
class Axes:
    """Principal axes (as columns, the widest first) with the centre and the spread of all vectors on them."""

    turn: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def places(self, values: np.ndarray, params: ClusterParams) -> np.ndarray:
        """Place of each vector on the curve; cells reach three spreads to both sides of the centre."""
        n = min(params.axes, values.shape[1])
        x = (values.astype(np.float64) @ self.turn[:, :n] - self.centre[:n]) / np.maximum(self.spread[:n], 1e-9)
        most = (1 << params.bits) - 1
        return hilbert(np.clip(np.floor((x + 3) / 6 * (most + 1)), 0, most).astype(np.int64), params.bits)


def principal_axes(rows: DataFrame, params: ClusterParams) -> Axes:
    """Axes from the first and second moments of all vectors, summed up in tasks and then in Spark."""
    d = params.dim

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().reshape(-1, d).astype(np.float64)
            v = np.hstack((v, np.ones((len(v), 1))))
            total += v.T @ v
        columns = [pa.array(range(d + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "sums"])

    parts = rows.select("v").mapInArrow(moments, "place int, sums array<double>")
    sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(d + 1)]
    # one row per component
    found = {r["place"]: r[1:] for r in parts.groupBy("place").agg(*sums).collect()}
    table = np.array([found.get(i, np.zeros(d + 1)) for i in range(d + 1)], np.float64)
    n = max(table[d, d], 1.0)
    mean = table[d, :d] / n
    widths, turn = np.linalg.eigh(table[:d, :d] / n - np.outer(mean, mean))
    widths, turn = widths[::-1], turn[:, ::-1].copy()
    return Axes(turn, mean @ turn, np.sqrt(np.maximum(widths, 0)))


_BLOCKS = "ids array<long>, vals binary, low binary, high binary"


def zone_blocks(rows: DataFrame, axes: Axes, params: ClusterParams) -> DataFrame:
    """Vectors in curve order as blocks: ids, integer values, and the box on the axes."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, params.dim)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(axes.places(v, params))], ["vec_id", "v", "place"]
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, params.block):
                part = batch.slice(a, params.block)
                v = part.column(1).flatten().to_numpy().reshape(-1, params.dim).astype("<i4")
                turned = v.astype(np.float64) @ axes.turn
                columns = [[part.column(0).to_pylist()], [v.tobytes()], [turned.min(0).tobytes()], [turned.max(0).tobytes()]]
                kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "vals", "low", "high"])

    tasks = max(1, -(-rows.count() // (params.block * 32)))
    keyed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(
        placed, "vec_id long, v array<int>, place long"
    )
    # many vectors may share a place: the hash lets a range end between them
    keyed = keyed.withColumn("late", F.xxhash64("vec_id", "v"))
    ordered = keyed.repartitionByRange(tasks, "place", "late").sortWithinPartitions("place", "late")
    return ordered.select("vec_id", "v").mapInArrow(packed, _BLOCKS)


class Chooser:
    """Nearest centroids of the vectors of a block."""

    def __init__(self, centroids: np.ndarray, axes: Axes):
        self.centroids, self.axes = centroids, axes
        self.turned = centroids.astype(np.float64) @ axes.turn
        self.squares = (centroids * centroids).sum(1)
        self.largest = float(np.abs(centroids).max(initial=0))

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Centroids that a vector in the box can be nearest to, in order."""
        c = self.turned
        middle = (low + high) / 2
        best = int(((c - middle) ** 2).sum(1).argmin())
        # |p-c|^2 - |p-best|^2 = |c|^2 - |best|^2 - 2 p(c - best), least over all p of the box
        step = c - c[best]
        reach = np.maximum(step * low, step * high).sum(1)
        least = (c * c).sum(1) - (c[best] ** 2).sum() - 2 * reach
        # more than rounding can take from it
        bound = float(max(np.abs(low).max(), np.abs(high).max(), self.largest, 1.0))
        return np.flatnonzero(least <= 1e-9 * bound * bound * len(low))

    def choose(self, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, and how many exact distances that took."""
        near = self.candidates(low, high)
        c = self.centroids[near]
        most = max(float(np.abs(v).max(initial=0)), self.largest)
        if most * most * v.shape[1] < 2**52:  # doubles are exact
            product = (v.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        else:
            product = v @ c.T
        gap = self.squares[near] - 2 * product
        which = gap.argmin(1)  # the first of equals has the smaller number
        return near[which], gap[np.arange(len(v)), which] + (v * v).sum(1), len(v) * len(near)


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    ids, vals, low, high = (batch.column(i) for i in range(4))
    for i in range(batch.num_rows):
        v = np.frombuffer(vals[i].as_py(), "<i4").reshape(-1, dim).astype(np.int64)
        yield ids[i].values, v, np.frombuffer(low[i].as_py()), np.frombuffer(high[i].as_py())


def moved(blocks: DataFrame, centroids: np.ndarray, axes: Axes, params: ClusterParams) -> tuple[np.ndarray, int]:
    """Centroids after a round, and how many exact distances it took."""
    d = params.dim

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser, total, compared = Chooser(centroids, axes), np.zeros((len(centroids), d + 1), np.int64), 0
        for batch in batches:
            for _, v, low, high in _unpacked(batch, d):
                cluster, _, cost = chooser.choose(v, low, high)
                compared += cost
                total[:, d] += np.bincount(cluster, minlength=len(total))
                for c in np.unique(cluster):
                    total[c, :d] += v[cluster == c].sum(0)
        held = np.flatnonzero(total[:, d])
        columns = [pa.array(held, pa.int32()), pa.array(list(total[held]), pa.list_(pa.int64()))]
        columns.append(pa.array([compared] + [0] * (len(held) - 1) if len(held) else [], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "sums", "compared"])

    parts = blocks.mapInArrow(sums, "cluster int, sums array<long>, compared long")
    added = [F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(d + 1)]
    after, compared = centroids.copy(), 0
    # k rows
    for row in parts.groupBy("cluster").agg(F.sum("compared"), *added).collect():
        n = int(row[d + 2])
        after[row["cluster"]] = [int(s) // n for s in row[2 : d + 2]]
        compared += row[1]
    return after, compared


def assigned(blocks: DataFrame, centroids: np.ndarray, axes: Axes, params: ClusterParams) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Chooser(centroids, axes)
        for batch in batches:
            for ids, v, low, high in _unpacked(batch, params.dim):
                cluster, distance, _ = chooser.choose(v, low, high)
                columns = [ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, params: ClusterParams = ClusterParams()) -> tuple[DataFrame, np.ndarray, Axes]:
    """(blocks, centroids, axes) after all rounds."""
    rows = write_shared(usable(vectors, params), "vectors")
    centroids = first_centroids(rows, params)
    axes = principal_axes(rows, params)
    blocks = write_shared(zone_blocks(rows, axes, params), "zones")
    for _ in range(params.rounds if len(centroids) else 0):
        centroids, _ = moved(blocks, centroids, axes, params)
    return blocks, centroids, axes


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def _hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, params: ClusterParams = ClusterParams()) -> DataFrame:
    """``vectors`` (vec_id, embedding) as (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    ``distance`` is squared, inertias are its sums over the cluster and over all, and the hash is that
    of the cluster's final centroid. Ties go to the centroid of the smaller number. A vector that is null,
    of another length, or has a null, NaN or infinite component takes no part; components beyond
    2**26 count as 2**26, and an inertia beyond 64 bits is null. Repeated rows count, and are answered, each
    time; a null vec_id is hashed as the empty text, and equal hashes are ordered by their vectors. With
    fewer than k vectors each is a first centroid; an empty table gives no rows. Other columns are not read.
    """
    blocks, centroids, axes = fit(vectors, params)
    spark = vectors.sparkSession
    found = write_shared(assigned(blocks, centroids, axes, params), "assigned") if len(centroids) else None
    if found is None:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    # k rows
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    total = _long(sum(int(r["sum"]) for r in sums))
    facts = spark.createDataFrame(
        [(r["cluster"], _long(int(r["sum"])), total, _hash(centroids[r["cluster"]])) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
