"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into segments; with the mean and deviation of each segment, an
inner product is at most the sum of length * (mean * mean + deviation *
deviation) over the segments (which is to say that the distance of two vectors
has a lower bound in the same statistics). The bound gets tighter as segments
get shorter, and is exact at length one. Queries and candidates meet block by
block: the best candidates by bound set a threshold for each query, coarse to
fine bounds drop candidates below it, and survivors get their exact score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.session import write_shared


@dataclass(frozen=True)
class SearchParams:
    """``k`` neighbours; ``scale`` turns components into integers by floor(scale * x);
    ``levels`` are the numbers of segments, coarse to fine; about ``block`` vectors are in a block.
    """

    k: int = 20
    scale: float = 64.0
    levels: tuple[int, ...] = (2, 8, 16)
    block: int = 4096


def usable(vectors: DataFrame, params: SearchParams) -> DataFrame:
    """(vec_id, v): integer vectors; those null, or with null or non-finite components, are left out."""
    x = F.col("embedding").cast("array<double>")
    # a comparison of NaN or null components would not be false in Spark, hence the explicit tests
    fine = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * params.scale).cast("long"))
    rows = vectors.select(F.col("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL").where(fine)
    return rows.select("vec_id", whole.alias("v")).distinct()


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows as blocks of equal dimension: (dim, block, ids, values)."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        values = np.concatenate(group["v"].to_numpy()) if len(group["v"].iloc[0]) else np.zeros(0)
        ids = group["vec_id"].to_numpy(np.int64)
        return pd.DataFrame(
            {
                "dim": [int(group["dim"].iloc[0])],
                "block": [int(group["block"].iloc[0])],
                "ids": [ids.astype("<i8").tobytes()],
                "values": [values.astype("<i8").tobytes()],
            }
        )

    keyed = rows.select(
        "vec_id",
        "v",
        F.size("v").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
    )
    return keyed.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, values binary")


def _segments(dim: int, levels: tuple[int, ...]) -> list[list[tuple[int, int]]]:
    """Segment borders of each level that is coarser than the vector itself."""
    found = []
    for n in levels:
        if n < dim:
            edges = np.linspace(0, dim, n + 1).round().astype(int)
            found.append(list(zip(edges[:-1], edges[1:])))
    return found


def summaries(x: np.ndarray, borders: list[tuple[int, int]]) -> np.ndarray:
    """Means and deviations per segment, times the root of its length: their inner product is the bound."""
    parts = []
    for a, b in borders:
        part = x[:, a:b]
        parts += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(parts, 1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact while no sum can pass 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def block_top(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, params: SearchParams
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query row, candidate row, score) of a block for every query, ties to the smaller id."""
    k, slack = params.k, 1e-9
    x, y = q.astype(np.float64), c.astype(np.float64)
    own = q_ids[:, None] == c_ids[None, :]
    # more than rounding can take from a bound or a threshold
    margin = slack * (1 + np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max(initial=0))
    alive = ~own
    threshold = np.full(len(q), -np.inf)
    for level, borders in enumerate(_segments(q.shape[1], params.levels)):
        bound = summaries(x, borders) @ summaries(y, borders).T
        bound += margin[:, None]
        if level == 0 and len(c) > k:
            # exact scores of the k candidates that look best are a first threshold
            first = np.argpartition(np.where(own, -np.inf, bound), len(c) - k, axis=1)[:, len(c) - k :]
            scores = np.einsum("qd,qkd->qk", x, y[first])
            scores[np.take_along_axis(own, first, 1)] = -np.inf
            threshold = scores.min(1) - margin
        alive &= bound >= threshold[:, None]
    columns = np.flatnonzero(alive.any(0))
    scores = np.where(alive[:, columns], _exact(q, c[columns]), -np.iinfo(np.int64).max)
    if len(columns) > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        keep = alive[:, columns] & (scores >= kth[:, None])
    else:
        keep = alive[:, columns]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((c_ids[columns[cols]], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = rank < k
    return rows[best], columns[cols[best]], scores[rows[best], cols[best]]


def top_k(vectors: DataFrame, is_query: F.Column, params: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Score is the inner
    product of the integer vectors, ties go to the smaller vec_id. A vector that is null or has a
    null, NaN or infinite component takes no part; vectors of unlike length do not meet. Repeated
    rows count once; a vec_id with several vectors is a candidate with each, asks with each, and never
    meets itself. Fewer than k candidates give fewer rows; no vectors, or no queries, none.
    """
    rows = write_shared(usable(vectors, params), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // params.block))
    n_queries = rows.where(is_query).count()
    query_blocks = max(1, -(-n_queries // params.block))
    stored = write_shared(_packed(rows, blocks), "blocks")
    asked = _packed(rows.where(is_query), query_blocks).withColumnsRenamed(
        {"block": "q_block", "ids": "q_ids", "values": "q_values"}
    )
    # every block of queries goes to every block of candidates
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = asked.join(stored, ["dim", "block"])
    pairs = pairs.repartition(blocks * query_blocks, "q_block", "block")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids, c_ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
                q = np.frombuffer(row.q_values, "<i8").reshape(len(q_ids), row.dim)
                c = np.frombuffer(row.values, "<i8").reshape(len(c_ids), row.dim)
                for a in range(0, len(q_ids), 1024):
                    i, j, score = block_top(q_ids[a : a + 1024], q[a : a + 1024], c_ids, c, params)
                    yield pd.DataFrame({"query_id": q_ids[a + i], "vec_id": c_ids[j], "score": score})

    met = pairs.select("dim", "q_ids", "q_values", "ids", "values").mapInPandas(
        search, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
