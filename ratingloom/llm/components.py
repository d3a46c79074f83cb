"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.session import write_shared


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs as (node, label), the label being the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours to the smallest
    of them. The edge table never grows, and halves the depth of every tree, so
    rounds grow with the logarithm of the longest chain. Each round is written
    to the shared folder. Loops, repeated edges and an empty table are fine;
    only nodes with an edge to another node are returned.
    """
    down = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = write_shared(edges.where("a <> b").select(*down).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(both.where("v < u").join(least, "u").select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(small_least, "u")
        small = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_shared(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
