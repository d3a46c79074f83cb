"""Mixing sources to target weights by entropy balancing.

Targets come from a water level: sources share the budget by weight, none
gets more than ``cap`` times its size. Document rates are then the ones nearest
to 1 in relative entropy that give every source its target of tokens (and its
share of documents, so that a source keeps its length profile). They have the
form min(cap, exp(a + b * length)); a and b solve the convex dual of the source,
by Newton steps whose gradients and Hessians Spark sums up. As both targets are
the same ratio of their source, b is 0 at the solution and every document of a
source has the rate target / source size. Rates are rounded
into copies: the whole part is taken, and further copies go to documents in
hash order, by rate, until the target is reached exactly; the document on the
border gives part of its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.common import n_words
from ratingloom.session import write_shared


@dataclass(frozen=True)
class MixParams:
    """``weights`` are given to the sources in turn, by code point, null last; together they get
    ``budget`` times all tokens, each at most ``cap`` times its own, as does each document.
    Newton steps end when no source is off its target by ``tolerance`` of it, or after ``max_steps``.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    cap: float = 2.0
    tolerance: float = 1e-10
    max_steps: int = 60


def _with_facts(docs: DataFrame, facts: DataFrame, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join documents with one row per ``key`` (a source), a hot source being dealt over ``salts`` tasks."""
    many = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int")
    return docs.withColumn("salt", salt).join(many, ["key", "salt"], how).drop("salt")


def _numbered(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without a single task for all."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
    placed = write_shared(ranged.withColumn("part", F.spark_partition_id()), "sources")
    # one row per partition of the table of sources
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    row = F.col("start") + F.row_number().over(order) - 1
    return placed.join(starts, "part").select("source", "source_size", "source_docs", row.alias("number"))


def source_targets(sized: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``sized`` (source, size) as (source, source_size, source_docs, target).

    The level rises while it caps further sources: each round takes out the
    capped ones and shares what is left by weight among the rest. An empty
    table, or one without any word, has targets of zero.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    turn = F.array(*(F.lit(w) for w in params.weights))
    numbered = _numbered(totals)
    weight = F.get(turn, (F.col("number") % len(params.weights)).cast("int"))
    weighed = write_shared(numbered.select("source", "source_size", "source_docs", weight.alias("weight")), "weighed")
    limit = F.col("source_size") * params.cap
    everything = (weighed.agg(F.sum("source_size")).first()[0] or 0) * params.budget
    level, before = 0.0, None
    while level != before:
        before = level
        over = (F.col("weight") * level > limit) & F.lit(level > 0)
        capped, weight_left = weighed.agg(
            F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
        ).first()
        if weight_left:
            level = max(level, (everything - capped) / weight_left)
    return weighed.select(
        "source", "source_size", "source_docs", F.least(limit, F.col("weight") * level).alias("target")
    )


def solve(sized: DataFrame, targets: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Dual solution per source: (source, source_size, mean, target, a, b).

    Rates depend on source and size only, so documents are first counted by
    both; every Newton step is one aggregate over those counts.
    """
    usable = targets.where("source_size > 0").select(
        F.coalesce(F.to_json(F.struct("source")), F.lit("")).alias("key"),
        "source_size",
        "target",
        (F.col("source_size") / F.col("source_docs")).alias("mean"),
        (F.col("target") / F.col("source_size")).alias("ratio"),
        "source_docs",
    )
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = write_shared(counts.select(F.to_json(F.struct("source")).alias("key"), "size", "n"), "size_counts")
    dual = usable.select("*", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(False).alias("done"))
    dual = write_shared(dual, "dual")
    for _ in range(params.max_steps):
        z = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("a") + F.col("b") * z, F.lit(50.0)))
        rate = F.least(raw, F.lit(params.cap))
        # capped documents stay in the Hessian, so that a step beyond the cap finds its way back
        curve = rate * F.col("n")
        sums = (
            counts.join(dual.where("not done").select("key", "mean", "a", "b"), "key")
            .groupBy("key")
            .agg(
                F.sum(rate * F.col("n")).alias("docs"),
                F.sum(rate * F.col("n") * z).alias("tokens"),
                F.sum(curve).alias("h00"),
                F.sum(curve * z).alias("h01"),
                F.sum(curve * z * z).alias("h11"),
            )
        )
        stepped = dual.join(sums, "key", "left")
        want = F.col("ratio") * F.col("source_docs")
        g0, g1 = want - F.col("docs"), want - F.col("tokens")  # z has mean 1, so both targets are alike
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        solid = det > 1e-9 * F.col("h00") * F.col("h11")
        step_b = F.when(solid, (F.col("h00") * g1 - F.col("h01") * g0) / det).otherwise(0.0)
        step_a = F.when(solid, (F.col("h11") * g0 - F.col("h01") * g1) / det).otherwise(
            F.when(F.col("h01") > 0, g1 / F.col("h01")).otherwise(0.0)
        )
        size = F.greatest(F.abs(step_a), F.abs(step_b), F.lit(1.0))
        off = F.abs(g1) > params.tolerance * F.greatest(want, F.lit(1e-9))
        moving = ~F.col("done") & F.coalesce(off & ((F.col("h00") > 0)), F.lit(False))
        dual = write_shared(
            stepped.select(
                *usable.columns,
                # no target is above the cap, so neither is the solution
                F.when(moving, F.least(F.col("a") + step_a / size, F.lit(math.log(params.cap))))
                .otherwise(F.col("a"))
                .alias("a"),
                F.when(moving, F.col("b") + step_b / size).otherwise(F.col("b")).alias("b"),
                (~moving).alias("done"),
            ),
            "dual",
        )
        if not dual.where("not done").limit(1).count():
            break
    return dual.select("key", "mean", "target", "a", "b")


def priority(key: Column) -> Column:
    """Uniform hash of a document key, the same in every run: 13 hex digits of its md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, params: MixParams = MixParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, source, size) as (doc_id, size, source_size, target, taken), and the columns to ``keep``.

    ``taken`` is the number of words the mix takes from the document, repeats
    counted; it is ``cap`` times ``size`` at most, and the words taken from a
    source add up to its target, rounded. A document without words gives none.
    A null source is a source of its own. Documents of equal hash, such as
    repeated rows, are taken in order of doc_id, then size, then the kept columns, then row. A column to
    keep that is named like a result gives way to it.
    """
    results = ("doc_id", "size", "source_size", "target", "taken")
    given = [c for c in keep if c not in results]
    # under names that no step uses
    keep = tuple(f"given column {i}" for i in range(len(given)))
    kept = (F.col(f"`{c}`").alias(k) for c, k in zip(given, keep))
    sized = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *kept)
    key = F.to_json(F.struct("source"))
    targets = write_shared(source_targets(sized, params), "targets")
    dual = solve(sized, targets, params)
    facts = targets.select(key.alias("key"), "source_size", F.col("target").alias("source_target"))
    facts = facts.join(dual.drop("target"), "key", "left")
    rated = _with_facts(sized.withColumn("key", key), facts)
    z = F.col("size") / F.col("mean")
    rate = F.least(F.exp(F.least(F.col("a") + F.col("b") * z, F.lit(50.0))), F.lit(params.cap))
    # a rate that rounding leaves next to a whole number is that number
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-6, F.round(rate)).otherwise(rate)
    whole = F.floor(rate).cast("long")
    part = rate - whole
    # the smaller the hash against the fractional rate, the sooner a document gets a further copy;
    # seven digits of the rate, so that the last bits of the solution cannot swap two documents
    late = F.when(part > 0, priority(F.col("doc_id")) / F.round(part, 7)).otherwise(float("inf"))
    rated = rated.select(
        "doc_id", "key", "size", "source_size", "source_target", F.coalesce(whole, F.lit(0)).alias("whole"),
        F.coalesce(late, F.lit(float("inf"))).alias("late"), *keep,
    )
    rated = write_shared(rated, "rated")
    return _rounded(rated, keep).toDF(*results, *given)


def _rounded(rated: DataFrame, keep: tuple[str, ...] = (), bins: int = 1024) -> DataFrame:
    """Give the missing tokens of each source to documents in order of ``late``.

    Tokens are first added up per source and bin of ``late``; only in the bin
    in which the target is reached are documents ordered one by one. A hot
    source therefore never meets in one task.
    """
    spread = F.when(F.col("late") < float("inf"), F.col("late"))
    most = rated.groupBy("key").agg(F.max(spread).alias("top"), F.count(spread).alias("n"))
    need = rated.groupBy("key", "source_target").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    need = need.select("key", (F.round("source_target").cast("long") - F.col("base")).alias("need"))
    # about as many bins as documents in a bin
    plan = need.join(most, "key").withColumn("n_bins", F.greatest(F.lit(bins), F.ceil(F.sqrt("n"))))
    binned = _with_facts(rated, plan).withColumn(
        "bin",
        F.when(F.col("late") == float("inf"), F.col("n_bins")).otherwise(
            F.floor(F.col("late") / F.col("top") * (F.col("n_bins") - 1))
        ),
    )
    per_bin = binned.where("late < double('inf')").groupBy("key", "bin").agg(
        F.sum("size").alias("tokens"), F.first("need").alias("need")
    )
    order = Window.partitionBy("key").orderBy("bin")
    per_bin = per_bin.withColumn("end", F.sum("tokens").over(order))
    per_bin = write_shared(per_bin.select("key", "bin", F.col("end") - F.col("tokens"), "end", "need").toDF(
        "key", "bin", "begin", "end", "need"), "bins")
    border = per_bin.where("begin < need and end >= need").select("key", F.col("bin").alias("border"), "begin")
    marked = _with_facts(binned, border, "left")
    edge = (F.col("bin") == F.col("border")) & (F.col("late") < float("inf"))
    edge = F.coalesce(edge, F.lit(False))
    inside = marked.where(edge)
    run = Window.partitionBy("key").orderBy("late", "doc_id", "size", *keep)
    so_far = F.col("begin") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - so_far))
    inside = inside.withColumn("extra", part)
    below = F.col("bin") < F.col("border")
    # without a border bin, the source needs all of its open documents, or none
    full = F.when(F.col("border").isNull(), F.col("need") > 0).otherwise(below)
    outside = marked.where(~edge).withColumn(
        "extra", F.when(full & (F.col("late") < float("inf")), F.col("size")).otherwise(0)
    )
    both = inside.unionByName(outside)
    return both.select(
        "doc_id",
        "size",
        "source_size",
        F.col("source_target").alias("target"),
        (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
        *keep,
    )


def mix_documents(docs: DataFrame, params: MixParams = MixParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, source, text) mixed by their numbers of words."""
    keep = tuple(c for c in keep if c not in ("doc_id", "source", "size"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *(F.col(f"`{c}`") for c in keep))
    return mix(write_shared(sized, "sized"), params, keep)
