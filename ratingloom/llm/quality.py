"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

Statistics are built-in expressions over the whole text. Rules are learned
from labelled rows by sequential covering: conditions on quantile thresholds
are added to a rule while they help on a growing fold, taken off again while
that helps on a pruning fold, and the rows a rule covers are set aside for the
next one. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.common import SPACE, WORD, let
from ratingloom.session import write_shared

#: Words in a window, and the limits of the base rules.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class CoveringParams:
    """thresholds of a feature lie between its values where there are up to ``few``, else between its ``bins`` quantiles
    and further ones at both ends, each half as far from the end as the one before, of all rows and of the bad ones;
    a rule has ``max_conditions`` conditions at most, must be right on ``precision`` of the pruning rows it covers and
    cover ``min_covered`` of them. The list ends when a rule does not.
    """

    bins: int = 32
    few: int = 64
    max_conditions: int = 3
    precision: float = 0.95
    min_covered: int = 5


def _repeated(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the text.

    Windows are compared by their 64-bit hash.
    """
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1

        def at(entry: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(ordered, k - 1)["h"] == entry["h"])
            after = (k < last) & (F.get(ordered, k + 1)["h"] == entry["h"])
            return F.when(before | after, entry["i"])

        starts = F.array_sort(F.filter(F.transform(ordered, at), lambda i: i.isNotNull()))
        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        more = F.aggregate(
            starts,
            begin,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        )
        return more["n"]

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    return let(hashes, count)


def _stutters(words: Column) -> Column:
    """Words equal to the word before them."""
    same = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b)
    return F.size(F.filter(same, lambda x: x))


def statistics(text: Column) -> Column:
    """All statistics of a text as one struct of longs; a null or empty text has zeros."""
    whole = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        words = F.filter(F.split(t, SPACE), lambda w: w != "")
        counts = let(
            words,
            lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated"), _stutters(w).alias("stutters")),
        )
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("unlike")))
        facts = F.struct(counts.alias("w"), line_counts.alias("l"))
        fields = {
            "n_words": lambda x: x["w"]["n"],
            "word_chars": lambda x: F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]")),
            "n_symbols": lambda x: F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
            "n_dup_lines": lambda x: x["l"]["n"] - x["l"]["unlike"],
            "n_repeat_words": lambda x: x["w"]["repeated"],
            "n_stutters": lambda x: x["w"]["stutters"],
            "n_lines": lambda x: x["l"]["n"],
            "n_upper": lambda x: F.regexp_count(t, F.lit("[A-Z]")),
            "n_digits": lambda x: F.regexp_count(t, F.lit("[0-9]")),
            "n_stops": lambda x: F.regexp_count(t, F.lit(r"[.!?]")),
            "n_loud": lambda x: F.regexp_count(t, F.lit("!")),
        }
        return let(facts, lambda x: F.struct(*(f(x).cast("long").alias(k) for k, f in fields.items())))

    return let(whole, of)


def base_failed(s: Column) -> Column:
    few = s["n_words"] < MIN_WORDS
    return few | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def features(s: Column) -> dict[str, Column]:
    """What rules may test: counts and rates of the statistics struct."""
    words = F.greatest(s["n_words"], F.lit(1))
    chars = F.greatest(s["word_chars"], F.lit(1))
    return {
        "n_words": s["n_words"].cast("double"),
        "word_length": s["word_chars"] / words,
        "symbol_rate": s["n_symbols"] / words,
        "dup_line_rate": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeat_rate": s["n_repeat_words"] / words,
        "stutter_rate": s["n_stutters"] / words,
        "upper_rate": s["n_upper"] / chars,
        "digit_rate": s["n_digits"] / chars,
        "stop_rate": s["n_stops"] / words,
        "loud_rate": s["n_loud"] / words,
        "words_per_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def test(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


class DecisionList:
    """Ordered rules, each a conjunction; a row that no rule covers is kept."""

    def __init__(self, rules: list[tuple[Condition, ...]]):
        self.rules = rules

    def rejected_by(self, s: Column) -> Column:
        """Number (from 1) of the first rule that covers the row, or null."""
        values, verdict = features(s), None
        for number, rule in enumerate(self.rules, 1):
            met = F.lit(True)
            for condition in rule:
                met = met & condition.test(values)
            verdict = F.when(met, number) if verdict is None else verdict.when(met, number)
        return F.lit(None).cast("int") if verdict is None else verdict

    def __str__(self) -> str:
        return "\n".join(f"{i}: reject if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules, 1))


def learn(labelled: DataFrame, params: CoveringParams = CoveringParams()) -> DecisionList:
    """Decision list for rejecting ``bad`` rows of ``labelled`` (doc_id, s statistics struct, bad boolean).

    All labelled rows count. They are reduced to cells of equal bins
    with counts; each step of the search is one aggregate over the cells and
    brings back a count per feature and bin. Without labelled rows of both
    kinds the list is empty, so that everything is kept. Equal gains go to the
    feature and threshold listed first. Rows without a label are left out.
    """
    values = features(F.col("s"))
    names = list(values)
    rows = labelled.where(F.col("bad").isNotNull()).select(
        "bad",
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"),
        *(v.alias(k) for k, v in values.items()),
    )
    rows = write_shared(rows, "labelled_statistics")
    ends = [0.5**j / params.bins for j in range(1, 11)]
    steps = sorted([k / params.bins for k in range(params.bins + 1)] + ends + [1 - x for x in ends])
    asked = rows.agg(
        F.count(F.lit(1)),
        *(F.percentile_approx(k, steps, 100_000) for k in names),
        *(F.percentile_approx(F.when(F.col("bad"), F.col(k)), steps, 100_000) for k in names),
        *(F.approx_count_distinct(k) for k in names),
    ).first()
    if not asked[0]:
        return DecisionList([])
    n = len(names)
    levels = {k: sorted({*asked[1 + i], *(asked[1 + n + i] or [])}) for i, k in enumerate(names)}
    few = [k for k, count in zip(names, asked[1 + 2 * n :]) if count <= params.few]
    if few:
        levels |= {k: sorted(v) for k, v in zip(few, rows.agg(*(F.collect_set(k) for k in few)).first())}
    # halfway between neighbouring levels, so that a rule stays clear of the values on either side
    cuts = {k: [(a + b) / 2 for a, b in zip(q, q[1:])] for k, q in levels.items()}

    def bin_of(name: str) -> Column:
        limits = F.array(*(F.lit(float(c)) for c in cuts[name])).cast("array<double>")
        return F.size(F.filter(limits, lambda c: F.col(name) > c)).cast("short").alias(name)

    binned = rows.select("bad", "pruning", *(bin_of(k) for k in names))
    cells = write_shared(binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("n")), "cells")

    def met(rule) -> Column:
        test = F.lit(True)
        for c in rule:
            test = test & (F.col(c.feature) > c.bin if c.above else F.col(c.feature) <= c.bin)
        return test

    def best_condition(left: DataFrame, rule: list[Condition]) -> Condition | None:
        entries = F.array(*(F.struct(F.lit(i).alias("f"), F.col(k).alias("b")) for i, k in enumerate(names)))
        grown = left.where(~F.col("pruning") & met(rule)).select("bad", "n", F.explode(entries).alias("e"))
        found = grown.groupBy("e.f", "e.b").agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"),
            F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q"),
        )
        counts = {(r["f"], r["b"]): (r["p"], r["q"]) for r in found.collect()}
        everything = [v for (f, _), v in counts.items() if f == 0]
        p0, q0 = sum(p for p, _ in everything), sum(q for _, q in everything)
        if not p0 or not q0:
            return None
        before, best, gain = math.log2(p0 / (p0 + q0)), None, 1e-9
        for i, name in enumerate(names):
            p = q = 0
            for b, cut in enumerate(cuts[name]):
                p, q = p + counts.get((i, b), (0, 0))[0], q + counts.get((i, b), (0, 0))[1]
                for above, pp, qq in ((False, p, q), (True, p0 - p, q0 - q)):
                    if pp and (g := pp * (math.log2(pp / (pp + qq)) - before)) > gain:
                        best, gain = Condition(name, above, cut, b), g
        return best

    rules: list[tuple[Condition, ...]] = []
    left = cells
    while True:
        rule: list[Condition] = []
        while len(rule) < params.max_conditions and (more := best_condition(left, rule)) is not None:
            rule.append(more)
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            covered = met(rule[:k]) & F.col("pruning")
            sums += [F.sum(F.when(covered & F.col("bad"), F.col("n")).otherwise(0))]
            sums += [F.sum(F.when(covered & ~F.col("bad"), F.col("n")).otherwise(0))]
        tested = left.agg(*sums).first()
        scores = [(tested[2 * k] or 0, tested[2 * k + 1] or 0) for k in range(len(rule))]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in scores]
        size = max(range(len(rule)), key=lambda k: (worth[k], -k)) + 1
        p, q = scores[size - 1]
        if p + q < params.min_covered or p < params.precision * (p + q):
            break
        rules.append(tuple(rule[:size]))
        left = left.where(~met(rule[:size]))
        if len(rules) % 8 == 0:
            left = write_shared(left, "cells_left")  # a long list does not make long plans
    return DecisionList(rules)


def judge(rated: DataFrame, labels: DataFrame, params: CoveringParams = CoveringParams()) -> tuple[Column, DecisionList]:
    """Learn from ``rated`` (doc_id, s) joined with ``labels`` (doc_id, quality); return the verdict on ``s``.

    Only rows that pass the base rules teach. A label that is null, or of a
    document that is not there, does not count; a document labelled twice
    counts twice.
    """
    known = rated.where(~base_failed(F.col("s"))).join(labels.select("doc_id", "quality"), "doc_id")
    rules = learn(known.select("doc_id", "s", (F.col("quality") == 0).alias("bad")), params)
    return ~base_failed(F.col("s")) & rules.rejected_by(F.col("s")).isNull(), rules


def rate(docs: DataFrame, labels: DataFrame, params: CoveringParams = CoveringParams()) -> tuple[DataFrame, DecisionList]:
    """``docs`` (with doc_id and text) with a struct ``s`` of statistics and a boolean ``kept``.

    A null or empty text has no words and fails the base rules. Repeated rows
    are judged alike. The table with the statistics is written once and read
    for learning and for judging. Columns of ``docs`` named ``s`` or ``kept`` give way to the results.
    """
    rated = write_shared(docs.withColumn("s", statistics(F.col("text"))), "quality")
    kept, rules = judge(rated.select("doc_id", "s"), labels, params)
    return rated.withColumn("kept", kept), rules
