"""Ranking and normalisation of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are rounded before they are ranked, so that the order in which
#: executors add up floating-point parts cannot swap two equal scores.
SCORE_DECIMALS = 9


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group; the literal bound lets Spark drop rows
    before the shuffle, so a hot group never reaches one task whole."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def share(score: Column, keys: Sequence[str], weight: float = 1.0) -> Column:
    """Part of the group's total, times ``weight``; null where the total is 0."""
    total = F.sum(score).over(Window.partitionBy(*keys))
    return F.try_divide(score, total) * F.lit(float(weight))


def jvm_divide(numerator: Column, denominator: Column) -> Column:
    """IEEE division: 0/0 is NaN and x/0 is signed infinity, not an error."""
    return (
        F.when(denominator != 0, F.try_divide(numerator, denominator))
        .when((numerator == 0) | F.isnan(numerator), F.lit(float("nan")))
        .when(numerator > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
