"""Ordering and hashing of user and item ids (integers or strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_numeric_ids(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def id_order(df: DataFrame, column: str) -> list[Column]:
    """Ascending sort keys for ids: by number where the id is one, else by text."""
    if has_numeric_ids(df, column):
        return [F.col(column).asc()]
    return [F.col(column).try_cast("bigint").asc_nulls_last(), F.col(column).asc()]


def id_precedes(numeric: bool, left: Column, right: Column) -> Column:
    """True where ``left`` sorts before ``right`` under :func:`id_order`."""
    if numeric:
        return left < right
    a, b = left.try_cast("bigint"), right.try_cast("bigint")
    return (
        F.when(a.isNotNull() & b.isNotNull() & (a != b), a < b)
        .when(a.isNotNull() & b.isNull(), True)
        .when(a.isNull() & b.isNotNull(), False)
        .otherwise(left < right)
    )


def hash_slot(hash32: Column, slots: Column) -> Column:
    """Map a 32-bit hash to ``0..slots-1``, keeping the order of the hashes."""
    return F.floor(hash32 * slots / F.lit(1 << 32)).cast("int")


def user_hash(column: str) -> Column:
    """Unsigned upper half of a 64-bit hash, as a bigint."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column)), 32)


def md5_part(column: str, parts: Column) -> Column:
    """Even split of ids into ``parts`` groups that any SQL engine can repeat."""
    digits = F.substring(F.md5(F.col(column).cast("string")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), parts).cast("int")
