"""Reports of rows that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outside_domain(rows: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows with a value that isn't allowed; null breaks nothing."""
    return rows.where(~F.col(column).isin(*allowed))


def outside_range(rows: DataFrame, column: str, low, high) -> DataFrame:
    return rows.where(~F.col(column).between(low, high))


def too_long(rows: DataFrame, column: str, most: int) -> DataFrame:
    """Rows whose text is longer than its declared length, which Spark doesn't enforce."""
    return rows.where(F.length(column) > most)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def is_subset(needed: DataFrame, have: DataFrame) -> DataFrame:
    """One row, column ok: whether every row of needed is in have; both have the same columns."""
    return needed.join(have, needed.columns, "left_anti").agg((F.count("*") == 0).alias("ok"))


def has_all(have: Column, needed: Sequence) -> Column:
    """Whether an array has all of some values; a null array has none."""
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(x) for x in needed]), have)) == 0, F.lit(not needed))


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays are equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
