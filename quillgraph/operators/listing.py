"""Listings: children in order, the newest under each index, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(date: str, key: str) -> list[Column]:
    """By date, undated first, the larger key first of equals."""
    return [F.col(date).desc_nulls_first(), F.col(key).desc()]


def top_per_parent(children: DataFrame, parent: str, order: list[Column], n: int = 3) -> DataFrame:
    """The first n children of each parent, with `place` from 1."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return children.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def with_place(children: DataFrame, parent: str, *order: str) -> DataFrame:
    """Children with `counter0`: their place from 0, nulls of the order last."""
    w = Window.partitionBy(parent).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return children.withColumn("counter0", (F.row_number().over(w) - 1).cast("long"))


def index_listing(pages: DataFrame, index: DataFrame, parent: str, date: str, key: str) -> DataFrame:
    """Pages of each index page (index: parent key, listed type), newest first, with place."""
    rows = pages.join(index.withColumnRenamed("listed_type", "content_type"), [parent, "content_type"])
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*newest_first(date, key)))
    return rows.withColumn("place", place.cast("long"))


def first_or_none(rows: DataFrame, *order: str) -> DataFrame:
    """The first row, nulls of the order last; the last column of the order breaks ties."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(1)


def exactly_one(rows: DataFrame) -> DataFrame:
    """The only row; none or several are an error when the query runs."""
    two = rows.limit(2).agg(F.collect_list(F.struct("*")).alias("_rows"))  # at most two rows
    told = F.raise_error(F.concat(F.lit("expected one row, found "), F.when(F.size("_rows") == 0, "none").otherwise("several")))
    return two.select(F.inline(F.when(F.size("_rows") == 1, F.col("_rows")).otherwise(told.cast(two.schema["_rows"].dataType))))
