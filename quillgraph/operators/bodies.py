"""Bodies: arrays of blocks, each a struct of type and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks that older pages were made of. Fixed values.
LEGACY_TYPES = ("sacred_hero", "section", "goals")


def needs_reseed(body: Column, legacy: tuple[str, ...] = LEGACY_TYPES) -> Column:
    """Whether a body is empty or null, or has a legacy block or a row."""
    return (F.coalesce(F.size(body), F.lit(0)) <= 0) | F.coalesce(F.exists(body, lambda b: b["type"].isin(*legacy, "row")), F.lit(False))


def swapped(body: Column, kind: str, new_value) -> Column:
    """The body with the value of every block of a kind replaced by new_value(value)."""
    return F.transform(body, lambda b: F.when(b["type"] == kind, b.withField("value", new_value(b["value"]))).otherwise(b))


def block_at(body: Column, place: int) -> Column:
    """The block at a place, from 0, or from the end with -1 and down; null beyond either end."""
    return F.try_element_at(body, F.lit(place + 1 if place >= 0 else place))


def merged(left: Column, **fields: Column) -> Column:
    """A struct with some fields set; what is given wins."""
    for name, value in fields.items():
        left = left.withField(name, value)
    return left


def appended(body: Column, *more: Column) -> Column:
    """Arrays one behind the other; a null array has no entries."""
    empty = F.filter(F.coalesce(body, *more), lambda _: F.lit(False))
    return F.concat(*[F.coalesce(x, empty) for x in (body, *more)])


def parsed(raw: Column) -> Column:
    """A body of JSON text as array of (type, value as JSON text, id)."""
    return F.from_json(raw, "array<struct<type:string,value:string,id:string>>")


def references(pages: DataFrame, body: str, key: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per block of the kinds that refer to other rows (None: all kinds): page, place, type and the id in their value."""
    rows = pages.select(key, F.posexplode(body).alias("place", "block"))
    rows = rows if kinds is None else rows.where(F.col("block.type").isin(*kinds))
    return rows.select(key, "place", F.col("block.type").alias("type"), F.col("block.value").try_cast("bigint").alias("target"))


def opened_up(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """Blocks of JSON bodies as rows of variants: key, place, type, value."""
    body = F.try_parse_json(F.col(raw))
    rows = pages.select(key, body.alias("_body")).where(F.col("_body").isNotNull())
    rows = rows.lateralJoin(_exploded(pages.sparkSession))
    return rows.select(key, F.col("pos").cast("long").alias("place"), F.try_variant_get("value", "$.type", "string").alias("type"), F.col("value"))


def _exploded(spark):
    return spark.tvf.variant_explode(F.col("_body").outer())
