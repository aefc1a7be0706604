"""References from blocks of bodies to other rows, however deep the blocks lie in each other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Fields of blocks that hold the id of another row, and what kind of row that is. Fixed values.
FIELDS = {
    "page_link": "page",
    "page": "page",
    "indexed_by": "page",
    "doc_link": "document",
    "downloadable_file": "document",
    "image": "image",
    "background_image": "image",
    "classified_by": "term",
    "accordion": "snippet",
    "carousel": "snippet",
    "film_strip": "snippet",
    "content": "snippet",
    "collection": "collection",
}
#: Levels of values that are opened between two writes.
LEVELS = 4


def _open(value: Column) -> Column:
    """Whether a variant is an object or an array."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull() | F.try_variant_get(value, "$", "array<variant>").isNotNull()


def _deeper(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """rows (id, path, field, value, target) without a target replaced by what their values hold; those with one stay.

    What a value holds goes on with its block's type and not with the block itself, which would be copied for each of its parts.
    """
    outside = rows.select("id", F.col("path").alias("_path"), F.col("field").alias("_field"), F.col("target").alias("_target"), F.try_variant_get("value", "$.type", "string").alias("_type"), F.when(F.col("target").isNull(), F.col("value")).alias("_value"))
    parts = outside.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_value").outer()))
    opened = F.col("key").isNotNull() | F.col("pos").isNotNull()
    step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
    own = F.when(F.col("key") == "value", F.coalesce(F.col("_type"), F.lit("value"))).otherwise(F.coalesce(F.col("key"), F.col("_field")))
    found = parts.where(opened | F.col("_target").isNotNull()).select("id", F.when(opened, F.concat_ws(".", F.col("_path"), step)).otherwise(F.col("_path")).alias("path"), F.when(opened, own).otherwise(F.col("_field")).alias("field"), "value", "_target")
    own_target = F.when(F.col("field").isin(*fields), F.try_variant_get("value", "$", "bigint"))
    return found.select("id", "path", "field", "value", F.coalesce(F.col("_target"), own_target).alias("target"))


def nested_references(pages: DataFrame, key: str, body: str, fields: Mapping[str, str] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """One row per reference inside a JSON body: the page's key, path (such as `4.value.content.0.value.page_link`), field, kind and target.

    A reference is a number, or a text that is one, in one of the fields, or as the value of a
    block whose type is one of them, or in a list in such a place; null is none.  All bodies are opened
    together, one level at a time, until nothing is left that holds more.  After every
    `levels` of them the rows are written to the shared folder, so that the plan stays small
    however deep bodies are, and what has been opened isn't opened again.  Null bodies and such as
    are no JSON have no references; pages of equal keys are looked at one by one.
    """
    rows = pages.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("field"), F.try_parse_json(F.col(body)).alias("value"), F.lit(None).cast("bigint").alias("target"))
    found = []
    while True:
        for _ in range(levels):
            rows = _deeper(rows, fields)
        rows = rows.select("id", "path", "field", F.when(F.col("target").isNull() & _open(F.col("value")), F.col("value")).alias("value"), "target")
        rows = written(rows.where("value IS NOT NULL OR target IS NOT NULL"), "references")
        found.append(rows.where("target IS NOT NULL"))
        rows = rows.where("target IS NULL")
        if rows.isEmpty():
            break
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    kind = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    return leaves.select(F.col("id").alias(key), "path", "field", kind[F.col("field")].alias("kind"), "target")


def orphaned(references: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """References whose target isn't there; targets: rows with column id for each kind. Kinds that aren't among them aren't looked at."""
    known = None
    for kind, rows in targets.items():
        rows = rows.select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("target"))
        known = rows if known is None else known.unionByName(rows)
    return references.where(F.col("kind").isin(*targets)).join(known, ["kind", "target"], "left_anti").select(*references.columns)
