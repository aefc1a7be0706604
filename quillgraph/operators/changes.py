"""Changes as functions from rows to rows: loads that may be repeated, seeds, revisions, deletions."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def get_or_create(existing: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All rows after the load, and the keys wanted with `created`: whether the load made them."""
    keys = wanted.dropDuplicates([key])
    new = keys.join(existing.select(key), key, "left_anti")
    have = existing.select(key).distinct().withColumn("_have", F.lit(True))
    told = keys.select(key).join(have, key, "left").select(key, F.col("_have").isNull().alias("created"))
    return existing.unionByName(new), told


def seed_action(exists: Column, right_type: Column, force: Column | bool, reseed: Column, description: Column) -> Column:
    """created, updated, unchanged, or skipped for a row of another type."""
    force = force if isinstance(force, Column) else F.lit(force)
    due = force | F.coalesce(reseed, F.lit(False)) | is_blank(description)
    return F.when(~exists, "created").when(~F.coalesce(right_type, F.lit(False)), "skipped").when(due, "updated").otherwise("unchanged")


def seeded(existing: DataFrame, seed: DataFrame, key: str, columns: Sequence[str], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows after seeding, and (key, action).

    existing: key, content_type, needs_reseed, description, `columns` and others; seed: key,
    description and `columns`, whose rows are of type webpage.  Where the action is
    created or updated the seed's columns and description are taken; the others stay, and are null in created rows.
    """
    fields = ["description", *[c for c in columns if c != "description"]]
    new = seed.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_seed"))
    both = existing.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    action = seed_action(F.col("_old").isNotNull(), F.col("content_type") == "webpage", force, F.col("needs_reseed"), F.col("description"))
    both = both.withColumn("_action", F.when(F.col("_seed"), action))
    take = F.col("_action").isin("created", "updated")
    out = both.select(
        key, F.when(F.col("_action") == "created", "webpage").otherwise(F.col("content_type")).alias("content_type"),
        F.when(take, False).otherwise(F.col("needs_reseed")).alias("needs_reseed"), *[F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        *[c for c in existing.columns if c not in {key, "content_type", "needs_reseed", *fields}],
    )
    return out, both.where("_seed").select(key, F.col("_action").alias("action"))


def bootstrap(existing: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All rows after a load, and one row of what it did: created (number) and message. For dimensions of few rows."""
    rows, told = get_or_create(existing, wanted, key)
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("created"), F.col(key).cast("string")))), ", ")
    done = told.agg(F.count_if("created").alias("created"), names.alias("_names"))
    return rows, done.select("created", F.when(F.col("created") > 0, F.concat(F.lit("created: "), "_names")).otherwise("nothing to create").alias("message"))


def migrated(rows: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], applied: Collection[str] = ()) -> tuple[DataFrame, list[str]]:
    """rows after the steps (name, function) that weren't applied before, in their order, and the names of all that are applied now."""
    done = list(applied)
    for name, step in steps:
        if name not in done:
            rows = step(rows)
            done.append(name)
    return rows, done


def home_due(force: Column | bool, reseed: Column, show_subpages: Column, description: Column) -> Column:
    """Whether a home page is seeded anew: forced, with an old body, showing subpages, or without description."""
    force = force if isinstance(force, Column) else F.lit(force)
    return force | F.coalesce(reseed, F.lit(False)) | F.coalesce(show_subpages, F.lit(False)) | is_blank(description)


def home_seeded(home: DataFrame, body: Column, description: str, force: bool = False) -> DataFrame:
    """Home pages (content_type, needs_reseed, show_subpages, description, body) after seeding, with `home_seeded`, 0 or 1.

    A home page of another type than webpage is an error when the query runs.
    """
    wrong = F.raise_error("the root page must be a web page").cast("boolean")
    due = F.when(F.coalesce(F.col("content_type") == "webpage", F.lit(False)), home_due(force, F.col("needs_reseed"), F.col("show_subpages"), F.col("description"))).otherwise(wrong)
    rows = home.withColumn("_due", due)
    take = F.col("_due")
    new = {"body": body, "description": F.lit(description), "needs_reseed": F.lit(False), "show_subpages": F.lit(False)}
    return rows.withColumns({c: F.when(take, v).otherwise(F.col(c)) for c, v in new.items()}).withColumn("home_seeded", take.cast("long")).drop("_due")


def counters(actions: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with the number of rows of each action."""
    return actions.agg(*[F.count_if(F.col("action") == n).alias(n) for n in names])


def any_counted(counted: DataFrame, name: str) -> DataFrame:
    """One row, column name: whether the counter of that name is above zero."""
    return counted.select((F.coalesce(F.col(name), F.lit(0)) > 0).alias(name))


def published(revisions: DataFrame, new: DataFrame, key: str, number: str) -> DataFrame:
    """All revisions with new ones (without `number`, one per key) behind the last of their key; the first of a key has number 1."""
    last = revisions.groupBy(key).agg(F.max(number).alias("_last"))
    rows = new.join(last, key, "left").withColumn(number, (F.coalesce("_last", F.lit(0)) + 1).cast(revisions.schema[number].dataType))
    return revisions.unionByName(rows.select(*revisions.columns))


def current(revisions: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The last revision of each key, without a sort: the fields at the largest order."""
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("_last")
    return revisions.groupBy(key).agg(last).select(key, *[F.col(f"_last.{f}").alias(f) for f in fields])


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that a deletion leaves; where the condition is unknown they stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def emptied(rows: DataFrame) -> DataFrame:
    return rows.where(F.lit(False))


def updated(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows with columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(hit, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})
