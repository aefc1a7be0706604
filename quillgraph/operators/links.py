"""Joins between entities: subtypes, ordered children, lookups, references and their rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def specific(base: DataFrame, subtype: DataFrame, key: str, pointer: str) -> DataFrame:
    """Base rows with the columns of their subtype's row."""
    return base.join(subtype.withColumnRenamed(pointer, key), key)


def nested(children: DataFrame, parent: str, order: str, fields: Sequence[str], into: str = "items") -> DataFrame:
    """One row per parent with its children as an array in order."""
    entry = F.struct(F.col(order).isNull().alias("_none"), order, *[f for f in fields if f != order])
    got = children.groupBy(parent).agg(F.sort_array(F.collect_list(entry)).alias(into))
    return got.withColumn(into, F.transform(into, lambda x: F.struct(*[x[f].alias(f) for f in fields])))


def looked_up(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their entry; a missing entry is an error, as in a dictionary."""
    found = dictionary.withColumn("_found", F.lit(True))
    out = rows.join(found, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no entry for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.withColumn("_found", F.when(F.col("_found"), True).otherwise(missing.cast("boolean"))).where("_found").drop("_found")


def with_flag(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a flag: whether others has the key."""
    keys = others.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def orphans(rows: DataFrame, targets: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose reference isn't null and has no target."""
    return rows.where(F.col(foreign).isNotNull()).join(targets.select(F.col(key).alias(foreign)), foreign, "left_anti")


def cascade(rows: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows that are left when those that refer to deleted ones go too."""
    return rows.join(deleted.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def set_null(rows: DataFrame, deleted: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows with references to deleted ones set to null."""
    gone = deleted.select(F.col(key).alias(foreign)).distinct().withColumn("_gone", F.lit(True))
    out = rows.join(gone, foreign, "left")
    return out.withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).select(*rows.columns)


def translations(pages: DataFrame, key: str = "translation_key", locale: str = "locale", page: str = "page_id") -> DataFrame:
    """Pairs of pages that are the same in two languages."""
    a = pages.select(key, F.col(page).alias("page"), F.col(locale).alias("from_locale"))
    b = pages.select(key, F.col(page).alias("translation"), F.col(locale).alias("to_locale"))
    return a.join(b, key).where("from_locale <> to_locale").select("page", "from_locale", "translation", "to_locale")


def redirected(requests: DataFrame, redirects: DataFrame, missing: str = "404") -> DataFrame:
    """requests (path) with `target`: the new path where redirects (old_path, new_path) know it, else `missing`."""
    return requests.join(redirects.withColumnRenamed("old_path", "path"), "path", "left").withColumn("target", F.coalesce("new_path", F.lit(missing))).drop("new_path")


def side_by_side(passages: DataFrame, reference: str, edition: str, text: str, editions: Sequence[str]) -> DataFrame:
    """One row per reference with a column of text for every edition."""
    return passages.groupBy(reference).pivot(edition, list(editions)).agg(F.min(text))


def tagged(items: DataFrame, tags: DataFrame, key: str, wanted: str) -> DataFrame:
    """Items with the tag (tags: key, tag), whatever its case, in any script."""
    return items.join(tags.where(F.collate("tag", "UTF8_LCASE") == F.lit(wanted)).select(key), key, "left_semi")


def same_tags(tags: DataFrame, others: DataFrame, tag: str) -> DataFrame:
    """Pairs of tags (columns `tag` and `other`) that are the same but for case; the join compares by collation, on both sides by Spark."""
    plain = lambda rows, name: rows.select(F.collate(F.col(tag), "UTF8_LCASE").alias("_key"), F.col(tag).alias(name)).distinct()
    return plain(tags, "tag").join(plain(others, "other"), "_key").select("tag", "other")


def clashing_tags(tags: DataFrame, tag: str) -> DataFrame:
    """Tags that are there in several writings: the least of them, and how many there are."""
    rows = tags.where(F.col(tag).isNotNull()).select(tag).distinct().groupBy(F.collate(F.col(tag), "UTF8_LCASE").alias("_key"))
    return rows.agg(F.min(tag).alias("tag"), F.count("*").alias("writings")).where("writings > 1").select("tag", "writings")


def with_terms(items: DataFrame, terms: DataFrame, key: str, classifier: str, wanted: Sequence[str]) -> DataFrame:
    """Items that a list filtered by a classifier shows: those with any of its wanted terms (terms: key, classifier, term); all items with none wanted."""
    if not wanted:
        return items
    return items.join(terms.where((F.col("classifier") == classifier) & F.col("term").isin(*wanted)).select(key), key, "left_semi")


def translated(rows: DataFrame, labels: DataFrame, label: str, language: str) -> DataFrame:
    """rows with `label` in a language (labels: message, language, translation), as it is where there is no translation."""
    known = labels.where(F.col("language") == language).select(F.col("message").alias(label), "translation")
    return rows.join(known, label, "left").withColumn(label, F.coalesce("translation", label)).select(*rows.columns)
