"""Files: media, scans, catalogues as CSV, form submissions, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scan_parts
from ..operators.links import orphans

#: Image formats that are served. Fixed values.
IMAGE_EXTENSIONS = ("gif", "jpg", "jpeg", "png", "webp", "svg")


def media(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Files under a folder of any store that Spark reads (path, modificationTime, length, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files if content else files.drop("content")


def images(spark: SparkSession, folder: str, content: bool = True, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """Media with an allowed extension."""
    return media(spark, folder, content).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Page scans registered by their path: book, page, path, length."""
    files = media(spark, folder, content=False)
    parts = scan_parts(F.regexp_extract("path", r"(archive/[^/]+/[^/]+)$", 1))
    return files.select(parts.alias("_p"), "path", "length").where("_p.page IS NOT NULL").select("_p.book", "_p.page", "path", "length")


def catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV rows with a header; a row that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path, mode="FAILFAST")


def checked_import(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, rows whose parent doesn't)."""
    bad = orphans(rows, parents, foreign, key)
    good = rows.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")
    return good, bad


def append_rows(rows: DataFrame, folder: str) -> None:
    """New rows of a table kept as files; what is there stays."""
    rows.write.mode("append").parquet(folder)


def append_submissions(rows: DataFrame, folder: str, spam: str | None = None) -> None:
    """Form submissions, appended; those that column `spam` marks are not kept."""
    append_rows(rows if spam is None else rows.where(~F.coalesce(F.col(spam), F.lit(False))), folder)


def export_submissions(spark: SparkSession, folder: str, path: str) -> None:
    """Form submissions as CSV."""
    spark.read.parquet(folder).write.option("header", True).csv(path)


def snapshot(rows: DataFrame, folder: str, day: str) -> None:
    """A day's copy; writing a day again replaces that day's copy only."""
    rows.write.mode("overwrite").parquet(f"{folder}/day={day}")


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The copy of the last day there is."""
    days = spark.read.option("recursiveFileLookup", "false").parquet(folder)
    last = days.agg(F.max("day")).first()[0]
    return days.where(F.col("day") == F.lit(last)).drop("day")
