"""Once-only intake of files and rows as streams: scans of pages, and form submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import scan_parts

SCANS = "book string, page long, path string, length long, seen timestamp"


def _once(stream: DataFrame, folder: str) -> None:
    """Takes what has come since the last run into `folder`: each micro-batch has a folder of its own, which it overwrites when it is run again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/taken").foreachBatch(put).start().awaitTermination()


def register_scans(spark: SparkSession, folder: str, registry: str, files: int = 10_000) -> None:
    """Registers page scans (archive/book/page.jpg) below a folder that the registry doesn't hold yet, `files` in a micro-batch.

    Files are known by path: one that is put in place of another is registered once.  What is no scan is
    passed by.  Contents aren't read.
    """
    found = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
    parts = scan_parts(F.regexp_extract("path", r"(archive/[^/]+/[^/]+)$", 1)).alias("_p")
    _once(found.select(parts, "path", "length", F.col("modificationTime").alias("seen")).where("_p.page IS NOT NULL").select("_p.book", "_p.page", "path", "length", "seen"), registry)


def registered(spark: SparkSession, registry: str) -> DataFrame:
    """All scans registered so far."""
    return spark.read.schema(SCANS).parquet(f"{registry}/rows").select("book", "page", "path", "length", "seen")


def missing_pages(pages: DataFrame, book: str, page: str, first: int | None = 1) -> DataFrame:
    """The ranges of page numbers that are missing between those there are: book, first and last page of the gap; with `first`, also before the lowest page."""
    rows = pages.where(F.col(page).isNotNull()).select(book, F.col(page).cast("long").alias("_page")).distinct()
    start = F.lit(None).cast("long") if first is None else F.lit(first - 1).cast("long")
    before = F.coalesce(F.lag("_page").over(Window.partitionBy(book).orderBy("_page")), start)
    return rows.withColumn("_before", before).where(F.col("_page") > F.col("_before") + 1).select(book, (F.col("_before") + 1).alias("first"), (F.col("_page") - 1).alias("last"))


def page_runs(pages: DataFrame, book: str, page: str) -> DataFrame:
    """The runs of page numbers without a gap: book, first, last, and how many scans they have, which is more than pages where a page has several."""
    rows = pages.where(F.col(page).isNotNull()).select(book, F.col(page).cast("long").alias("_page")).groupBy(book, "_page").agg(F.count("*").alias("_n"))
    run = F.col("_page") - F.row_number().over(Window.partitionBy(book).orderBy("_page"))
    return rows.withColumn("_run", run).groupBy(book, "_run").agg(F.min("_page").alias("first"), F.max("_page").alias("last"), F.sum("_n").alias("scans")).drop("_run")


def take_submissions(stream: DataFrame, folder: str, spam: str | None = None) -> None:
    """Form submissions of a stream, each once whatever is run again; those that column `spam` marks are not kept."""
    _once(stream if spam is None else stream.where(~F.coalesce(F.col(spam), F.lit(False))), folder)


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """All submissions taken so far."""
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/rows").drop("batch")
