"""Daily backups of a table as a chain of changes, from which any day can be restored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days of changes behind a full copy before the next one is made.
CHAIN = 30
FULL, CHANGES = "full", "changes"
_TOLD = ("row_digest", "row_gone")


def _days(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Days there are and what each holds, in order; a day that was begun and not finished isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda p: [s.getPath() for s in files.listStatus(p)] if files.exists(p) else []
    out = []
    for day in names(path):
        for kind in names(day):
            if day.getName().startswith("day=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(kind, "_SUCCESS")):
                out.append((day.getName()[4:], kind.getName()[5:]))
    return sorted(out)


def _digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


def _chain(spark: SparkSession, folder: str, day: str) -> list[str]:
    """Folders of the last full copy up to a day and of the changes behind it."""
    upto = [(d, kind) for d, kind in _days(spark, folder) if d <= day]
    start = max((k for k, (_, kind) in enumerate(upto) if kind == FULL), default=None)
    if start is None:
        return []
    return [f"{folder}/day={d}/kind={kind}" for d, kind in upto[start:]]


def _last(spark: SparkSession, folder: str, paths: Sequence[str], key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last version of each key in a chain, with `columns`; of a row that is gone its last version says so."""
    rows = spark.read.option("basePath", folder).option("mergeSchema", "true").parquet(*paths).withColumn("day", F.col("day").cast("string"))
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns], "row_gone"), F.col("day")).alias("row")
    return rows.groupBy(*key).agg(newest).select(*key, "row.*")


def back_up(rows: DataFrame, folder: str, day: str, key: Sequence[str], chain: int = CHAIN) -> None:
    """Adds a day (as 2024-01-31) to the backups of a table: rows that are new or differ from the day before, and keys that are gone.

    Rows are told apart by a digest of all their columns; only keys and digests of the chain are
    read for that.  The first day, and every day behind `chain` days of changes, is a full copy.  A day without changes
    writes no rows, but is there.  The last day may be written again; an earlier one is an error, as later days rest
    on it, and so is a null or repeated key.
    """
    spark = rows.sparkSession
    days = [d for d, _ in _days(spark, folder)]
    if days and day < days[-1]:
        raise ValueError(f"{day} lies before the last backup")
    others = [c for c in rows.columns if c not in key]
    number = F.count("*").alias("_n")
    told = rows.withColumns({"row_digest": _digest(rows.columns), "row_gone": F.lit(False)})
    one = told.groupBy(*key).agg(number, F.first(F.struct(*others, *_TOLD)).alias("_row"))  # keeps nulls and repeats to tell of them
    wrong = F.lit(False)
    for k in key:
        wrong = wrong | F.col(k).isNull()
    fault = F.raise_error(F.concat(F.lit("null or repeated key "), F.to_json(F.struct(*key)))).cast("boolean")
    one = one.where(F.when(wrong | (F.col("_n") > 1), fault).otherwise(True)).select(*key, "_row.*")
    before = [p for p in _chain(spark, folder, day) if f"/day={day}/" not in p]
    kind = CHANGES if before and len(before) <= chain else FULL
    if kind == CHANGES:
        have = _last(spark, folder, before, key, ["row_digest"]).where("NOT row_gone").select(*key, F.col("row_digest").alias("_have"))
        both = one.withColumn("_new", F.lit(True)).join(have, list(key), "full_outer").where(~F.col("row_digest").eqNullSafe(F.col("_have")))
        one = both.withColumn("row_gone", F.col("_new").isNull()).select(*one.columns)
    one.select(*rows.columns, *_TOLD).write.mode("overwrite").parquet(f"{folder}/day={day}/kind={kind}")
    other = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/day={day}/kind={FULL if kind == CHANGES else CHANGES}")
    other.getFileSystem(spark._jsc.hadoopConfiguration()).delete(other, True)  # when the day is written again as the other kind


def restored(spark: SparkSession, folder: str, day: str, key: Sequence[str]) -> DataFrame:
    """The table as it was on a day: each key's last version up to then, without those that were gone. Columns that came later are null in earlier rows; a day before the first backup is an error."""
    paths = _chain(spark, folder, day)
    if not paths:
        raise ValueError(f"no backup up to {day}")
    columns = [c for c in spark.read.option("mergeSchema", "true").parquet(*paths).columns if c not in (*key, *_TOLD)]
    return _last(spark, folder, paths, key, columns).where("NOT row_gone").drop("row_gone")
