"""Imports of tables that refer to each other: what doesn't fit is set aside with a reason, and so is all that rests on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

_LINE = "line_as_it_is"


@dataclass(frozen=True)
class Table:
    """A table to import: its rows as CSV files with a header, its columns, its key, and for each column that refers to another table's key that table's name."""

    name: str
    path: str
    schema: str
    key: str
    refers: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Imported:
    """Rows that came in, and those set aside, with the line as it was read where it is no row, and the reason."""

    rows: DataFrame
    aside: DataFrame


def in_order(tables: Sequence[Table]) -> list[Table]:
    """Tables behind those that they refer to; a circle of tables is an error, a table that refers to itself is none."""
    by_name = {t.name: t for t in tables}
    graph = {t.name: sorted({r for r in t.refers.values() if r != t.name and r in by_name}) for t in tables}
    return [by_name[n] for n in TopologicalSorter(graph).static_order()]


def _read(spark: SparkSession, table: Table) -> DataFrame:
    """Rows, and the lines that aren't any."""
    reader = spark.read.schema(f"{table.schema}, {_LINE} string").option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", _LINE)
    return reader.csv(table.path, mode="PERMISSIVE")


def _keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(F.col(key).alias(name)).where(F.col(name).isNotNull()).distinct()


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _judged(rows: DataFrame, table: Table, there: DataFrame | None) -> DataFrame:
    """rows with `reason`: no row, no key, a repeated key, or one that is there already; else null."""
    counts = rows.where(f"{_LINE} IS NULL").groupBy(table.key).agg(F.count("*").alias("_n"))
    rows = rows.join(counts, table.key, "left")
    known = F.lit(False)
    if there is not None:
        rows = rows.join(_keys(there, table.key, table.key).withColumn("_there", F.lit(True)), table.key, "left")
        known = F.coalesce("_there", F.lit(False))
    reason = F.when(F.col(_LINE).isNotNull(), "no row").when(F.col(table.key).isNull(), "no key").when(F.col("_n") > 1, "repeated key").when(known, "already there")
    return rows.withColumn("reason", reason)


def _referred(rows: DataFrame, column: str, name: str, good: DataFrame, aside: DataFrame, key: str) -> DataFrame:
    """Where there is no reason yet, one for a reference to a row that is not there, or that was set aside."""
    rows = rows.join(_keys(good, key, column).withColumn("_good", F.lit(True)), column, "left").join(_keys(aside, key, column).withColumn("_aside", F.lit(True)), column, "left")
    lost = F.concat(F.lit(f"{column}: no {name} "), _text(column), F.when(F.col("_aside"), ", it was set aside").otherwise(""))
    wrong = F.when(F.col(column).isNotNull() & F.col("_good").isNull(), lost)
    return rows.withColumn("reason", F.coalesce("reason", wrong)).drop("_good", "_aside")


def import_tables(spark: SparkSession, tables: Sequence[Table], existing: Mapping[str, DataFrame] | None = None) -> dict[str, Imported]:
    """Imports tables in the order of their references; existing: rows that are there before, by table.

    A table that is only among the existing ones is referred to by a column that has the name of its key.

    A row is set aside when its line doesn't fit the columns, when its key is null, repeated in the files (all of
    its rows then) or there already, or when it refers to a row that neither is there nor comes in; the first
    reason counts, references in the order they are given.  What is set aside takes along all that refers to it, from table to table,
    and within a table that refers to itself round by round.  A null reference is none.  Each table's
    rows are written to the shared folder when they have been judged, and the next tables are joined with that.
    """
    existing = existing or {}
    out: dict[str, Imported] = {}
    keys = {t.name: t.key for t in tables}
    for table in in_order(tables):
        columns = [c for c in _read(spark, table).columns if c != _LINE]
        rows = _judged(written(_read(spark, table), "import-lines"), table, existing.get(table.name))
        for column, name in table.refers.items():
            if name == table.name:
                continue
            if name not in keys and name not in existing:
                raise ValueError(f"{table.name} refers to {name}, which is neither imported nor there")
            key = keys.get(name, column)
            good = [x.select(key) for x in (existing.get(name), out[name].rows if name in out else None) if x is not None]
            all_good = good[0] if len(good) == 1 else good[0].unionByName(good[1])
            nothing = all_good.where("false")
            rows = _referred(rows, column, name, all_good, out[name].aside if name in out else nothing, key)
        rows = written(rows.select(*columns, _LINE, "reason"), "import-judged")
        own = [c for c, name in table.refers.items() if name == table.name]
        while own:
            before = rows.where("reason IS NOT NULL").count()
            for column in own:
                good = rows.where("reason IS NULL").select(table.key)
                if table.name in existing:
                    good = good.unionByName(existing[table.name].select(table.key))
                rows = _referred(rows, column, table.name, good, rows.where("reason IS NOT NULL"), table.key)
            rows = written(rows.select(*columns, _LINE, "reason"), "import-judged")
            if rows.where("reason IS NOT NULL").count() == before:
                break
        out[table.name] = Imported(rows.where("reason IS NULL").select(*columns), rows.where("reason IS NOT NULL").select(*columns, F.col(_LINE).alias("line"), "reason"))
    return out
