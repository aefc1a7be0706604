"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source.  Weights share `share` of all sizes among the sources; a
target stops at `most` times its source's size, and what is over goes to the others by
weight until no target is above its stop.  That is a level that rises over all sources
alike: those with the least room per weight stop first, so that one running sum over
the sources in order of room per weight gives the result of all rounds.  A source's
rate is its target over its size; each of its documents is taken floor(rate) times,
and once more when a number between 0 and 1, made from the seed and the document's
id by MD5, is below the rate's fraction.  Sums are of whole numbers, so that reruns
and other partitions give the same targets, and the same copies.

Plan: one pass over the texts sums sizes per source, map-side first, so that a source with
a third of all rows is one row per task in the shuffle.  The targets, a row per source,
are written to the shared folder: Spark knows their size from there and broadcasts them
when they are under spark.sql.autoBroadcastJoinThreshold; else it shuffles, and splits a
hot source's documents by adaptive execution.  Nothing else is shuffled, and texts never.
The running sums go through one task with a row per source, not per document.

Cases: a null text has size 0; empty and blank ones too.  Documents of size 0 follow
their source's rate like others.  A null source is a source of its own, the last one, and
not the empty one.  A row with null doc_id is drawn by its text.  Rows that repeat a doc_id
count each, and have the same number of copies.  A source without words has target 0 and
no copies; an empty table gives an empty result.  Other columns are kept, whatever their names,
by `mixed`, and ignored by `planned`.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored
from .textkernel import numbered, pick

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Times its size that a source's target may be.
MOST = 3
#: Percent of all sizes that the targets share.
SHARE = 100
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1, below 1, by 52 bits of the MD5 of seed and id (of the text where there is no id)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: int = SHARE) -> DataFrame:
    """source, source_size, weight, target, rate for rows (source, size); whole-number weights go to the sources by code point, null last."""
    scale = lcm(*weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "nth")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    sums = sums.withColumn("weight", weight.cast("long")).withColumn("stop", whole("source_size") * most)
    sums = sums.withColumn("room", F.col("stop") * F.try_element_at(F.create_map(*[F.lit(x) for w in sorted(set(weights)) for x in (int(w), scale // int(w))]), F.col("weight").cast("int")))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({
        "_left": F.floor(F.sum(whole("source_size")).over(Window.partitionBy(F.lit(0))) * share / 100) - F.coalesce(F.sum("stop").over(before), F.lit(0)),  # words that are left for this source and all with more room
        "_weight": F.sum("weight").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    open_ = F.col("stop") * F.col("_weight") > F.col("weight") * F.col("_left")  # it doesn't stop; nor does any with more room
    first = F.min_by(F.struct("_left", "_weight"), F.struct("room", "nth")).over(Window.partitionBy(open_))
    level = F.col("weight").cast("decimal(20,0)") * F.col("_first._left").cast("decimal(18,0)")
    target = F.when(F.col("_open"), level.cast("double") / F.col("_first._weight").cast("double")).otherwise(F.col("stop").cast("double"))
    sums = sums.withColumn("_open", open_).withColumn("_first", first).withColumn("target", target)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    return sums.select("source", "source_size", "weight", "target", rate.alias("rate"))


def _copies(rate: Column, draw_: Column) -> Column:
    return (F.floor(rate) + F.when(draw_ < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_targets(rows: DataFrame, source: str, goals: DataFrame) -> DataFrame:
    """rows (with _size, _draw) with their source's target and the number of their copies."""
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    return rows.join(goals, rows[source].eqNullSafe(goals["_source"])).drop("_source").withColumn("copies", _copies(F.col("rate"), F.col("_draw")))


def _goals(docs: DataFrame, weights: Sequence[int], most: int, share: int) -> DataFrame:
    sizes = pick(docs, "source", "text").select("source", size(F.col("text")).alias("size"))
    return stored(targets(sizes, weights, most, share), "targets")


def planned(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: int = SHARE, seed: str = SEED) -> DataFrame:
    """One row per document (columns doc_id, source, text): doc_id, source, size, source_size, target, rate, copies."""
    goals = _goals(docs, weights, most, share)
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", size(F.col("text")).alias("_size"), draw(F.col("doc_id"), F.col("text"), seed).alias("_draw"))
    return _with_targets(rows, "source", goals).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "rate", "copies")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: int = SHARE, seed: str = SEED) -> DataFrame:
    """The mix itself: all columns of docs, each row as many times as it has copies, and last the copy's number, from 0."""
    goals = _goals(docs, weights, most, share)
    rows, name = numbered(docs)
    rows = rows.withColumn("_draw", draw(F.col(name("doc_id")), F.col(name("text")), seed))
    every = _with_targets(rows, name("source"), goals).where("copies > 0")
    out = every.select(*[c for c in rows.columns if c != "_draw"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return out.toDF(*docs.columns, "copy")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words of it that the mix takes."""
    plan = planned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")
