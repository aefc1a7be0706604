"""Passages of two editions side by side where nothing but their texts tells which belong together."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str, text: str) -> DataFrame:
    """keys, a and b: places of texts that stand once in either edition."""
    one = lambda rows, side: rows.where(F.col(text).isNotNull()).select(*keys, F.sha2(text, 256).alias("_text"), F.col(place).cast("long").alias("_place"), F.lit(side).alias("_side"))
    side = lambda k: F.col("_side") == k
    found = one(left, 0).unionByName(one(right, 1)).groupBy(*keys, "_text").agg(
        F.count_if(side(0)).alias("_n"), F.count_if(side(1)).alias("_m"), F.max(F.when(side(0), F.col("_place"))).alias("a"), F.max(F.when(side(1), F.col("_place"))).alias("b"))
    return found.where("_n = 1 AND _m = 1").select(*keys, "a", "b")


def chain(places: Sequence[int]) -> list[int]:
    """Indexes of a longest ascending chain; of several, the one whose places are the smallest from its end on."""
    ends: list[int] = []  # the smallest last place of a chain of each length
    at: list[int] = []
    before = []
    for k, b in enumerate(places):
        n = bisect_left(ends, b)
        before.append(at[n - 1] if n else -1)
        ends[n:n + 1], at[n:n + 1] = [b], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads anchors in order of keys and a; yields those of the longest chain. Column cut: the anchor is the last of its tangle."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        for k in [k for k, cut in enumerate(batch.column("cut").to_pylist()) if cut]:
            held.append(batch.slice(start, k + 1 - start))
            start = k + 1
            tangle = pa.Table.from_batches(held).drop_columns(["cut"])
            held = []
            yield from (tangle if len(tangle) == 1 else tangle.take(chain(tangle.column("b").to_pylist()))).to_batches()
        if start < batch.num_rows:
            held.append(batch.slice(start))


def longest_chain(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the anchors (keys, a, b) of each pair of editions the longest chain that ascends in both.

    An anchor that all earlier ones lie before, in both editions, and all later ones behind, ends a tangle.
    A task holds one tangle at a time; only editions in wholly different order are one tangle.
    """
    w = lambda order: Window.partitionBy(*keys).orderBy(order)
    so_far = F.max("b").over(w(F.col("a")))
    later = F.min("b").over(w(F.col("a").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_later", later).withColumn("cut", F.coalesce(so_far < F.col("_later"), F.lit(True))).drop("_later")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "a").select(*keys, "a", "b", "cut")
    return rows.mapInArrow(_chained, rows.drop("cut").schema)


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str, text: str) -> DataFrame:
    """The table of contents of two editions: keys, line (from 1), left_place, right_place and how.

    left, right: passages of the editions of a work (keys), with a place in the edition and a text.  Texts that
    stand once in either edition are anchors; of these the longest chain that ascends in both is kept (how:
    anchor).  Between two anchors passages go side by side in their order (filled); where one
    edition has more, the rest stand alone (left, right).  A null text is never an anchor; a work
    that one edition lacks stands alone; places of an edition must differ.
    """
    kept = longest_chain(anchors(left, right, keys, place, text), keys)

    def numbered(rows: DataFrame, of: str, name: str) -> DataFrame:
        rows = rows.select(*keys, F.col(place).cast("long").alias(name)).join(kept.select(*keys, F.col(of).alias(name), F.lit(1).alias("_anchor")), [*keys, name], "left")
        rows = rows.withColumn("_gap", F.coalesce(F.sum("_anchor").over(Window.partitionBy(*keys).orderBy(name)), F.lit(0)))
        nth = F.row_number().over(Window.partitionBy(*keys, "_gap").orderBy(name)) - F.when(F.col("_gap") > 0, 1).otherwise(0)
        return rows.select(*keys, "_gap", nth.alias("_nth"), name)

    both = numbered(left, "a", "left_place").join(numbered(right, "b", "right_place"), [*keys, "_gap", "_nth"], "full_outer")
    how = F.when(F.col("right_place").isNull(), "left").when(F.col("left_place").isNull(), "right").when((F.col("_nth") == 0), "anchor").otherwise("filled")
    line = F.row_number().over(Window.partitionBy(*keys).orderBy("_gap", "_nth")).cast("long")
    return both.select(*keys, line.alias("line"), "left_place", "right_place", how.alias("how"))
