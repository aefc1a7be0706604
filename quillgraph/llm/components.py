"""Connected components of a graph given as rows of links.

Tasks first join what they see by themselves, over as few partitions as LINKS
links for each allow; few links are done with that.  Then, in rounds, every vertex
hangs its larger neighbours, and next its smaller ones, on the smallest (the
large-star and small-star steps of Kiveris et al., 2014).  No vertex's links are
ever collected: the steps are a minimum per vertex and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


#: Links that a task joins by itself.
LINKS = 1_000_000


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex that isn't the smallest of those it can reach, and that one."""
    ids, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == root).all():
            break
        root = new
    k = np.flatnonzero(root != np.arange(len(ids)))
    return ids[k], ids[root[k]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the links of a partition among themselves; passes on what it has after every LINKS links."""
    u = v = np.zeros(0, np.int64)
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= LINKS:
            u, v = _joined(np.concatenate([u, *(h[0] for h in held)]), np.concatenate([v, *(h[1] for h in held)]))
            held, size = [], 0
            if len(u) > LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u = v = np.zeros(0, np.int64)
    if size:
        u, v = _joined(np.concatenate([u, *(h[0] for h in held)]), np.concatenate([v, *(h[1] for h in held)]))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of longs: (id, root) for every vertex that has a link to another; root is the smallest id."""
    rows = stored(links.select("u", "v").where("u <> v"), "links")
    parts = max(1, -(-rows.count() // LINKS))
    edges = stored(rows.coalesce(parts).mapInArrow(_local, "u long, v long"), "links")  # u > v
    if parts == 1 and edges.count() <= LINKS:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    edges = edges.distinct()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").mapInArrow(_local, "u long, v long").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        seen = now
