"""Ranked search over a stored index.

The index is written once: postings in blocks of documents with neighbouring keys, partitioned
by a hash of the term and sorted by term and block.  A block of a term holds the places of its documents
within the block, how often each has the term, and its length; beside them stand the largest count and
the smallest length, which bound what the block can add to any score.  A term that every document
has is many blocks of bounded size, dealt over the files of its partition by hash of the block.

Each text is moved once, to where its block's documents meet, and taken apart once: a task counts a
block's terms there, so that blocks are moved and not single postings.

A search reads the partitions of its terms only.  First it adds up the bounds of each block; the few
with the largest are scored, and the k-th best score there is what a block's bound must reach.  Only
documents in such blocks are scored, which gives the same rows as scoring all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of the index, and documents in a block (a power of two).
BUCKETS = 64
BLOCK_BITS = 10
#: Terms of documents whose postings are made at once; where a block's documents have more, its terms get several rows.
HELD = 1 << 23
#: Documents for which a partition of the index gets one more file.
FILE_DOCUMENTS = 1 << 18
#: Blocks that are scored first.
LEAD = 4
#: Parameters of BM25, and decimals of a term's part of a score; sums of decimals don't depend on their order.
K1, B = 1.2, 0.75
DECIMALS = 9
#: Above the rounding of all parts of a bound.
SLACK = 1e-6


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order and with repeats."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS).cast("long")).cast("int")


def _postings(keys: np.ndarray, terms: pa.ListArray, bits: int) -> pa.RecordBatch:
    """A row per term and block of some documents; those of equal key and length are one."""
    lengths = np.diff(terms.offsets.to_numpy())
    docs, doc = np.unique(np.stack((keys, lengths)), axis=1, return_inverse=True)  # in order of keys
    coded = terms.flatten().dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs.shape[1] + np.repeat(doc.ravel(), lengths), return_counts=True)
    term, doc = np.divmod(pairs, max(1, docs.shape[1]))
    key, length = docs[:, doc]
    block = key >> bits
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[:len(term)])
    offsets = pa.array(np.append(first, len(term)).astype(np.int32))
    over = lambda f, x: f.reduceat(x, first) if len(first) else x
    ints = lambda x: pa.array(x.astype(np.int32))
    columns = {
        "term": coded.dictionary.take(pa.array(term[first])), "block": pa.array(block[first]), "n": ints(np.diff(np.append(first, len(term)))),
        "max_tf": ints(over(np.maximum, tf)), "min_length": ints(over(np.minimum, length)), "total": pa.array(over(np.add, tf).astype(np.int64)),
        **{name: pa.ListArray.from_arrays(offsets, ints(x)) for name, x in (("at", key & ((1 << bits) - 1)), ("tf", tf), ("length", length))},
    }
    return pa.RecordBatch.from_pydict(columns)


def _by_block(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Postings of documents (key, terms) that come in order of their keys: of whole blocks, or of `most` terms and more."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = held.column("key").to_numpy()
        ready = int(np.searchsorted(keys >> bits, keys[-1] >> bits)) if len(keys) else 0  # the last block may go on
        if not ready and len(held.column("terms").flatten()) >= most:
            ready = len(keys)
        if ready:
            yield _postings(keys[:ready], held.column("terms").slice(0, ready), bits)
            held = held.slice(ready)
    if held is not None and held.num_rows:
        yield _postings(held.column("key").to_numpy(), held.column("terms"), bits)


def write_index(documents: DataFrame, key: str, text: str, folder: str) -> None:
    """Writes the index of documents (an integer key, one row each; rows without key are left out): `postings` and `totals` under a folder."""
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    count = rows.count()
    terms = F.coalesce(terms_of(F.col("text")), F.array().cast("array<string>")).alias("terms")
    met = rows.withColumn("block", F.shiftright("key", BLOCK_BITS)).repartition("block").sortWithinPartitions("key").select("key", terms)
    schema = "term string, block long, n int, max_tf int, min_length int, total long, at array<int>, tf array<int>, length array<int>"
    blocks = met.mapInArrow(lambda batches, bits=BLOCK_BITS, most=HELD: _by_block(batches, bits, most), schema)
    file = F.pmod(F.xxhash64("block"), F.lit(count // FILE_DOCUMENTS + 1))
    packed = blocks.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", file).sortWithinPartitions("bucket", "term", "block")
    packed.write.partitionBy("bucket").parquet(f"{folder}/postings")
    # a document's length is the sum of its counts
    length = documents.sparkSession.read.schema("total long").parquet(f"{folder}/postings").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("length"))
    length.select(F.lit(count).cast("long").alias("documents"), "length").write.parquet(f"{folder}/totals")


def postings_of(spark: SparkSession, folder: str, terms: Sequence[str]) -> DataFrame:
    """The blocks of some terms; only their partitions are read."""
    wanted = sorted({t.lower() for t in terms})
    schema = "term string, block long, n int, max_tf int, min_length int, at array<int>, tf array<int>, length array<int>, bucket int"
    return spark.read.schema(schema).parquet(f"{folder}/postings").where(F.col("bucket").isin(*[_bucket(F.lit(t)) for t in wanted]) & F.col("term").isin(*wanted))


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))


class _Search:
    """The parts of one search."""

    def __init__(self, spark: SparkSession, folder: str, terms: Sequence[str]):
        self.blocks = postings_of(spark, folder, terms)
        totals = spark.read.schema("documents long, length long").parquet(f"{folder}/totals")
        n = totals.select(F.col("documents").cast("double")).scalar()
        self.mean = totals.select(F.greatest(F.lit(1.0), F.col("length") / F.greatest(F.col("documents"), F.lit(1)))).scalar()
        found = self.blocks.groupBy("term").agg(F.sum("n").cast("double").alias("df"))  # a row per term
        self.weights = found.select("term", F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def bounds(self) -> DataFrame:
        """block and bound: no document of the block has a higher score."""
        heads = self.blocks.select("term", "block", "max_tf", "min_length").join(self.weights, "term")
        return heads.groupBy("block").agg((F.sum(F.col("idf") * _saturated(F.col("max_tf"), F.col("min_length"), self.mean)) + SLACK).alias("bound"))

    def scores(self, of: DataFrame) -> DataFrame:
        """key, matched and score of all documents in some blocks that have any of the terms."""
        rows = self.blocks.join(of.select("block"), "block", "left_semi").join(self.weights, "term")
        each = rows.select("block", "idf", F.explode(F.arrays_zip("at", "tf", "length")).alias("x"))
        part = F.round(F.col("idf") * _saturated(F.col("x.tf"), F.col("x.length"), self.mean), DECIMALS).cast(f"decimal(18,{DECIMALS})")
        each = each.select((F.shiftleft("block", BLOCK_BITS) + F.col("x.at")).alias("key"), part.alias("part"))
        return each.groupBy("key").agg(F.count("*").alias("matched"), F.sum("part").cast("double").alias("score"))

    def open_blocks(self, k: int) -> DataFrame:
        """Blocks that may hold one of the k best documents."""
        lead = self.scores(self.bounds().orderBy(F.desc("bound"), "block").limit(LEAD)).orderBy(F.desc("score")).limit(k)
        least = lead.agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0)).scalar()
        return self.bounds().where(F.col("bound") >= least)


def search_index(spark: SparkSession, folder: str, terms: Sequence[str], k: int = 10) -> DataFrame:
    """The k best documents for some terms: place from 1, key, score (BM25) and matched (number of terms it has); smaller keys first of equals."""
    if not terms:
        return spark.createDataFrame([], "place long, key long, matched long, score double")
    asked = _Search(spark, folder, terms)
    best = asked.scores(asked.open_blocks(k)).orderBy(F.desc("score"), "key").limit(k)  # k rows are left
    rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "matched", "score"))).alias("rows"))
    rows = rows.select(F.posexplode("rows").alias("place", "row"))
    return rows.select((F.col("place") + 1).cast("long").alias("place"), "row.key", "row.matched", "row.score")
