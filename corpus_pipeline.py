"""From documents to token ids: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of documents, and extra columns as they are,
whatever their names.  Each stage's module states what becomes of nulls, blanks, repeats and
empty tables: null or blank texts are scored, linked with nothing, cut nowhere and
encoded as no ids; rows that repeat a doc_id become one in the second stage, rows with
null doc_id all stay.  SQL can't express the
trained classifier or the encoder, so run() has no SQL; tests hold each stage
against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe_codec, decontamination, jaccard_join, quality_classifier, substring_dedup
from quillgraph.llm.shared import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.filtered(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links hold together, the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; the documents stay."""
    return substring_dedup.substring_dedup(docs, length="n_chars")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    import public_tokenizers

    return bpe_codec.token_lists(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
