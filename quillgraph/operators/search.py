"""Search by an inverted index of terms and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf): how often each lower-case run of letters and digits is in each text."""
    terms = F.explode(F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))
    return documents.select(key, terms.alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def search(index: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """(key, matched, score) of documents with any of the terms: how many of them, and the sum of counts."""
    hits = index.where(F.col("term").isin(*[t.lower() for t in terms]))
    return hits.groupBy(key).agg(F.count("*").alias("matched"), F.sum("tf").alias("score"))


def search_texts(documents: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """As search, for a single question without an index: other terms are left behind before rows are made of them."""
    wanted = [t.lower() for t in terms]
    found = F.explode(F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+"), lambda t: t.isin(*wanted)))
    counts = documents.select(key, found.alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counts.groupBy(key).agg(F.count("*").alias("matched"), F.sum("tf").alias("score"))
