"""URL filter by association rules.

URLs become small sets of tokens: parts of the host, first directory, file
extension, names of the query, and so on.  On labelled pages Spark's FP-growth
finds the token sets that go with a label; rules with enough support and
confidence are kept, unless a rule with some of its tokens is as sure.  A page gets the
verdict of the surest rule that its tokens fit, found by an inverted index from
each rule's rarest token.  Given host and path rules come before, the longest first.

A page is labelled by the row of `labels` whose doc_id is its page_id: bad when
quality is 0 or toxic is 1.  All rules that are left go to the tasks: a page has ten
tokens at most and so 1024 sets of them, so MIN_SUPPORT bounds their number.

Cases: null urls and urls without :// have empty host and path and are allowed
unless a mined rule says otherwise; null page_ids are returned as they are; labels
that repeat a doc_id count as bad if one of them is; with no labels there are no
mined rules; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import pick

#: (verdict, host, path): given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6
#: The odds of a rule's label must be so many times its odds among all labelled pages; a rule without exceptions always is.
MIN_ODDS = 3

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest given rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """At most ten tokens of a URL."""
    part = lambda k: F.try_element_at(F.split(host, r"\."), F.lit(k))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)))), ",")
    some = [
        F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.concat(F.lit("top="), part(-1)), F.concat(F.lit("domain="), part(-2), F.lit("."), part(-1)), F.concat(F.lit("sub="), part(-3)), F.concat(F.lit("first="), part(1)),
        F.concat(F.lit("dir="), F.nullif(F.regexp_extract(path, r"^/([^/]+)/", 1), F.lit(""))),
        F.concat(F.lit("type="), F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), F.lit(""))),
        F.concat(F.lit("query="), F.nullif(names, F.lit(""))),
        F.when(F.contains(url, F.lit("#")), "fragment"),
        F.concat(F.lit("depth="), F.least(F.size(F.split(path, "/")), F.lit(9)).cast("string")),
    ]
    return F.array_distinct(F.array_compact(F.array(*some)))


@dataclass(frozen=True)
class Rule:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float


def pruned(rules: DataFrame) -> DataFrame:
    """Without rules (tokens, verdict, confidence, support) that a rule with some of the same tokens makes needless: same verdict and as sure."""
    rules = rules.withColumn("tokens", F.array_sort("tokens"))
    masks = F.explode(F.expr("sequence(1, greatest(1, shiftleft(1, size(tokens)) - 2))"))
    parts = rules.where(F.size("tokens") > 1).select(F.col("tokens").alias("whole"), "verdict", F.col("confidence").alias("sure"), masks.alias("mask"))
    parts = parts.withColumn("tokens", F.expr("filter(whole, (x, k) -> (shiftright(mask, k) & 1) = 1)"))
    needless = parts.join(rules, ["tokens", "verdict"]).where("confidence >= sure").select(F.col("whole").alias("tokens"), "verdict")
    return rules.join(needless, ["tokens", "verdict"], "left_anti")


def mine(pages: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from labelled pages (columns page_id, tokens; doc_id, quality, toxic)."""
    known = pick(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").alias("page_id"))
    known = known.agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    rows = pages.join(known, "page_id").select(F.array_append("tokens", F.when(F.col("bad") == 1, "=block").otherwise("=allow")).alias("items"))
    if rows.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(rows)
    found = model.associationRules.where(F.array_contains("consequent", "=block") | F.array_contains("consequent", "=allow"))
    share = F.col("confidence") / F.col("lift")
    surer = F.col("confidence") * (1 - share) >= MIN_ODDS * share * (1 - F.col("confidence"))
    found = found.where(surer & (F.size("consequent") == 1)).select(F.col("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")
    return [Rule(frozenset(r.tokens), r.verdict, r.confidence, r.support) for r in pruned(found).collect()]


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule]):
        use: dict[str, int] = {}
        for rule in rules:
            for t in rule.tokens:
                use[t] = use.get(t, 0) + 1
        self.by: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by.setdefault(min(rule.tokens, key=lambda t: (use[t], t)), []).append(rule)

    def verdict(self, url_tokens: list[str]) -> Rule | None:
        """The surest rule that fits; of equals the better supported, then the one that allows, then by its tokens."""
        have = set(url_tokens)
        fit = [r for t in have for r in self.by.get(t, ()) if r.tokens <= have]
        return min(fit, key=lambda r: (-r.confidence, -r.support, r.verdict, sorted(r.tokens)), default=None)


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """Per page (columns page_id, url): page_id, host, path, rule, verdict, mined (tokens of the mined rule that fits)."""
    rows = pick(pages, "page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = given_rule(host, path, rules)
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), tokens(F.coalesce("url", F.lit("")), host, path).alias("tokens"), name.alias("rule"), verdict.alias("given"))
    index = Index(mine(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.verdict(t) for t in batch.column("tokens").to_pylist()]
            mined = [None if r is None else " ".join(sorted(r.tokens)) for r in found]
            verdicts = [g or ("allow" if r is None else r.verdict) for g, r in zip(batch.column("given").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(mined, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, mined string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
