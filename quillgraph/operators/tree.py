"""Trees stored as materialised paths: a node's path is its parent's path and one more step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 4  # characters of a step
BASE = 36  # of the numbers that steps are: digits, then A to Z


def parent_path(path: Column, step: Column | int = STEP) -> Column:
    """The path without its last step."""
    step = step if isinstance(step, Column) else F.lit(step)
    return F.substr(path, F.lit(1), F.length(path) - step)


def children(parents: DataFrame, nodes: DataFrame, step: str | None = None) -> DataFrame:
    """Pairs (parent_path, child_path) of nodes and their parents, both with column `path`.

    An equality of parent paths, so that it is a hash or merge join; a condition on
    prefixes would compare all with all.  step: column of nodes with the length of
    their last step, when it isn't STEP.
    """
    own = nodes.select(F.col("path").alias("child_path"), parent_path(F.col("path"), F.col(step) if step else STEP).alias("parent_path"))
    return own.join(parents.select(F.col("path").alias("parent_path")), "parent_path").select("parent_path", "child_path")


def descendants(ancestors: DataFrame, nodes: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Pairs (ancestor_path, path) of nodes and all nodes above them.

    Each node is exploded into its proper prefixes of the given path lengths, which
    are then joined by equality.
    """
    prefixes = F.array(*[F.substring("path", 1, n) for n in lengths])
    cut = F.array(*[F.lit(n) for n in lengths])
    above = F.filter(F.arrays_zip(prefixes.alias("p"), cut.alias("n")), lambda x: x["n"] < F.length("path"))
    rows = nodes.select("path", F.explode(F.transform(above, lambda x: x["p"])).alias("ancestor_path"))
    return rows.join(ancestors.select(F.col("path").alias("ancestor_path")), "ancestor_path").select("ancestor_path", "path")


def child_counts(parents: DataFrame, children_: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Every parent's key and number of children, zero included."""
    count = children_.groupBy(F.col(parent_key).alias(key)).agg(F.count("*").alias("numchild"))
    return parents.select(key).join(count, key, "left").withColumn("numchild", F.coalesce("numchild", F.lit(0).cast("long")))


def step_text(number: Column, base: int = BASE) -> Column:
    """A number as a step of STEP characters; one that doesn't fit is an error when the query runs."""
    digits = F.conv(number.cast("string"), 10, base)
    full = F.raise_error(F.concat(F.lit("no room for child number "), number.cast("string"))).cast("string")
    return F.when(F.length(digits) > STEP, full).otherwise(F.lpad(digits, STEP, "0"))


def add_children(nodes: DataFrame, new: DataFrame, base: int = BASE) -> DataFrame:
    """nodes (path, depth, numchild, ...) with `new` rows (parent_path, order, and the other columns of nodes) as their parents' last children.

    New rows follow the last child there is, in their `order`; steps are numbers of the given base.
    A parent has room for base ** STEP - 1 children; beyond that the query fails, and so it does
    for a row under a path that is not there.  Only nodes under the parents of new rows are grouped.
    """
    parents = new.select("parent_path").distinct()
    siblings = nodes.select(parent_path(F.col("path")).alias("parent_path"), F.substring("path", -STEP, STEP).alias("_step")).join(parents, "parent_path", "left_semi")
    last = siblings.groupBy("parent_path").agg(F.max(F.conv("_step", base, 10).cast("long")).alias("_last"))
    place = F.row_number().over(Window.partitionBy("parent_path").orderBy("order"))
    rows = new.withColumn("_nth", place).join(last, "parent_path", "left")
    rows = rows.join(nodes.select(F.col("path").alias("parent_path"), F.col("depth").alias("_depth")), "parent_path", "left")
    missing = F.raise_error(F.concat(F.lit("no parent at path "), F.coalesce("parent_path", F.lit("null")))).cast("int")
    rows = rows.withColumn("path", F.concat("parent_path", step_text(F.coalesce("_last", F.lit(0)) + F.col("_nth"), base)))
    rows = rows.withColumn("depth", (F.when(F.col("_depth").isNull(), missing).otherwise(F.col("_depth")) + 1).cast(nodes.schema["depth"].dataType)).withColumn("numchild", F.lit(0).cast(nodes.schema["numchild"].dataType))
    grown = new.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("_new"))
    old = nodes.join(grown, "path", "left").withColumn("numchild", (F.col("numchild") + F.coalesce("_new", F.lit(0))).cast(nodes.schema["numchild"].dataType))
    return old.select(*nodes.columns).unionByName(rows.select(*nodes.columns))


def type_violations(nodes: DataFrame, rules: Mapping[str, Sequence[str]], step: Column | int = STEP) -> DataFrame:
    """Nodes (path, content_type) whose type may not lie under their parent's; rules: the parents' types that each limited type may have.

    Types without a rule may lie anywhere; a limited node without a parent breaks its
    rule.  Rules are part of the plan: only nodes of limited types are looked at as children.
    """
    type_ = F.col("content_type")
    parents = nodes.select(F.col("path").alias("_parent"), type_.alias("parent_type"))
    limited = nodes.where(type_.isin(*rules)).withColumn("_parent", parent_path(F.col("path"), step))
    fits = F.lit(False)
    for kind, parent_types in rules.items():
        fits = fits | ((type_ == kind) & F.col("parent_type").isin(*parent_types))
    pairs = limited.join(parents, "_parent", "left")
    return pairs.where(~F.coalesce(fits, F.lit(False))).select("path", "content_type", "parent_type")
