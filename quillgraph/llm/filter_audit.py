"""What filters remove, keep and take from each other in every order, kept up to date over a stream of files.

Five filters judge a document: A too few words, B too few distinct ones, C too many capitals,
D a symbol of markup, E a text that a document with a smaller id has.  The first four look at
the document alone and make its mask.  E looks at the whole table, and changes for
documents that were judged before when a smaller id comes later.

The files are read as a stream, in micro-batches of about `batch_bytes` until none is left.  State is kept by
text (its SHA-256): the smallest id so far, with the part, mask and labels of its rows.  Each
batch sums its documents by text first, map-side, so that a text with a third of all rows is a
row per task, part and label; then texts of the batch and the state meet, once by text.  Rows of the
smallest id count without E and all others with it; where the batch brings a
smaller id than the state had, the earlier rows are retracted: minus one without E, plus one with
it.  What a batch writes is both: changes of the part counters, and the state's new rows.  It goes to a
folder named by the batch, which a repeated batch overwrites and reads no further than, so
that a batch that is run again after a failure counts once.  Counters are sums of all changes,
and can be read after each batch.  With the same folder a later run takes up new files only.

The report needs no documents: at most 32 masks per part say for all 120 orders what each step
does, as a filter removes those that fail it and none before it.

Cases: a null text is empty; empty texts are equal to one another.  A null source is the part "".  Rows
that repeat a doc_id and text are not copies of one another, as neither has the smaller id: if
it is the smallest, all stay without E.  A row with null doc_id is no copy and has none, and has no
labels.  A document is good or toxic when any of its labels says so.  An empty table, or no file,
has no parts and gives no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_folder
from .source_mix import WORD
from .textkernel import pick

#: Micro-batches that a whole table is read in, about.
BATCHES = 4
FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
COPY = BIT["E"]
STATE = "key binary, id long, part string, mask int, good int, toxic int, n long, state boolean"


def mask(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {"A": n < 50, "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * n, "C": F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text), "D": text.rlike("[#$%&*|]")}
    total = F.lit(0)
    for name, failed in fails.items():
        total = total + F.when(failed, BIT[name]).otherwise(0)
    return total.cast("int")


def judged(docs: DataFrame) -> DataFrame:
    """key (of the text), id, part and mask of documents (doc_id, source, text), batch or stream."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, "doc_id", "source", "text").select(F.unhex(F.sha2(text, 256)).alias("key"), F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), mask(text).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, 0 or 1."""
    any_ = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(any_("quality").alias("good"), any_("toxic").alias("toxic"))
    return rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def changes(rows: DataFrame, state: DataFrame) -> DataFrame:
    """What a batch's rows (key, id, part, mask, good, toxic) change, with columns of STATE: rows of the counters, those marked `state` being the texts' new smallest ids."""
    kind = ["part", "mask", "good", "toxic"]
    alone = rows.where("id IS NULL").groupBy(*kind).agg(F.count("*").alias("n"))
    same = rows.where("id IS NOT NULL").groupBy("id", "key", *kind).agg(F.count("*").alias("n"))
    groups = same.groupBy("key", *kind).agg(F.min(F.struct("id", "n")).alias("first"), F.sum("n").alias("n"))
    new = groups.select("key", "first.id", *kind, F.col("first.n").alias("n"), (F.col("n") - F.col("first.n")).alias("more"), F.lit(False).alias("old"))
    old = state.select("key", "id", *kind, "n", F.lit(0).cast("long").alias("more"), F.lit(True).alias("old"))
    of_text = Window.partitionBy("key")
    both = new.unionByName(old).withColumns({"now": F.min("id").over(of_text), "was": F.min(F.when(F.col("old"), F.col("id"))).over(of_text)})
    first = F.col("id") == F.col("now")
    gone = F.col("old") & (F.col("id") == F.col("was")) & ~first
    copy = F.col("mask").bitwiseOR(F.lit(COPY))
    row = lambda mask_, n, state_: F.struct(mask_.cast("int").alias("mask"), n.alias("n"), F.lit(state_).alias("state"))
    made = F.when(F.col("old"), F.when(gone, F.array(row(F.col("mask"), -F.col("n"), False), row(copy, F.col("n"), False))))
    made = made.when(first, F.array(row(F.col("mask"), F.col("n"), True), row(copy, F.col("more"), False))).otherwise(F.array(row(copy, F.col("n") + F.col("more"), False)))
    out = both.select("key", "id", "part", "good", "toxic", F.explode(made).alias("to")).where("to.n <> 0")
    kept = lambda c: F.when(F.col("to.state"), F.col(c)).alias(c)
    out = out.select(kept("key"), kept("id"), "part", "to.mask", "good", "toxic", "to.n", "to.state")
    none = alone.select(F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("id"), *kind, "n", F.lit(False).alias("state"))
    return out.unionByName(none)


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """All that batches have written, with the batch's number."""
    return spark.read.schema(STATE + ", batch long").option("basePath", folder).parquet(folder)


def _exactly(path: str) -> str:
    """The path as a pattern that nothing else fits: a stream takes a single file by a pattern only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def audit_files(spark: SparkSession, path: str, labels: DataFrame, folder: str, batch_bytes: int | None = None) -> None:
    """Takes the Parquet files at a path that `folder` has not seen, with columns doc_id, source and text, into the audit kept there.

    batch_bytes: of files in a micro-batch; by default what makes BATCHES of those that are there.
    """
    out = f"{folder}/changes"
    if batch_bytes is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        batch_bytes = -(-(files.agg(F.sum("length")).first()[0] or 0) // BATCHES)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", max(1, batch_bytes)).parquet(_exactly(path))

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = _written(session, out).where(F.col("state") & (F.col("batch") < number)) if number else session.createDataFrame([], STATE)
        found = changes(labelled(batch, labels), state)
        found.write.mode("overwrite").partitionBy("state").parquet(f"{out}/batch={number}")

    judged(stream).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(take).start().awaitTermination()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per part and mask of failed filters: n, and how many of them are good and toxic."""
    if not _there(spark, f"{folder}/changes"):
        return spark.createDataFrame([], "part string, mask int, n long, good long, toxic long")
    rows = _written(spark, f"{folder}/changes")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def report(counted: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, removed before, failed alone, lost of good and toxic, and the filter's removals over all orders."""
    masks = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")  # 32 at most
    rows = counted.groupBy("part").agg(masks).withColumn("filter_order", F.lit(""))
    for _ in FILTERS:  # each order grows by each filter that it doesn't hold
        longer = F.transform(F.filter(F.array(*[F.lit(x) for x in FILTERS]), lambda x: ~F.contains(F.col("filter_order"), x)), lambda x: F.concat("filter_order", x))
        rows = rows.withColumn("filter_order", F.explode(longer))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(text: Column) -> Column:
        out = F.lit(0)
        for name, bit in BIT.items():
            out = out + F.when(F.contains(text, F.lit(name)), bit).otherwise(0)
        return out

    mine = bits(F.substr("filter_order", F.col("step"), F.lit(1)))
    before = bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))
    rows = rows.withColumns({"mine": mine, "before": before})
    fails = lambda x, what: x["mask"].bitwiseAND(F.col(what)) != 0

    def total(holds, value) -> Column:
        return F.aggregate(F.filter("masks", holds), F.lit(0).cast("long"), lambda sum_, x: sum_ + value(x))

    removed = lambda x: fails(x, "mine") & ~fails(x, "before")
    orders = 120
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x, "mine") & ~fails(x, "before"), lambda x: x["n"]).alias("kept"),
        total(removed, lambda x: x["n"]).alias("removed"),
        total(lambda x: fails(x, "mine") & fails(x, "before"), lambda x: x["n"]).alias("redundant"),
        total(lambda x: x["mask"] == F.col("mine"), lambda x: x["n"]).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"),
        total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        # of those that fail k filters, each filter is the first in one order of k
        total(lambda x: fails(x, "mine"), lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "audit")
    audit_files(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"), folder)
    return report(counters(spark, folder))
