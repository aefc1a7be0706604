"""Event rules on streams: coalescing, once only, state of a toggle.

All take and return streaming DataFrames with columns ts (timestamp), key and what
else the events have; they work on batches alike where no state is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def coalesced(events: DataFrame, key: str, frame: str, late: str, value: str) -> DataFrame:
    """One row per key and time frame: how many events it had, and the last value. Frames end when `late` has passed."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", frame), key).agg(F.count("*").alias("n"), F.max_by(value, F.struct("ts", value)).alias("last")).select(
        F.col("window.start").alias("frame"), key, "n", "last"
    )


def once_only(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key, as long as the watermark holds it back."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def seen_keys(events: DataFrame, key: str) -> DataFrame:
    """Every key once, for ever."""
    return events.select(key).dropDuplicates([key])


def revealed(events: DataFrame, share: str, threshold: float = 0.12) -> DataFrame:
    """Events of items of which enough is in sight."""
    return events.where(F.col(share) >= threshold)


def share_in_sight(top: Column, height: Column, view: Column, margin: float = 0.08) -> Column:
    """How much of an item is in sight (0 to 1): its top from the view's upper edge, its height, the view's height without the margin at its lower edge."""
    seen = F.least(top + height, view * (1 - margin)) - F.greatest(top, F.lit(0.0))
    return F.greatest(F.lit(0.0), seen) / F.nullif(height, F.lit(0.0))


def toggled(events: DataFrame, key: str) -> DataFrame:
    """Per key the number of switches so far and whether it is open: open after an odd number."""
    return events.groupBy(key).agg(F.count("*").alias("switches")).withColumn("is_open", F.col("switches") % 2 == 1)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows it wrote under `folder`.

    With mode complete or update, the rows of the last batch that wrote are returned.
    """
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out = f"{folder}/stream-{name}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/stream-state-{name}")
    if mode == "append":
        writer.outputMode("append").format("parquet").start(out).awaitTermination()
    else:
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        writer.outputMode(mode).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
