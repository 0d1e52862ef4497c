"""Streams: windowed counts with late data, redelivery dropped by key, and incremental indexing batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshot_diff import plan


def event_counts(events: DataFrame, window: str = "1 hour", late: str | None = "2 days") -> DataFrame:
    """Events by window and type.  On a stream ``late`` bounds how long a window waits, and with it the state kept."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late and e.isStreaming else e
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def without_redelivery(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Each key once: within the watermark on a stream, the earliest row in a batch."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    first = events.groupBy(key).agg(F.min(F.struct("ts", "event_id")).alias("_f"))
    return events.join(first.select(F.col("_f.event_id").alias("event_id")), "event_id", "left_semi")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into parquet, and reads it back.  Run again it goes on where it ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def index_incrementally(listings: DataFrame, state: str, out: str, checkpoint: str, keys=("path",), compare=("blob_sha",)) -> None:
    """Plans each batch of full listings against the last one kept under ``state``, and writes the plan under ``out``.

    The batch's number names its output folders, so a batch that is delivered again after a loss overwrites itself, and
    the listing of batch n - 1 is what batch n is compared with.
    """
    spark = listings.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listings.schema.fields if f.name in (*keys, *compare))

    def each(batch: DataFrame, number: int) -> None:
        now = batch.select(*keys, *compare).dropDuplicates(list(keys))
        before = spark.read.parquet(f"{state}/batch={number - 1}") if number else spark.createDataFrame([], fields)
        plan(now, before, list(keys), list(compare)).withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")
        now.write.mode("overwrite").parquet(f"{state}/batch={number}")

    listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stuck(events: DataFrame, key: str, final: list[str], after: str) -> DataFrame:
    """Keys whose last event is not final and lies more than ``after`` before the newest event of all."""
    last = events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select(key, F.col("l.ts").alias("last_at"), F.col("l.event_type").alias("last_type"))
    newest = events.agg(F.max("ts").alias("n")).first()["n"]
    return last.filter(~F.col("last_type").isin(final) & (F.col("last_at") < F.lit(newest) - F.expr(f"interval {after}")))


def freshness(snapshots: DataFrame, keys: list[str], within: str = "60 seconds") -> DataFrame:
    """Per key the newest snapshot, the newest ready one, how many seconds it lies behind, and whether that is ``within``; a
    key without a ready snapshot is not fresh."""
    g = snapshots.groupBy(*keys).agg(F.max("created_at").alias("newest"), F.max(F.when(F.col("status") == "ready", F.col("created_at"))).alias("serving"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return g.withColumns({"behind": (at("newest") - at("serving")) / 1e6, "is_fresh": F.coalesce(F.col("serving") + F.expr(f"interval {within}") >= F.col("newest"), F.lit(False))})


def stream_of(spark: SparkSession, directory: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
