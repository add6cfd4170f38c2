"""Watching files as a stream: the same filters, with bursts of events on one path put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import search

QUIET = "300 milliseconds"
LATE = "1 second"
LONGEST_WATCH = 600


def debounce(events: DataFrame, key: str = "path", gap: str = QUIET, late: str = LATE) -> DataFrame:
    """(key, start, end, op, events): bursts on one key with pauses shorter than *gap*; the latest operation counts.

    *events* has ts, op and the key, and may be a stream: then events are waited
    for by *late*, which the watermark needs.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    out = rows.groupBy(key, w.alias("w")).agg(F.max_by("op", "ts").alias("op"), F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "op", "events")


def watch(files: DataFrame, expression: str = "") -> DataFrame:
    """A stream of file rows through the same filter as a batch search."""
    return search.where(files, expression)


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of *folder* as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def collect_for(stream: DataFrame, name: str, seconds: float = 30) -> StreamingQuery:
    """Runs *stream* into a memory table *name* for *seconds* (600 at most) and stops it."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.awaitTermination(min(seconds, LONGEST_WATCH))
    query.stop()
    return query


def keep_index(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest state of each path as Parquet versions under *folder*; deleted and renamed paths go.

    Each micro-batch writes a new version from the last one, so a failed batch
    leaves the last version whole, and a repeated one writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        alive = last.where(~F.col("op").isin("delete", "rename"))
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}")
            alive = old.join(last.select("path"), "path", "left_anti").select(*batch.columns).unionByName(alive)
        alive.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
