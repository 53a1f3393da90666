"""Streams: staged rows merged as they come, windowed counts, and the last state of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from refloom.operators.merge import last_of_package
from refloom.session import written
from refloom.sources.store import Store

#: Parts of a table that a stream is merged into.
BUCKETS = 64


def upsert_stream(rows: DataFrame, store: Store, table: str, key: str, order: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each micro-batch of a stream into a table of a store: the last row of each key
    wins. The table is kept in BUCKETS parts by its key, and only those that a batch touches are written
    anew. The number of the last batch is part of the same commit, so a batch that is sent again after a
    failure changes nothing."""
    marks = f"{table}_batches"
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        done = store.manifest(marks)
        if number <= done.get("number", -1):
            return
        old = store.manifest(table)
        staged = written(last_of_package(batch, key, order=order), "batch")
        touched = sorted(str(r[0]) for r in staged.select(bucket).distinct().collect())  # BUCKETS at most
        if touched:
            if filled := [b for b in touched if old["chunks"].get(b)]:
                before = store.read_chunks(table, filled)
                staged = before.join(staged.select(key), key, "left_anti").unionByName(staged)
            entry = store.written_chunks(table, staged, bucket, touched, old)
        else:
            entry = {}
        store.commit({table: entry, marks: {"number": number}}, {table: old["version"], marks: done["version"]})

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values by window and kind; later ones than the watermark are dropped by Spark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    found = timed.groupBy(F.window(at, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), by, "n", "total")


def stream_of(spark, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def drained(writer: DataStreamWriter, on_end: Callable[[], None] | None = None) -> None:
    """Run a stream over what is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if on_end:
        on_end()
