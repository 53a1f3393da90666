"""Materialized views that are kept fresh chunk by chunk."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators.numbering import numbered
from refloom.sources.store import Store


RUN_LOG, RUNS = "materialized_view_refresh_log", "view string, start_time timestamp_ntz, end_time timestamp_ntz, chunks int"


def bucket_chunks(chunks: DataFrame, size: int, chunk: str = "chunk") -> DataFrame:
    """(bucket, chunks): distinct chunks in order, so many to a bucket."""
    placed = numbered(chunks.select(chunk).distinct(), chunk, name="_n")
    bucket = (F.floor((F.col("_n") - 1) / size) + 1).cast("long")
    return placed.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))


def missing_chunks(chunks: DataFrame, registry: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Chunks that aren't filled, or no longer valid."""
    return chunks.select(chunk).subtract(registry.select(chunk))


def refresh_chunks(view: DataFrame, fresh: DataFrame, chunks: DataFrame, chunk: str = "chunk") -> DataFrame:
    """view with the given chunks taken from fresh. Rows without a chunk go at any refresh, as nothing else
    would ever remove them; keys should not be null."""
    kept = view.where(F.col(chunk).isNotNull()).join(chunks.select(chunk), chunk, "left_anti")
    return kept.unionByName(fresh.where(F.col(chunk).isNotNull()).join(chunks.select(chunk), chunk, "left_semi"))


def registered(registry: DataFrame, chunks: DataFrame, at, chunk: str = "chunk") -> DataFrame:
    """registry with chunks that weren't in it, refreshed at a time."""
    return registry.unionByName(missing_chunks(chunks, registry, chunk).withColumn("refresh_time", at))


def row_parts(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """rows with ``part``, from 1: so many rows to a part in the order of a key, which should be unique."""
    placed = numbered(rows, *key, name="_n")
    return placed.withColumn("part", (F.floor((F.col("_n") - 1) / limit) + 1).cast("long")).drop("_n")


def cascaded(registry: DataFrame, refreshed: DataFrame, chunk_of: Callable[[DataFrame], DataFrame], chunk: str = "chunk") -> DataFrame:
    """The registry of a dependent view after chunks of its master were refreshed: without the chunks that
    chunk_of finds in their rows."""
    return registry.join(chunk_of(refreshed).select(chunk).distinct(), chunk, "left_anti")


def months_between(column: str, months: list[str] | None) -> Column:
    """A filter on a timestamp column for months (yyyy-MM): ranges of the column itself, which reach the scan.
    Months that follow one another are one range. None: all."""
    if months is None:
        return F.lit(True)
    ranges: list[list[dt.date]] = []
    for m in sorted(set(months)):
        first = dt.date.fromisoformat(f"{m}-01")
        after = (first + dt.timedelta(days=31)).replace(day=1)
        if ranges and ranges[-1][1] == first:
            ranges[-1][1] = after
        else:
            ranges.append([first, after])
    bound = lambda d: F.lit(d.isoformat()).cast("timestamp_ntz")
    parts = ((F.col(column) >= bound(a)) & (F.col(column) < bound(b)) for a, b in ranges)
    return reduce(lambda a, b: a | b, parts, F.lit(False))


@dataclass
class ChunkedView:
    """A view stored by chunks. build gives its rows for some chunks (all, for None), and filters its scans by
    them; keys gives the chunks that there are now, without building the rows."""

    name: str
    build: Callable[[SparkSession, list[str] | None], DataFrame]
    chunk: str
    keys: Callable[[SparkSession], DataFrame]
    #: Chunks of one refresh job at most; None: all at once.
    bucket: int | None = None
    #: Views whose chunks depend on this one's: what forgets those that refreshed rows concern.
    dependants: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def chunks(self, spark: SparkSession) -> list[str]:
        """All chunks that the view has now: one value for each, which the manifest names anyway."""
        found = self.keys(spark).select(F.col(self.chunk).cast("string").alias("c")).where("c IS NOT NULL").distinct()
        return sorted(r["c"] for r in found.collect())

    def refresh(self, spark: SparkSession, store: Store, chunks: list[str] | None = None) -> list[str]:
        """Fill the given chunks, or those that aren't filled; readers see the old state until the end."""
        todo = self.chunks(spark) if chunks is None else list(map(str, chunks))
        if chunks is None:
            filled = set(store.manifest(self.name)["chunks"])
            todo = [c for c in todo if c not in filled]
        step = self.bucket or max(len(todo), 1)
        for i in range(0, len(todo), step):
            part = todo[i : i + step]
            rows = self.build(spark, part).where(F.col(self.chunk).cast("string").isin(part))
            store.write_chunks(self.name, rows, self.chunk, part)
            for call in self.dependants:
                call(store.read_chunks(self.name, part))
        return todo

    def refresh_logged(self, spark: SparkSession, store: Store, start: dt.datetime, end: Callable[[], dt.datetime] = dt.datetime.now) -> list[str]:
        """Fill what isn't filled, and note the run (view, start, end, chunks) in the store."""
        done = self.refresh(spark, store)
        run = spark.createDataFrame([(self.name, start, end(), len(done))], RUNS)
        version = store.manifest(RUN_LOG)["version"]
        log = store.read(RUN_LOG).unionByName(run).coalesce(1) if version else run
        store.write(RUN_LOG, log, version)
        return done

    def refresh_fully(self, spark: SparkSession, store: Store) -> None:
        """All chunks anew; chunks that are no more go."""
        now = self.chunks(spark)
        self.refresh(spark, store, now)
        gone = [c for c in store.manifest(self.name)["chunks"] if c not in set(now)]
        if gone:
            store.drop_chunks(self.name, gone)

    def invalidate(self, store: Store, chunks: list[str]) -> None:
        """Forget chunks, so that the next refresh fills them."""
        store.drop_chunks(self.name, chunks)

    def read(self, store: Store, chunks: list[str] | None = None) -> DataFrame:
        return store.read_chunks(self.name, chunks)
