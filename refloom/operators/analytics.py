"""Views on how the engine runs: durations, statistics, sizes, locks, log ages, snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refloom.functions.names import pretty_size, whole_percent
from refloom.plans.graph import closure


def seconds(start: str, end: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1e6


def refresh_durations(log: DataFrame, views: DataFrame) -> DataFrame:
    """Runs of enabled views with their seconds."""
    on = views.where("NOT coalesce(is_disabled, false)").select(F.col("id").alias("meta_view_id"), F.col("internal_name").alias("meta_view_name"))
    return log.join(on, "meta_view_id").select("meta_view_id", "meta_view_name", "start_time", "end_time", seconds("start_time", "end_time").alias("duration"))


def refresh_degradation(durations: DataFrame) -> DataFrame:
    """(meta_view_id, avg_duration, last_time, last_duration, degradation): the last run against the mean. The
    last run is found while grouping; no window needs all runs of a view together."""
    last = F.max(F.struct("start_time", "duration"))
    found = durations.groupBy("meta_view_id").agg(F.avg("duration").alias("avg_duration"), last.alias("_last"))
    return found.select(
        "meta_view_id",
        "avg_duration",
        F.col("_last.start_time").alias("last_time"),
        F.col("_last.duration").alias("last_duration"),
        whole_percent(F.col("_last.duration"), F.col("avg_duration")).alias("degradation"),
    )


def statistics_as_of(inquiries: DataFrame, updates: DataFrame, key: str, hours: int = 1) -> DataFrame:
    """(key, inquiry_id, inquiry_time, last_update, is_outdated): the latest update not later than each inquiry,
    by one pass over both in order of time, not a join of all pairs."""
    asked = inquiries.select(key, F.col("inquiry_time").alias("at"), F.lit(1).alias("side"), "inquiry_id", F.lit(None).cast("timestamp_ntz").alias("seen"))
    told = updates.select(key, F.col("update_time").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("inquiry_id"), F.col("update_time").alias("seen"))
    before = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(told).withColumn("last_update", F.last("seen", ignorenulls=True).over(before)).where("side = 1")
    late = F.timestamp_diff("MICROSECOND", F.col("last_update"), F.col("at")) >= hours * 3_600_000_000
    return both.select(key, "inquiry_id", F.col("at").alias("inquiry_time"), "last_update", F.coalesce(late, F.lit(True)).alias("is_outdated"))


def size_rollup(sizes: DataFrame, partitions: DataFrame, largest: str = "TB") -> DataFrame:
    """(table_name, n_size, s_size): sizes with those of partitions (table_name, parent) added to their parents; told
    in units up to the largest."""
    up = sizes.join(partitions, "table_name", "left").select(F.coalesce("parent", "table_name").alias("table_name"), "size")
    return up.groupBy("table_name").agg(F.sum("size").alias("n_size")).withColumn("s_size", pretty_size(F.col("n_size"), largest))


def schema_sizes(sizes: DataFrame, largest: str = "TB") -> DataFrame:
    """(schema_name, sys_obj_type, n_total_relation_size, s_total_relation_size), told in units up to the largest."""
    found = sizes.groupBy("schema_name", "sys_obj_type").agg(F.sum("n_total_relation_size").alias("n_total_relation_size"))
    return found.withColumn("s_total_relation_size", pretty_size(F.col("n_total_relation_size"), largest))


def undescribed(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """(schema_name, obj_name, is_undescribed, undescribed_column_count) of what lacks a description."""
    bad = columns.groupBy("schema_name", "obj_name").agg(F.count_if(F.col("description").isNull()).alias("n"))
    found = objects.join(bad, ["schema_name", "obj_name"], "left").select(
        "schema_name", "obj_name", F.col("description").isNull().alias("is_undescribed"), F.coalesce("n", F.lit(0)).cast("long").alias("undescribed_column_count")
    )
    return found.where("is_undescribed OR undescribed_column_count > 0")


def numbered_indexes(indexes: DataFrame) -> DataFrame:
    """indexes with their number in each table, by name."""
    return indexes.withColumn("index_number", F.row_number().over(Window.partitionBy("schema_name", "table_name").orderBy("index_name")))


def listed_indexes(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """Numbered indexes with their columns in order. columns: (schema_name, table_name, index_name, column_name,
    position)."""
    key = ["schema_name", "table_name", "index_name"]
    order = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    lists = columns.groupBy(*key).agg(F.array_join(F.transform(order, lambda x: x["column_name"]), ", ").alias("index_columns"))
    return numbered_indexes(indexes).join(lists, key, "left")


def inquired_masters(views: DataFrame, edges: DataFrame, most_levels: int = 2) -> DataFrame:
    """(view_id, master_id, level) of the masters whose statistics a refresh of the views (id) looks at: those that are
    not further than so many levels."""
    found = closure(edges, views.select(F.col("id").alias("root")), level_limit=most_levels)
    return found.select(F.col("root").alias("view_id"), F.col("node").alias("master_id"), (-F.col("level")).cast("int").alias("level"))


#: Parts among which those that wait for one target are dealt; its holders go to each part.
LOCK_PARTS = 32


def blocked_activity(locks: DataFrame) -> DataFrame:
    """(pid, blocking_pid): who waits for whom: the same lock target, nulls equal to nulls, held by another. There
    are as many rows as such pairs, however many share a target. Two meet again only if either has several
    targets; other pairs are told as they are found, without being shuffled."""
    n = int(locks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = F.struct("locktype", "database", "relation", "page")  # fields of a struct are equal if both are null
    several = (F.count("*").over(Window.partitionBy("pid")) > 1).alias("several")

    def side(rows: DataFrame, part: Column) -> DataFrame:
        own = rows.select("pid", target.alias("target")).distinct().select("pid", "target", several)
        return own.withColumn("part", part).repartition(n, "target", "part")  # so many, as pairs are far more than rows

    w = side(locks.where("NOT granted"), F.pmod(F.xxhash64("pid"), F.lit(LOCK_PARTS)).cast("int")).withColumnRenamed("several", "waits")
    h = side(locks.where("granted"), F.explode(F.sequence(F.lit(0), F.lit(LOCK_PARTS - 1)))).withColumnsRenamed({"pid": "blocking_pid", "several": "holds"})

    def met(w: DataFrame, h: DataFrame, which: str) -> DataFrame:
        return w.join(h, ["target", "part"]).where(f"pid != blocking_pid AND {which}").select("pid", "blocking_pid")

    return met(w, h, "NOT (waits AND holds)").union(met(w.where("waits"), h.where("holds"), "true").distinct())


def maintenance_mode(locks: DataFrame, views: DataFrame, now: Column) -> DataFrame:
    """One row if a deployment lock is younger than a day, or a materialized view was never filled."""
    fresh = locks.where(F.timestamp_diff("HOUR", F.col("lock_time"), now) < 24).select(F.lit("deployment").alias("process_name"), "lock_time", "locked_by")
    empty = views.where("is_materialized AND refresh_time IS NULL").select(
        F.lit("initial refresh").alias("process_name"), F.lit(None).cast("timestamp_ntz").alias("lock_time"), F.lit(None).cast("string").alias("locked_by")
    )
    return fresh.unionAll(empty.limit(1)).limit(1)


def outdated_statistics(log: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """(table_name, last_update, is_outdated) of a log (table_name, update_time): an hour old or more."""
    last = log.groupBy("table_name").agg(F.max("update_time").alias("last_update"))
    return last.withColumn("is_outdated", F.timestamp_diff("MICROSECOND", F.col("last_update"), now) >= hours * 3_600_000_000)


def update_statistics(spark: SparkSession, tables: DataFrame) -> list[str]:
    """Analyze the tables of the session's catalogue that are outdated (table_name, is_outdated); their names."""
    names = [r[0] for r in tables.where("is_outdated").select("table_name").collect()]  # names of tables
    for name in names:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return names


def snapshot_objects(objects: DataFrame, uses: DataFrame, schemas: list[str], include_tables: bool = False) -> DataFrame:
    """The objects (id, kind, schema_name) of a snapshot: views and routines of some schemas, their tables if asked
    for, and the tables and views, of any schema, that those routines use, directly or not. uses: (view_id, master_id)."""
    own = objects.where(F.col("schema_name").isin(*schemas) & F.col("kind").isin("view", "routine", *(["table"] if include_tables else [])))
    used = closure(uses, own.where("kind = 'routine'").select(F.col("id").alias("root")))
    beside = objects.where("kind IN ('view', 'table')").join(used.select(F.col("node").alias("id")), "id", "left_semi")
    return own.unionByName(beside).dropDuplicates(["id"])


def report_year(today: dt.date) -> tuple[dt.date, dt.date]:
    """The year of the month before this one, end excluded."""
    first = today.replace(day=1) - dt.timedelta(days=1)
    return dt.date(first.year, 1, 1), dt.date(first.year + 1, 1, 1)


def snapshot(df: DataFrame, column: str | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """The rows of a range of dates, end excluded; all rows without a column."""
    if column is None:
        return df
    at = F.col(column)
    return df.where((at >= F.lit(start)) & (at < F.lit(end)))


def export_snapshot(tables: dict[str, tuple[DataFrame, str | None]], path: str, start: dt.date | None = None, end: dt.date | None = None) -> None:
    """Each table (with its date column, if it has one) as Parquet below a path."""
    for name, (df, column) in tables.items():
        snapshot(df, column if start else None, start, end).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
