"""Schemas that change: the difference of two, what to do about it, and the data in the new shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFF = "column_name string, old_type string, new_type string, old_position int, new_position int, action string"


def diff_schema(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """A row for each column of either side, with what is to be done: add, drop, alter or keep."""

    def listed(s: T.StructType, side: str) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(s, 1)]
        return spark.createDataFrame(rows, f"column_name string, {side}_type string, {side}_position int")

    both = listed(old, "old").join(listed(new, "new"), "column_name", "full_outer")
    action = (
        F.when(F.col("old_type").isNull(), "add")
        .when(F.col("new_type").isNull(), "drop")
        .when(F.col("old_type") != F.col("new_type"), "alter")
        .otherwise("keep")
    )
    return both.withColumn("action", action).select(*(x.split()[0] for x in DIFF.split(", ")))


@dataclass(frozen=True)
class Plan:
    rebuild: bool
    reasons: tuple[str, ...]


def plan_evolution(old: T.StructType, new: T.StructType, old_key: str | None = None, new_key: str | None = None, force: bool = False) -> Plan:
    """A table is built anew if its partitioning differs, if common columns stand in another order, or if
    that is forced; else columns are added, altered and dropped."""
    common_old = [f.name for f in old if f.name in new.names]
    common_new = [f.name for f in new if f.name in old.names]
    reasons = [
        *(["forced"] if force else []),
        *(["partitioning"] if old_key != new_key else []),
        *(["order"] if common_old != common_new else []),
    ]
    return Plan(bool(reasons), tuple(reasons))


def rebuild_reasons(diff: DataFrame, old_key: str | None, new_key: str | None, force: bool = False) -> DataFrame:
    """One row (is_rebuilt, reasons) from a difference of schemas: the reasons of plan_evolution, joined by commas, null
    if there is none."""

    def names(side: str):
        found = F.collect_list(F.when(F.col("action").isin("keep", "alter"), F.struct(f"{side}_position", "column_name")))
        return F.transform(F.array_sort(found), lambda x: x["column_name"])

    reasons = F.concat_ws(
        ", ",
        F.lit("forced" if force else None).cast("string"),
        F.lit("partitioning" if old_key != new_key else None).cast("string"),
        F.when(names("old") != names("new"), "order"),
    )
    return diff.agg(F.nullif(reasons, F.lit("")).alias("reasons")).select(F.col("reasons").isNotNull().alias("is_rebuilt"), "reasons")


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None, lose: bool = False) -> DataFrame:
    """df in a new schema: common columns are cast (what can't be cast at all is emptied if it may be
    lost, else refused; single values that don't fit fail as the session's ANSI mode says), new ones
    are null or have their default, and where nulls are no longer allowed defaults fill them."""
    defaults = defaults or {}
    out = []
    for f in schema:
        value = F.lit(None).cast(f.dataType)
        if f.name in df.columns:
            try:
                df.select(F.col(f.name).cast(f.dataType)).schema  # refused when it is analysed
                value = F.col(f.name).cast(f.dataType)
            except AnalysisException:
                if not lose:
                    raise
        if f.name in defaults and (not f.nullable or f.name not in df.columns):
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)


def nulls_in(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column_name, n) of the nulls where the schema allows none."""
    strict = [f.name for f in schema if not f.nullable]
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n")) for c in strict))
    return df.agg(pairs.alias("p")).select(F.inline("p")).where("n > 0")


def partition_plan(df: DataFrame, old_key: str | None, new_key: str | None) -> DataFrame:
    """(partition_value, is_old, is_new): the partitions of a table by its old and its new key; null keys go
    to the default partition (a null value), and a table without a key has just that one."""

    def parts(key: str | None, side: str) -> DataFrame:
        values = df.select(F.col(key).cast("string").alias("partition_value")) if key else df.limit(1).select(F.lit(None).cast("string").alias("partition_value"))
        return values.distinct().withColumn(side, F.lit(True))

    if old_key == new_key:
        return parts(old_key, "is_old").withColumn("is_new", F.lit(True))
    old, new = parts(old_key, "is_old").withColumn("is_new", F.lit(False)), parts(new_key, "is_new").withColumn("is_old", F.lit(False))
    return old.unionByName(new).select("partition_value", "is_old", "is_new")
