"""Consecutive numbers over a whole table without a single-task sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.session import written


def numbered(df: DataFrame, *order: str | Column, name: str = "rn", start: int = 1) -> DataFrame:
    """df with numbers from start in the given order: rows are dealt out by ranges, numbered within each,
    and shifted by the sizes of the ranges before (one number a partition reaches the driver)."""
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    before = accumulate((n for _, n in sizes), initial=start - 1)
    shifts = [(p, s) for (p, _), s in zip(sizes, before, strict=False)]
    shift = F.broadcast(df.sparkSession.createDataFrame(shifts, "_part int, _shift long"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, inside).join(shift, "_part").withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_part", "_shift")
