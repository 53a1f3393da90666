"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.session import hadoop_path, scratch

#: Edges whose minima, a row for each node at most, are broadcast.
SENT_EDGES = 100_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge and the smallest node that it reaches.

    edges: columns u and v of one ordered type; loops and repeats may occur, an empty list
    gives no row. Each round links the neighbours of every node to the smallest of them, so
    the number of rounds grows with the logarithm of the longest path. A hub's edges are only
    joined with one row of its minimum, never with each other. Up to SENT_EDGES edges, counted in each
    round, the minima are broadcast; those of more are written first, so that the join deals the edges
    anew and those of a hub can be split. Rounds are written to the shared folder; what the one before
    the last needed is removed.
    """
    spark = edges.sparkSession
    current = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    past: list[list[str]] = []
    seen = None

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "star")
        df.write.parquet(path)
        past[-1].append(path)
        return spark.read.schema(df.schema).parquet(path)

    for _ in range(most_rounds):
        past.append([])
        current = kept(current)
        for path in past.pop(0) if len(past) > 2 else ():
            fs, at = hadoop_path(spark, path)
            fs.delete(at, True)
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select("v", "v").distinct()
            )
        seen = now
        if now[0] <= SENT_EDGES:
            current = _small_star(_large_star(current, F.broadcast), F.broadcast)
        else:
            current = _small_star(kept(_large_star(current, kept)), kept)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _large_star(edges: DataFrame, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = placed(both.groupBy("u").agg(F.min("v").alias("m")))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    least = placed(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()
