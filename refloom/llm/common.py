"""Shared by the corpus operators: tables, row keys, word rules and size-checked joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() also has it: space and 09 to 0D.
SPACES = " \t\n\x0b\f\r"
#: A side of a join is broadcast only up to so many rows, and bytes of texts in them (about 50 MB when hashed).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """128 bits of the columns' values, nulls told from empty texts: equal rows share them. With 2e10 rows,
    two others do so with a probability of 6e-19."""
    values = (F.col(c).cast("string") for c in columns)
    told = (F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)
    return F.unhex(F.md5(F.concat(*told)))


def with_row_key(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with ``_rk``, the row key of some columns."""
    return docs.withColumn("_rk", row_key(*columns))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def sized(side: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """side with a broadcast hint if it is a written table of at most so many rows and bytes of texts; else
    as it is, and the join shuffles."""
    texts = (F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in side.dtypes if kind in ("string", "binary"))
    total = reduce(lambda a, b: a + b, texts, F.lit(0))
    n, found = side.limit(rows + 1).agg(F.count("*"), F.sum(total)).first()
    return F.broadcast(side) if n <= rows and (found or 0) <= size else side


def without(docs: DataFrame, losers: DataFrame, *columns: str, once: bool = False) -> DataFrame:
    """docs without the rows whose key, of the given columns, is in losers (a written table with ``_rk``);
    once: of rows with the same key one stays. Whatever columns docs has are passed through as a whole, so
    none of their names clashes with the key's."""
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), row_key(*columns).alias("_rk"))
    kept = packed.join(sized(losers.select("_rk")), "_rk", "left_anti")
    return (kept.dropDuplicates(["_rk"]) if once else kept).select("row.*")


def least_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each span of consecutive hashes the place of the smallest one, the rightmost of equals. Spans
    double in length, so there are as many passes as the length has bits."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(hashes)), 1
    while size < span:
        step = min(size, span - size)  # the last two spans overlap
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        size += step
    return at


def parts(batches, rows: int = 256):
    """Arrow batches in smaller ones, so that what a task derives from a batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
