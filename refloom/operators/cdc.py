"""What changed between two states of a table, the audit log of it, and the chunks that it makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a key's table in one task: what its joins sort at once then doesn't grow with the table.
TASK_ROWS = 200_000


def dealt(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """df dealt by its key for a table of so many rows, TASK_ROWS to a task. Joins and windows by the key that follow keep
    it; without it they have as many tasks for any number of rows. Tables of few tasks stay as they are."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *key) if n > df.sparkSession.sparkContext.defaultParallelism else df


def diff_snapshots(before: DataFrame, after: DataFrame, key: list[str], rows: int = 0) -> DataFrame:
    """(key, operation, old, new): I, U or D for every row that was added, changed or removed. rows: about how many
    the larger state has, so that its tasks don't grow with it."""
    rest = [c for c in before.columns if c not in key]
    # dealt as they are: a state that is dealt elsewhere too is then dealt once for both
    old = dealt(before, key, rows).select(*key, F.struct(*rest).alias("old"))
    new = dealt(after, key, rows).select(*key, F.struct(*rest).alias("new"))
    both = old.join(new, key, "full_outer")
    operation = F.when(F.col("old").isNull(), "I").when(F.col("new").isNull(), "D").when(~F.col("old").eqNullSafe(F.col("new")), "U")
    return both.withColumn("operation", operation).where(F.col("operation").isNotNull())


def images(changes: DataFrame, key: list[str], sides: tuple[str, ...] = ("old", "new")) -> DataFrame:
    """The old and new images of changes as rows (operation, key, attributes)."""
    each = changes.select("operation", *key, F.explode(F.array_compact(F.array(*sides))).alias("image"))
    return each.select("operation", *key, "image.*")


def audit_log(changes: DataFrame, logged: list[str], key: list[str], run_ts: Column, context: str) -> DataFrame:
    """Distinct (change_date, session_context, operation, logged attributes): new images of inserts and
    updates, old ones of deletions."""
    image = F.when(F.col("operation") == "D", F.col("old")).otherwise(F.col("new"))
    columns = [F.col(c) if c in key else image[c].alias(c) for c in logged]
    return changes.select("operation", *columns).distinct().select(
        run_ts.alias("change_date"), F.lit(context).alias("session_context"), "operation", *logged
    )


def invalidated_chunks(changes: DataFrame, sources: list[int], chunk: Column, key: list[str], run_ts: Column) -> DataFrame:
    """Distinct (source_id, chunk) of the old and new images from the given sources, with the time."""
    both = images(changes, key).where(F.col("source_id").isin(*sources))
    return both.select("source_id", chunk.alias("chunk")).distinct().withColumn("invalidation_time", run_ts)


def still_filled(registry: DataFrame, invalid: DataFrame, chunk: str = "chunk") -> DataFrame:
    """The registry of filled chunks without invalid ones."""
    return registry.join(invalid.select(chunk).distinct(), chunk, "left_anti")


def retained_log(log: DataFrame, today: Column, months: int = 1) -> DataFrame:
    """Log rows that aren't older than so many calendar months."""
    return log.where(F.col("change_date") >= F.add_months(today.cast("date"), -months))
