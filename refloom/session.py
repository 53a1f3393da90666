"""What every part needs from a Spark session: shared scratch space and shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Paths made by scratch() inside the innermost passing() of this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset on a single machine (tests) a
    temporary folder takes its place, and the session is told of it; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="refloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, not yet created."""
    path = f"{shared_dir(spark).rstrip('/')}/refloom-{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def passing(spark: SparkSession):
    """What this thread puts into the shared folder inside is removed at the end. Results that read it must
    have been written by then. Without it such tables stay until the folder is cleared."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        remove(spark, *made)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = hadoop_path(spark, path)
        fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which also cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session_context(spark: SparkSession, key: str, value: str | None = None) -> str | None:
    """What the session notes under a key; null if it isn't set. value: sets it first."""
    if value is not None:
        spark.conf.set(f"refloom.context.{key}", value)
    return spark.conf.get(f"refloom.context.{key}", None)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as Hadoop objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Rows of an Arrow batch where the session has Spark's default; long texts would make those batches large.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, wherever the driver imported it from, and keep the batches
    that Python workers get small. Where the session has Spark's default of rows in a batch, it has fewer
    from then on: plans are made lazily, so the setting must outlast this call."""
    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ARROW_ROWS)
    if getattr(sc, "_refloom_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="refloom-")) / "refloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, os.path.join("refloom", p.relative_to(PACKAGE)))
    sc.addPyFile(str(to))
    sc._refloom_shipped = True
