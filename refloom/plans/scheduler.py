"""Refreshing views in parallel: as soon as one is done, those that it was holding up may start."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.plans.graph import levels

MOST_WORKERS, MOST_SECONDS = 10, 8 * 3600.0


class ScheduleError(RuntimeError):
    """Views wait for each other, time ran out, or one failed."""


def waves(pending: DataFrame, edges: DataFrame) -> DataFrame:
    """(wave, id): pending views by the wave that they can be refreshed in, each after its pending masters. The views
    of one wave don't depend on each other."""
    ids = pending.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "master_id"), "master_id", "left_semi")
    found = levels(ids, inner.join(ids.withColumnRenamed("id", "view_id"), "view_id", "left_semi"))
    return found.select(F.col("level").alias("wave"), "id")


def refresh_all(
    masters: dict[Hashable, set[Hashable]],
    refresh: Callable[[Hashable], object],
    pending: Iterable[Hashable] | None = None,
    order: dict[Hashable, set[Hashable]] | None = None,
    spark: SparkSession | None = None,
    workers: int = MOST_WORKERS,
    seconds: float = MOST_SECONDS,
) -> list[Hashable]:
    """Refresh pending views (all, if not given), each after its pending masters and after those that go
    before it by order; the ids in the order in which they ended. At the first failure, or when time
    runs out, running Spark jobs are cancelled and the error is raised."""
    todo = set(masters if pending is None else pending)
    order = order or {}
    done: list[Hashable] = []
    flying: dict = {}
    group, until = f"refresh-{time.time_ns()}", time.monotonic() + seconds

    def work(v):
        if spark is not None:
            spark.sparkContext.setJobGroup(group, f"refresh {v}", True)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", str(v))
        return refresh(v)

    with ThreadPoolExecutor(workers) as pool:
        try:
            while todo or flying:
                # a view being refreshed is still pending for those that wait for it
                pending_now = todo | set(flying.values())
                free = {v for v in todo if not masters.get(v, set()) & pending_now - {v}}
                ready = sorted(v for v in free if not order.get(v, set()) & (free | set(flying.values())) - {v})
                for v in ready[: workers - len(flying)]:
                    todo.discard(v)
                    flying[pool.submit(work, v)] = v
                if not flying:
                    raise ScheduleError(f"nothing can be refreshed, but these wait: {sorted(todo)}")
                ended, _ = wait(flying, timeout=max(0.0, until - time.monotonic()), return_when=FIRST_COMPLETED)
                if not ended:
                    raise ScheduleError("timeout")
                for f in ended:
                    v = flying.pop(f)
                    f.result()
                    done.append(v)
        except BaseException:
            for f in flying:
                f.cancel()
            if spark is not None:
                spark.sparkContext.cancelJobGroup(group)
            raise
    return done
