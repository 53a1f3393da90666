"""Graphs of types and views: levels, closures, what may be refreshed next.

A graph has one row for each dependency of a catalogue. Closures go step by step, each a join of what the
step before has reached with the edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.session import written

#: Characters of a name by which generated names of two partitioned views could clash.
NAME_GROUP = 28


def _recursive(df: DataFrame, text: str, **tables: DataFrame) -> DataFrame:
    return df.sparkSession.sql(text, **tables)


def closure(edges: DataFrame, roots: DataFrame, masters: bool = True, level_limit: int | None = None) -> DataFrame:
    """(root, node, level): everything that the roots depend on (negative levels) or that depends on them
    (positive), by the longest way that meets no node twice, and of level_limit steps at most. edges:
    (view_id, master_id); roots: (root).

    Without a cycle the longest way is the last step that reaches a node: each step joins the nodes reached
    by the one before, each once, with the edges, whatever the number of ways. Where steps don't end there
    is a cycle, and the ways themselves are followed, none over a node twice."""
    here, there, sign = ("view_id", "master_id", -1) if masters else ("master_id", "view_id", 1)
    if level_limit is not None:  # a cycle may lie beyond it
        return _ways(edges, roots, here, there, sign, level_limit)
    pairs = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).where("node != next").distinct()
    pairs = written(pairs.where("next IS NOT NULL"), "edges")
    most = pairs.select("node").distinct().count() + 1  # no way is longer
    steps = [written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("level")).distinct(), "step-0")]
    for i in range(1, most + 1):
        step = steps[-1].join(pairs, "node").select("root", F.col("next").alias("node")).distinct()
        step = written(step.withColumn("level", F.lit(i)), f"step-{i}")
        if step.where("root = node").limit(1).count() or i == most and step.limit(1).count():
            return _ways(edges, roots, here, there, sign, level_limit)
        steps.append(step)
        if not step.limit(1).count():
            break
    walked = reduce(DataFrame.unionByName, steps[1:], steps[0]).where("level > 0")
    return walked.groupBy("root", "node").agg((F.max("level") * sign).cast("int").alias("level"))


def _ways(edges: DataFrame, roots: DataFrame, here: str, there: str, sign: int, level_limit: int | None) -> DataFrame:
    limit = f"AND abs(w.level) < {int(level_limit)}" if level_limit is not None else ""
    walked = _recursive(
        edges,
        f"""WITH RECURSIVE w(root, node, level, path) AS (
            SELECT root, root, 0, array(root) FROM {{roots}}
            UNION ALL
            SELECT w.root, e.{there}, w.level + ({sign}), array_append(w.path, e.{there})
            FROM w JOIN {{edges}} e ON e.{here} = w.node
            WHERE NOT array_contains(w.path, e.{there}) {limit})
        SELECT root, node, level FROM w WHERE level != 0""",
        roots=roots,
        edges=edges,
    )
    pick = F.min("level") if sign < 0 else F.max("level")
    return walked.groupBy("root", "node").agg(pick.cast("int").alias("level"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the length of the longest way down from each node."""
    down = closure(edges, nodes.select(F.col("id").alias("root")))
    deepest = down.groupBy(F.col("root").alias("id")).agg((-F.min("level")).alias("level"))
    return nodes.select("id").join(deepest, "id", "left").select("id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def inherited_edges(edges: DataFrame) -> DataFrame:
    """(view_id, master_id, level): edges with those that follow from them, at the shortest distance: a pair
    counts at the first step that reaches it, so that cycles end by themselves. A node isn't its own master."""
    pairs = written(edges.select("view_id", "master_id").where("view_id != master_id").distinct(), "edges")
    step = known = written(pairs.withColumn("level", F.lit(1)), "step-1")
    ahead = pairs.toDF("master_id", "next")
    level = 1
    while step.limit(1).count():
        level += 1
        far = step.join(ahead, "master_id").select("view_id", F.col("next").alias("master_id")).where("view_id != master_id")
        fresh = far.distinct().join(known, ["view_id", "master_id"], "left_anti")
        step = written(fresh.withColumn("level", F.lit(level)), f"step-{level}")
        known = written(known.unionByName(step), "known")
    return known


def orderliness_edges(views: DataFrame, edges: DataFrame) -> DataFrame:
    """(view_id, master_id): an order among partitioned views of a schema whose names begin alike, but for
    pairs that depend on each other anyway."""
    many = views.where(
        "is_matview_emulation AND mv_emulation_with_partitioning AND mv_emulation_chunking_field IS NOT NULL"
        " AND NOT coalesce(is_disabled, false)"
    ).select("schema_name", F.left("internal_name", F.lit(NAME_GROUP)).alias("start"), "internal_name", F.col("id"))
    place = F.row_number().over(Window.partitionBy("schema_name", "start").orderBy("internal_name", "id"))
    seq = many.withColumn("place", place)
    pairs = seq.alias("a").join(
        seq.alias("b"),
        (F.col("a.schema_name") == F.col("b.schema_name")) & (F.col("a.start") == F.col("b.start")) & (F.col("b.place") > F.col("a.place")),
    )
    pairs = pairs.select(F.col("b.id").alias("view_id"), F.col("a.id").alias("master_id"))
    return pairs.subtract(edges.select("view_id", "master_id")).subtract(
        edges.select(F.col("master_id").alias("view_id"), F.col("view_id").alias("master_id"))
    )


def pending(views: DataFrame) -> DataFrame:
    """Materialized views that are neither valid nor disabled, with is_filled: refreshed since they changed."""
    filled = F.coalesce(F.col("refresh_time") >= F.col("modification_time"), F.lit(False))
    return views.where("is_materialized AND NOT is_valid AND NOT coalesce(is_disabled, false)").withColumn("is_filled", filled)


def frontier(views: DataFrame, edges: DataFrame, order_edges: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """(id, dependency_level) of pending views that can be refreshed now: no pending master, none that goes
    before by order, not in flight."""
    waiting = pending(views)
    ids = waiting.select("id")
    blocked = edges.join(ids.withColumnRenamed("id", "master_id"), "master_id", "left_semi").select(F.col("view_id").alias("id"))
    free = ids.subtract(blocked)
    behind = order_edges.join(free.withColumnRenamed("id", "master_id"), "master_id", "left_semi").select(F.col("view_id").alias("id"))
    found = free.subtract(behind)
    if in_flight is not None:
        found = found.subtract(in_flight.select("id"))
    return waiting.join(found, "id", "left_semi").select("id", "dependency_level")


def invalidated(views: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """views with is_valid taken from all that depend on changed (root) ones."""
    reach = closure(edges, changed, masters=False).select(F.col("node").alias("id"), F.lit(True).alias("_hit")).distinct()
    out = views.join(reach, "id", "left").withColumn("is_valid", F.col("is_valid") & F.col("_hit").isNull())
    return out.select(*views.columns)


def text_dependencies(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(id, master_id): objects whose name stands as a word in another one's source, comments and quoted
    strings left out. sources: (id, source); names: (master_id, name)."""
    plain = F.regexp_replace(F.regexp_replace("source", r"(?s)/\*.*?\*/|--[^\n]*", " "), "'[^']*'", " ")
    tokens = sources.select("id", F.explode(F.array_distinct(F.split(F.lower(plain), r"[^a-z0-9_.]+"))).alias("name"))
    found = tokens.join(names.withColumn("name", F.lower("name")), "name").where("id != master_id")
    return found.select("id", "master_id").distinct()
