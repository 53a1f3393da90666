"""The registries of types, views and schemas: flags that they show, and flags that a change takes away.

Registries are DataFrames; a change is a DataFrame of what changed, and the result the registry after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.operators.numbering import numbered
from refloom.plans.graph import closure, pending

#: Settings of a view whose change makes it not created.
DEFINITION = (
    "query", "is_matview_emulation", "mv_emulation_chunking_field", "mv_emulation_chunks_query",
    "mv_emulation_chunks_bucket_size", "mv_emulation_with_partitioning",
)


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _unset(registry: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """registry with a flag false for some ids (column id)."""
    hit = ids.select("id").where("id IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    found = registry.join(hit, "id", "left")
    return found.withColumn(flag, F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(flag))).select(*registry.columns)


# ---- what views and schemas show


def view_flags(views: DataFrame, objects: DataFrame, edges: DataFrame, chunk_edges: DataFrame) -> DataFrame:
    """What holds of every registered view, given the objects that there are.

    objects: (obj_schema, obj_name, obj_general_type, is_materialized, is_populated, unique_columns) of tables,
    views and routines; edges: (view_id, master_id, level); chunk_edges: (view_id, chunking_field)."""
    schemas = objects.select(F.col("obj_schema").alias("schema_name")).distinct().withColumn("is_schema_exists", F.lit(True))
    there = objects.select(
        F.col("obj_schema").alias("schema_name"),
        F.col("obj_name").alias("internal_name"),
        (F.col("obj_general_type") == "routine").alias("is_routine"),
        "obj_general_type",
        F.col("is_materialized").alias("_materialized"),
        F.col("is_populated").alias("_populated"),
        "unique_columns",
    )
    level = edges.groupBy(F.col("view_id").alias("id")).agg(F.max("level").alias("previously_defined_dependency_level"))
    fields = chunk_edges.select(F.col("view_id").alias("id"), F.col("chunking_field").alias("mv_emulation_chunking_field"))
    fields = fields.distinct().withColumn("_validated", F.lit(True))
    found = (
        views.join(schemas, "schema_name", "left")
        .join(there, ["schema_name", "internal_name", "is_routine"], "left")
        .join(level, "id", "left")
        .join(fields, ["id", "mv_emulation_chunking_field"], "left")
    )
    exists = F.col("obj_general_type").isNotNull()
    kind = F.when(F.col("is_routine"), "routine").when(F.col("is_matview_emulation"), "table").otherwise("view")
    emulated = F.col("is_matview_emulation") & exists & (F.col("refresh_time") >= F.col("modification_time"))
    populated = _or_false(emulated) | _or_false(F.col("_populated"))
    return found.select(
        "id",
        "internal_name",
        "schema_name",
        _or_false(F.col("is_schema_exists")).alias("is_schema_exists"),
        exists.alias("is_view_exists"),
        (_or_false(F.col("_materialized")) | F.col("is_matview_emulation")).alias("is_materialized"),
        _or_false(F.col("is_created") & exists & (F.col("obj_general_type") == kind)).alias("is_created"),
        (F.col("is_valid") & populated).alias("is_valid"),
        populated.alias("is_populated"),
        "unique_columns",
        F.col("unique_columns").isNotNull().alias("has_unique_index"),
        "previously_defined_dependency_level",
        F.coalesce("mv_emulation_chunks_bucket_size", F.lit(1)).alias("mv_emulation_chunks_bucket_size"),
        (F.col("is_matview_emulation") & _or_false(F.col("_validated"))).alias("is_mv_emulation_chunk_validated"),
        F.concat("internal_name", F.lit("_chunk")).alias("mv_emulation_filled_chunk_table_name"),
    )


def schema_flags(schemas: DataFrame, built_in: list[str], existing: DataFrame) -> DataFrame:
    """(id, internal_name, is_schema_exists, schema_description, target_schema_description, is_built,
    is_external, is_disabled) of registered schemas and the built-in ones. schemas: (id, internal_name, description,
    is_external, is_disabled); existing: (internal_name, description). A schema is built if it exists and
    its description isn't another one."""
    own = schemas.select("id", "internal_name", "is_external", "is_disabled")
    names = schemas.sparkSession.createDataFrame([(n,) for n in built_in], "internal_name string")
    fixed = names.join(schemas.select("id", "internal_name"), "internal_name", "left")
    fixed = fixed.select("id", "internal_name", F.lit(False).alias("is_external"), F.lit(False).alias("is_disabled"))
    every = own.union(fixed).distinct()
    wanted = schemas.select("internal_name", F.col("description").alias("schema_description"))
    there = existing.select("internal_name", F.lit(True).alias("_there"), F.col("description").alias("target_schema_description"))
    found = every.join(wanted, "internal_name", "left").join(there, "internal_name", "left")
    drifted = F.nullif("schema_description", F.col("target_schema_description")).isNotNull()
    exists = _or_false(F.col("_there"))
    return found.select(
        "id", "internal_name", exists.alias("is_schema_exists"), "schema_description", "target_schema_description",
        (exists & ~drifted).alias("is_built"), "is_external", "is_disabled",
    )


def view_id(views: DataFrame, name: str, schema: str) -> DataFrame:
    """(id) of the view of a name in a schema; no row if there is none."""
    return views.where((F.col("internal_name") == name) & (F.col("schema_name") == schema)).select("id")


def view_name(views: DataFrame) -> DataFrame:
    """(id, name) with the schema before the name."""
    return views.select("id", F.concat_ws(".", "schema_name", "internal_name").alias("name"))


def build_order(views: DataFrame) -> DataFrame:
    """Views that are neither created nor disabled, with what they are built in the order of: their creation order
    (external ones last), then their level, then their id: ``build_number``. Nulls come last."""
    order = F.when(~F.col("is_external"), F.col("creation_order"))
    waiting = views.where("NOT coalesce(is_created, false) AND NOT coalesce(is_disabled, false)")
    by = [order.asc_nulls_last(), F.col("previously_defined_dependency_level").asc_nulls_last(), F.col("id").asc()]
    return numbered(waiting, *by, name="build_number")


def without_view(views: DataFrame, edges: DataFrame, id: int) -> tuple[DataFrame, DataFrame]:
    """The registry and its dependencies after a view was deleted."""
    return views.where(F.col("id") != id), edges.where((F.col("view_id") != id) & (F.col("master_id") != id))


def to_refresh(views: DataFrame, unpopulated_only: bool = False, new_only: bool = False) -> DataFrame:
    """Pending views; only those that were never filled since they changed, or only new ones: never refreshed,
    and shown at the top level."""
    found = pending(views)
    if unpopulated_only:
        found = found.where("NOT is_filled")
    if new_only:
        found = found.where("refresh_time IS NULL AND coalesce(is_top_level, true)")
    return found


def all_to_refresh(views: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(views, filled chunks) before everything is refreshed: none valid, and no chunks of enabled views left.
    registry: (view_id, chunk)."""
    on = views.where("NOT coalesce(is_disabled, false)").select(F.col("id").alias("view_id"))
    return views.withColumn("is_valid", F.lit(False)), registry.join(on, "view_id", "left_anti")


# ---- what a change takes away


def changed_types(changes: dict[str, DataFrame], attributes: DataFrame, indexes: DataFrame) -> DataFrame:
    """(id) of the types that changed rows of the metadata belong to, by table: meta_type (id), meta_type_lc,
    meta_attribute, meta_index (master_id), meta_attribute_lc (master_id is an attribute's), meta_index_column
    (master_id is an index's), meta_type_invalidated_chunk (type_id). Unknown tables change nothing."""
    direct = {"meta_type": "id", "meta_type_lc": "master_id", "meta_attribute": "master_id", "meta_index": "master_id", "meta_type_invalidated_chunk": "type_id"}
    through = {"meta_attribute_lc": attributes, "meta_index_column": indexes}
    parts = [df.select(F.col(direct[t]).alias("id")) for t, df in changes.items() if t in direct]
    for t, owner in through.items():
        if t in changes:
            own = owner.select(F.col("id").alias("_owner"), F.col("master_id").alias("id"))
            parts.append(changes[t].join(own, F.col("master_id") == F.col("_owner")).select(own["id"]))
    none = attributes.select(F.col("master_id").alias("id")).limit(0)
    return reduce(DataFrame.union, parts, none).distinct()


def types_after(types: DataFrame, changed: DataFrame, descend: bool = True) -> DataFrame:
    """types with is_built false for changed concrete ones and, if they descend, for all that inherit from
    changed ones, abstract or not."""
    hit = changed.select("id")
    if descend:
        up = types.where("super_type_id IS NOT NULL").select(F.col("id").alias("view_id"), F.col("super_type_id").alias("master_id"))
        below = closure(up, changed.select(F.col("id").alias("root")), masters=False)
        hit = hit.union(below.select("node"))
    concrete = types.where("NOT coalesce(is_abstract, false)").select("id")
    return _unset(types, hit.join(concrete, "id", "left_semi"), "is_built")


def views_after_types(views: DataFrame, type_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """views with is_created false for those that depend on changed types themselves. type_edges: (view_id,
    master_type_id)."""
    hit = type_edges.join(changed.select(F.col("id").alias("master_type_id")), "master_type_id", "left_semi")
    return _unset(views, hit.select(F.col("view_id").alias("id")), "is_created")


def redefined(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id) of created views whose definition isn't the same any more; external routines don't count."""
    old = before.where("is_created AND NOT (is_routine AND is_external)").select("id", F.struct(*DEFINITION).alias("_old"))
    both = old.join(after.select("id", F.struct(*DEFINITION).alias("_new")), "id")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("id")


def views_after(views: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """views with is_created false for changed ones and for created ones of this database that depend on them
    directly."""
    near = edges.join(changed.select(F.col("id").alias("master_id")), "master_id", "left_semi").where("view_id != master_id")
    own = views.where("is_created AND NOT is_external").select("id")
    below = near.select(F.col("view_id").alias("id")).join(own, "id", "left_semi")
    return _unset(views, changed.select("id").union(below), "is_created")


def after_chunk_edges(views: DataFrame, types: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(views, types) after chunk dependencies (view_id, master_view_id, master_type_id) came, went or changed: both
    views are no longer created, the type is no longer built."""
    hit = changed.select(F.col("view_id").alias("id")).union(changed.select("master_view_id"))
    return _unset(views, hit, "is_created"), types_after(types, changed.select(F.col("master_type_id").alias("id")), descend=False)
