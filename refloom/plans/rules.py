"""Rules of change capture: what is to happen when the rows of a table change, merged by table and event.

A rule is a row; its body tells in words what cdc.py does for it. The plan compares the rules that should be
there with those that are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.names import MAX_NAME, abbreviate_name

EVENTS = [("insert", "new"), ("update", "new"), ("update", "old"), ("delete", "old")]
#: Bits that a stored rule's kind has for its events, beside one for rules by row.
BITS = {"insert": 4, "delete": 8, "update": 16}
BY_ROW = 1


def _events() -> Column:
    """(event, image) as rows: the images that the rows of an event have."""
    return F.inline(F.array(*(F.struct(F.lit(e).alias("event"), F.lit(i).alias("image")) for e, i in EVENTS)))


def log_rules(types: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rules for the logs of logged types: new images, of deletions old ones. types: (id, is_logged); attributes:
    (master_id, internal_name, ordinal_position, is_logged)."""
    logged = attributes.where("is_logged").groupBy(F.col("master_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("ordinal_position", F.lit(1 << 30)).alias("n"), "internal_name"))).alias("a")
    )
    names = F.array_join(F.transform("a", lambda x: x["internal_name"]), ", ")
    every = types.where("is_logged").select("id").join(logged, "id").select("id", "a", _events())
    every = every.where("image = 'new' OR event = 'delete'")
    body = F.concat(F.lit("log "), names, F.lit(" from "), "image")
    return every.select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("owner"), "event", body.alias("body"))


def chunk_rules(configured: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules that note chunks of configured sources as invalid. configured: (type_id, chunking_field, source_id,
    is_disabled); sources: (id, internal_name)."""
    named = configured.where("NOT is_disabled").join(sources.withColumnRenamed("id", "source_id"), "source_id")
    found = named.groupBy("type_id", "chunking_field").agg(F.array_sort(F.collect_set("internal_name")).alias("s"))
    every = found.select("*", _events())
    body = F.concat(F.lit("invalidate "), "chunking_field", F.lit(" of "), F.array_join("s", ", "), F.lit(" from "), "image")
    return every.select(F.concat(F.lit("t"), F.col("type_id").cast("string")).alias("owner"), "event", body.alias("body"))


def view_rules(edges: DataFrame, views: DataFrame) -> DataFrame:
    """Rules that forget chunks of dependent views. edges: (view_id, master_type_id, master_view_id); views: (id,
    schema_name, internal_name)."""
    named = edges.join(views.withColumnRenamed("id", "view_id"), "view_id")
    every = named.select("*", _events())
    owner = F.coalesce(
        F.concat(F.lit("t"), F.col("master_type_id").cast("string")), F.concat(F.lit("v"), F.col("master_view_id").cast("string"))
    )
    body = F.concat(F.lit("forget chunks of "), F.concat_ws(".", "schema_name", "internal_name"), F.lit(" from "), "image")
    return every.select(owner.alias("owner"), "event", body.alias("body"))


def merged_rules(rules: DataFrame, tables: DataFrame) -> DataFrame:
    """(schema_name, table_name, rule_name, event, body): the rules of a table and an event in one, in the order
    of their texts. tables: (owner, schema_name, table_name)."""
    base = F.lower(abbreviate_name(F.col("table_name"), True, MAX_NAME - len("trf__ainsert_s")))
    body = F.array_join(F.array_sort(F.collect_list("body")), "; ")
    found = rules.join(tables, "owner").groupBy("schema_name", "table_name", "event").agg(body.alias("body"))
    return found.select(
        "schema_name", "table_name", F.concat(F.lit("tr_"), base, F.lit("_a"), "event", F.lit("_s")).alias("rule_name"), "event", "body"
    )


def stored_rules(stored: DataFrame) -> DataFrame:
    """(schema_name, table_name, rule_name, event, by_row, body) of stored ones, a row for each event of their kind,
    a number of bits."""
    bits = F.create_map(*(F.lit(x) for pair in BITS.items() for x in pair))
    each = stored.select("*", F.explode(bits).alias("event", "_bit")).where(F.col("kind").bitwiseAND(F.col("_bit")) != 0)
    by_row = F.col("kind").bitwiseAND(BY_ROW) != 0
    return each.select("schema_name", "table_name", "rule_name", "event", by_row.alias("by_row"), "body")


def rule_plan(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(schema_name, table_name, rule_name, event, body, action): create what is missing, replace what says
    something else, keep the rest, drop what is no longer wanted. Rules by row stay as they are, unless
    they have a wanted one's name."""
    there = stored.select("schema_name", "table_name", "rule_name", F.col("event").alias("_event"), "by_row", F.col("body").alias("_body"))
    both = wanted.join(there, ["schema_name", "table_name", "rule_name"], "full_outer")
    action = (
        F.when(F.col("_event").isNull(), "create")
        .when(F.col("body").isNull(), F.when(F.col("by_row"), "keep").otherwise("drop"))
        .when(F.col("body").eqNullSafe(F.col("_body")) & ~F.col("by_row"), "keep")
        .otherwise("replace")
    )
    return both.select("schema_name", "table_name", "rule_name", F.coalesce("event", "_event").alias("event"), "body", action.alias("action"))
