"""What there is: objects of the session's catalogue, and the partitions of a stored table."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from refloom.session import hadoop_path

OBJECTS = "schema_name string, obj_name string, obj_class string, obj_general_type string, obj_specific_type string, obj_description string, is_temporary boolean"
#: What stands for a null partition value in a folder's name.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def objects(spark: SparkSession, schemas: list[str] | None = None, routines: bool = False) -> DataFrame:
    """Schemas, tables and views of the session's catalogue, and if asked for its functions; those of some schemas, or
    of all. Temporary views have an empty schema."""
    rows = []
    for s in spark.catalog.listDatabases():
        if schemas is not None and s.name not in schemas:
            continue
        rows.append((s.name, s.name, "schema", "schema", "schema", s.description, False))
        for t in spark.catalog.listTables(s.name):
            if not t.isTemporary:
                kind = "view" if t.tableType == "VIEW" else "table"
                rows.append((s.name, t.name, "relation", kind, t.tableType.lower(), t.description, False))
        for f in spark.catalog.listFunctions(s.name) if routines else ():
            rows.append((s.name, f.name, "routine", "routine", "function", f.description, f.isTemporary))
    rows += [("", t.name, "relation", "view", "temporary view", None, True) for t in spark.catalog.listTables() if t.isTemporary]
    return spark.createDataFrame(rows, OBJECTS)


def partitioned_tables(spark: SparkSession, schema: str) -> DataFrame:
    """(schema_name, table_name, partition_key) of the partitioned tables of a schema."""
    rows = []
    for t in spark.catalog.listTables(schema):
        if not t.isTemporary and t.tableType != "VIEW":
            keys = [c.name for c in spark.catalog.listColumns(f"`{schema}`.`{t.name}`") if c.isPartition]
            rows += [(schema, t.name, ", ".join(keys))] if keys else []
    return spark.createDataFrame(rows, "schema_name string, table_name string, partition_key string")


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(partition_key, partition_value) of the folders of a table partitioned by one column; a null value for rows
    without one."""
    fs, at = hadoop_path(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and "=" in x.getPath().getName()]
    pairs = [n.partition("=")[::2] for n in names]
    rows = [(k, None if v == NULL_PARTITION else unquote(v)) for k, v in pairs]
    return spark.createDataFrame(rows, "partition_key string, partition_value string")
