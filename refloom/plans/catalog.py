"""Entity types, declared once: inheritance, details, localisable and temporal attributes, indexes.

The catalogue itself is small; it is kept as rows, resolved by recursion in Spark SQL, and compiled to the
schemas of the tables of a type.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.plans.graph import closure, levels

PRIMITIVES = ("s", "n", "d", "b", "id")
TYPES = "id long, internal_name string, super_type_id long, master_type_id long, is_abstract boolean, is_temporal boolean, is_logged boolean"
ATTRIBUTES = (
    "id long, master_id long, internal_name string, attr_type_id long, length int, precision int, scale int,"
    " is_non_nullable boolean, is_unique boolean, is_localisable boolean, ordinal_position int, is_owned_by_temporal_type boolean"
)
INDEXES = "id long, master_id long, tag string, is_unique boolean, is_constraint_used boolean"
INDEX_COLUMNS = "master_id long, meta_attr_name string, ordinal_position int"


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    required: bool = False
    unique: bool = False
    localisable: bool = False
    temporal_only: bool = False
    logged: bool = False
    default: str | None = None
    #: Rows that refer to a deleted row go with it.
    cascade: bool = False


@dataclass
class EntityType:
    name: str
    attributes: list[Attribute] = field(default_factory=list)
    parent: str | None = None
    master: str | None = None
    abstract: bool = False
    temporal: bool = False
    logged: bool = False
    built: bool = False
    #: Rows may have others of their type above them.
    hierarchical: bool = False


#: Rows that every installation begins with; fixed values.
LANGUAGES = [(1, "ru", "RU"), (2, "en", "US")]
SOURCES = [(1, "manual data entry")]
DBMS_TYPES = [(1, "postgresql")]
EXPRESSIONS = [(1, "bool.true"), (2, "bool.false"), (3, "timestamp.current"), (4, "undefined_min_date"), (5, "undefined_max_date")]
PACKAGE_STATES = [(1, "loaded"), (2, "processed"), (3, "discarded")]
NAMES = [("source", "manual data entry", "ru", "Ручной ввод данных"), ("source", "manual data entry", "en", "Manual data entry")]


def seed_rows(spark: SparkSession) -> DataFrame:
    """(table_name, id, code, detail) of the rows that every installation begins with."""
    rows = [("language", i, tag, country) for i, tag, country in LANGUAGES]
    for name, values in (("source", SOURCES), ("dbms_type", DBMS_TYPES), ("meta_expr", EXPRESSIONS), ("data_package_state", PACKAGE_STATES)):
        rows += [(name, i, code, None) for i, code in values]
    return spark.createDataFrame(rows, "table_name string, id long, code string, detail string")


def seed_names(spark: SparkSession) -> DataFrame:
    """(table_name, code, lang, lc_string): translations of these rows."""
    return spark.createDataFrame(NAMES, "table_name string, code string, lang string, lc_string string")


def described_by_itself() -> list[EntityType]:
    """The types of the catalogue's own tables."""
    a = Attribute
    named = [a("internal_name", "s", 63, required=True, unique=True), a("name", "s", localisable=True, required=True)]
    return [
        EntityType("language", [a("tag", "s", 63, required=True, unique=True), a("name", "s", localisable=True), a("default_country", "s", 63)]),
        EntityType("meta_schema", [*named, a("is_external", "b", default="false"), a("is_disabled", "b", default="false")]),
        EntityType("meta_type_group", [*named, a("description", "s", localisable=True)], hierarchical=True),
        EntityType("meta_type", [*named, a("schema_id", "meta_schema"), a("group_id", "meta_type_group"), a("is_hierarchical", "b", default="false"), a("is_built", "b", default="false"), a("is_logged", "b", default="false")]),
        EntityType("dbms_type", [a("code", "s", 63, required=True, unique=True), a("name", "s", localisable=True, required=True)]),
        EntityType("meta_expr", [a("tag", "s", 63, required=True, unique=True)]),
        EntityType("meta_expr_body", [a("dbms_type_id", "dbms_type", required=True), a("body", "s", required=True)], master="meta_expr"),
        EntityType("meta_attribute", [*named, a("attr_type_id", "meta_type", required=True), a("default_value", "meta_expr"), a("fk_on_delete_cascade", "b", default="false"), a("is_logged", "b", default="false")], master="meta_type"),
        EntityType("meta_view", [a("internal_name", "s", 63, required=True), a("schema_id", "meta_schema"), a("query", "s"), a("is_routine", "b", default="false")]),
        EntityType("file_attachment", [a("attachment", "s")]),
        EntityType("data_package_attachment", [a("data_package_id", "id", required=True), a("attachment_id", "file_attachment", required=True)]),
    ]


def _builtin() -> list[EntityType]:
    a = Attribute
    entity = [
        a("data_package_id", "id"),
        a("data_package_rn", "id"),
        a("source_id", "source", required=True, logged=True),
        a("external_id", "s", 63),
        a("external_version", "s", 63, temporal_only=True),
        a("external_version_ordinal_num", "n", precision=5, scale=0, temporal_only=True),
        a("meta_id", "s", 63),
        a("meta_version", "s", 63, temporal_only=True),
        a("meta_version_ordinal_num", "n", precision=5, scale=0, temporal_only=True),
        a("source_record_date", "d", precision=6, default="current_timestamp"),
    ]
    directory = [
        a("code", "s", 63),
        a("name", "s", localisable=True, required=True),
        a("description", "s", localisable=True),
        a("golden_record_id", "directory"),
        a("is_deprecated", "b", default="false"),
    ]
    return [
        EntityType("source", [a("code", "s", 63)]),
        EntityType("entity", entity, abstract=True),
        EntityType("directory", directory, parent="entity", abstract=True),
    ]


class Catalog:
    """Types by name. A change marks its type and what inherits from it as not built."""

    def __init__(self, types: Iterable[EntityType] = ()):
        self.types = {t.name: t for t in [*_builtin(), *types]}

    def add(self, type: EntityType) -> None:
        self.types[type.name] = type
        self.touch(type.name)

    def remove(self, name: str, missing_ok: bool = False, cascade: bool = False) -> None:
        if name not in self.types:
            if missing_ok:
                return
            raise KeyError(name)
        below = [t.name for t in self.types.values() if name in (t.parent, t.master)]
        if below and not cascade:
            raise ValueError(f"{name} is referred to by {', '.join(below)}")
        for x in below:
            self.remove(x, True, True)
        del self.types[name]

    def touch(self, name: str) -> list[str]:
        """Mark a type and its descendants as not built; their names."""
        out, todo = [], [name]
        while todo:
            t = self.types[todo.pop()]
            t.built = False
            out.append(t.name)
            todo += [x.name for x in self.types.values() if x.parent == t.name and x.name not in out]
        return out

    def lineage(self, name: str) -> list[EntityType]:
        """The type, its parent, and so on."""
        out = []
        while name is not None:
            t = self.types[name]
            if t in out:
                raise ValueError(f"{name} inherits from itself")
            out.append(t)
            name = t.parent
        return out

    def attributes(self, name: str) -> list[Attribute]:
        """Inherited ones last but for the detail's reference, which comes first. An inherited attribute of
        its declaring type refers to the type that inherits it."""
        own = self.types[name]
        out = [Attribute("master_id", own.master, required=own.master != name)] if own.master else []
        for t in self.lineage(name):
            for x in t.attributes:
                if t is not own and x.temporal_only and not own.temporal:
                    continue
                out.append(Attribute(**{**x.__dict__, "type": name}) if x.type == t.name and t is not own else x)
        return out

    def has_attribute(self, name: str, attribute: str) -> bool:
        return attribute in (a.name for a in self.attributes(name))

    def has_localisation(self, name: str) -> bool:
        return any(a.localisable for a in self.attributes(name))

    def level(self, name: str, seen: tuple[str, ...] = ()) -> int:
        """The longest way over own attributes' types and masters; cycles end it."""
        t = self.types[name]
        below = {a.type for a in t.attributes if a.type not in PRIMITIVES} | ({t.master} if t.master else set())
        return max((1 + self.level(x, (*seen, name)) for x in below if x not in (*seen, name)), default=0)

    def build_order(self) -> list[str]:
        """Concrete types that aren't built, by level, then name."""
        return sorted((t.name for t in self.types.values() if not t.abstract and not t.built), key=lambda n: (self.level(n), n))

    def schema(self, name: str, role: str = "target") -> T.StructType:
        """The schema of a type's table: target, staging, lc (translations), log or invalidated_chunk."""
        own = self.types[name]
        versions = [("version", T.LongType()), ("valid_from", T.TimestampNTZType()), ("valid_to", T.TimestampNTZType())]
        fields = []
        if role == "lc":
            master = [("master_id", T.LongType()), *([("master_version", T.LongType())] if own.temporal else [])]
            rest = [("attr", T.StringType()), ("lang_id", T.StringType()), ("lc_string", T.StringType()), ("is_default_value", T.BooleanType())]
            return T.StructType([T.StructField(n, t, False) for n, t in [*master, *rest]])
        if role == "log":
            head = [("change_date", T.TimestampNTZType()), ("session_context", T.StringType()), ("operation", T.StringType())]
            fields = [T.StructField(n, t, False) for n, t in head]
            return T.StructType(fields + [self._field(a, False) for a in self.attributes(name) if a.logged or own.logged and not a.localisable])
        if role == "invalidated_chunk":
            return T.StructType().add("source_id", T.LongType()).add("invalidation_time", T.TimestampNTZType()).add("chunk", T.StringType())
        target = role == "target"
        fields.append(T.StructField("id", T.LongType(), not target))
        if target:
            fields.append(T.StructField("record_date", T.TimestampNTZType(), False))
        if own.temporal:
            fields += [T.StructField(n, t, not target) for n, t in versions]
        for a in self.attributes(name):
            if a.localisable and target:
                continue
            fields.append(self._field(a, target))
            if a.type not in PRIMITIVES and self.types[a.type].temporal:
                fields.append(T.StructField(f"{a.name.removesuffix('_id')}_version", T.LongType()))
        return T.StructType(fields)

    def _field(self, a: Attribute, strict: bool) -> T.StructField:
        kinds = {
            "s": lambda: T.StringType(),
            "n": lambda: T.DecimalType(a.precision, a.scale or 0) if a.precision else T.DecimalType(38, 18),
            "d": lambda: T.TimestampNTZType() if a.precision else T.DateType(),
            "b": lambda: T.BooleanType(),
        }
        notes = {k: v for k, v in (("max_length", a.length), ("unique", a.unique or None), ("refers_to", None if a.type in PRIMITIVES else a.type)) if v}
        return T.StructField(a.name, kinds.get(a.type, T.LongType)(), not (strict and a.required), notes)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(types, attributes) as rows, ids by place."""
        ids = {p: i for i, p in enumerate(PRIMITIVES, 1)} | {n: 100 + i for i, n in enumerate(self.types)}
        types = [(ids[t.name], t.name, ids.get(t.parent), ids.get(t.master), t.abstract, t.temporal, t.logged) for t in self.types.values()]
        rows = [
            (ids[t.name] * 1000 + i, ids[t.name], a.name, ids[a.type], a.length, a.precision, a.scale, a.required, a.unique, a.localisable, i, a.temporal_only)
            for t in self.types.values()
            for i, a in enumerate(t.attributes, 1)
        ]
        return spark.createDataFrame(types, TYPES), spark.createDataFrame(rows, ATTRIBUTES)


def resolve_attributes(types: DataFrame, attributes: DataFrame) -> DataFrame:
    """(type_id, attr_id, internal_name, attr_type_id, ordinal_position, is_inherited) of every type: own
    attributes, the reference to a master (attr_id 0), and inherited ones."""
    return types.sparkSession.sql(
        """WITH RECURSIVE up(type_id, ancestor_id, is_temporal, depth) AS (
            SELECT id, id, coalesce(is_temporal, false), 0 FROM {types}
            UNION ALL
            SELECT up.type_id, t.super_type_id, up.is_temporal, depth + 1
            FROM up JOIN {types} t ON t.id = up.ancestor_id WHERE t.super_type_id IS NOT NULL)
        SELECT up.type_id, a.id AS attr_id, a.internal_name,
               CASE WHEN depth > 0 AND a.attr_type_id = a.master_id THEN up.type_id ELSE a.attr_type_id END AS attr_type_id,
               a.ordinal_position, depth > 0 AS is_inherited
        FROM up JOIN {attributes} a ON a.master_id = up.ancestor_id
        WHERE depth = 0 OR up.is_temporal OR NOT coalesce(a.is_owned_by_temporal_type, false)
        UNION ALL
        SELECT id, 0, 'master_id', master_type_id, 0, false FROM {types} WHERE master_type_id IS NOT NULL""",
        types=types,
        attributes=attributes,
    )


def having_attribute(types: DataFrame, attributes: DataFrame, name: str) -> DataFrame:
    """(type_id, has_attribute, has_localisation) of every type, inherited attributes and a master's reference
    counted."""
    local = attributes.select(F.col("id").alias("attr_id"), "is_localisable")
    resolved = resolve_attributes(types, attributes).join(local, "attr_id", "left")
    found = resolved.groupBy("type_id").agg(
        F.bool_or(F.col("internal_name") == name).alias("a"), F.bool_or(F.coalesce("is_localisable", F.lit(False))).alias("b")
    )
    every = types.select(F.col("id").alias("type_id")).join(found, "type_id", "left")
    return every.select("type_id", *(F.coalesce(c, F.lit(False)).alias(n) for c, n in (("a", "has_attribute"), ("b", "has_localisation"))))


def table_columns(catalog: Catalog, spark: SparkSession, roles: tuple[str, ...] = ("target", "staging", "lc", "log", "invalidated_chunk")) -> DataFrame:
    """(type_name, role, column_name, column_type, is_nullable, ordinal_position) of the tables of all concrete
    types; logs only of logged ones, translations only where something can be translated."""
    rows = []
    for t in catalog.types.values():
        for role in roles:
            if t.abstract or role == "log" and not t.logged or role == "lc" and not catalog.has_localisation(t.name):
                continue
            rows += [(t.name, role, f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(catalog.schema(t.name, role), 1)]
    return spark.createDataFrame(rows, "type_name string, role string, column_name string, column_type string, is_nullable boolean, ordinal_position int")


def type_flags(types: DataFrame, attributes: DataFrame, existing: DataFrame) -> DataFrame:
    """What holds of every concrete type: its level, and which of its tables there should be and are. existing:
    (table_name); a type's tables are named after it, with _lc, _log and _staging."""
    edges = attributes.where(F.col("attr_type_id").isNotNull()).select(F.col("master_id").alias("view_id"), F.col("attr_type_id").alias("master_id"))
    edges = edges.join(types.select(F.col("id").alias("master_id")), "master_id", "left_semi").select("view_id", "master_id")
    edges = edges.union(types.where("master_type_id IS NOT NULL").select("id", "master_type_id"))
    local = having_attribute(types, attributes, "").select(F.col("type_id").alias("id"), F.col("has_localisation").alias("is_localization_table_generated"))
    found = types.where("NOT coalesce(is_abstract, false)").join(levels(types, edges), "id").join(local, "id")
    there = existing.select("table_name").distinct().withColumn("_there", F.lit(True))
    for suffix, flag in (("", "is_table_exists"), ("_staging", "is_staging_table_exists"), ("_lc", "is_localization_table_exists"), ("_log", "is_log_table_exists")):
        own = there.select(F.col("table_name").alias("_name"), F.col("_there").alias(flag))
        found = found.join(own, F.concat("internal_name", F.lit(suffix)) == F.col("_name"), "left").drop("_name")
        found = found.withColumn(flag, F.coalesce(flag, F.lit(False)))
    built = (
        F.col("is_table_exists")
        & F.col("is_staging_table_exists")
        & (F.col("is_localization_table_exists") == F.col("is_localization_table_generated"))
        & (F.col("is_log_table_exists") == F.coalesce("is_logged", F.lit(False)))
    )
    return found.select(
        "id", "internal_name", F.col("level").alias("dependency_level"), "is_table_exists", "is_staging_table_exists",
        "is_localization_table_generated", "is_localization_table_exists", "is_log_table_exists", built.alias("is_built"),
    )


def column_plan(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name, wanted_type, actual_type, action) of columns (table_name, column_name, column_type,
    is_nullable) that should be and are there: add, drop, alter (another type), tighten or loosen (nulls), keep."""
    key = ["table_name", "column_name"]
    both = wanted.select(*key, F.col("column_type").alias("wanted_type"), F.col("is_nullable").alias("_n")).join(
        actual.select(*key, F.col("column_type").alias("actual_type"), F.col("is_nullable").alias("_m")), key, "full_outer"
    )
    action = (
        F.when(F.col("actual_type").isNull(), "add")
        .when(F.col("wanted_type").isNull(), "drop")
        .when(F.col("wanted_type") != F.col("actual_type"), "alter")
        .when(~F.col("_n") & F.col("_m"), "tighten")
        .when(F.col("_n") & ~F.col("_m"), "loosen")
        .otherwise("keep")
    )
    return both.select(*key, "wanted_type", "actual_type", action.alias("action"))


def index_plan(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, index_name, index_columns, action) of indexes (table_name, index_name, index_columns, is_unique): create
    what is missing, rebuild what has other columns or another uniqueness, drop orphans, keep the rest."""
    key = ["table_name", "index_name"]
    there = actual.select(*key, F.col("index_columns").alias("_columns"), F.col("is_unique").alias("_unique"))
    both = wanted.join(there, key, "full_outer")
    same = F.col("index_columns").eqNullSafe(F.col("_columns")) & F.col("is_unique").eqNullSafe(F.col("_unique"))
    action = F.when(F.col("_columns").isNull(), "create").when(F.col("index_columns").isNull(), "drop").when(same, "keep").otherwise("rebuild")
    return both.select(*key, "index_columns", action.alias("action"))


def without_type(types: DataFrame, gone: DataFrame) -> DataFrame:
    """types without some (id) and all that inherit from them or are their details."""
    up = types.select(F.col("id").alias("view_id"), F.explode(F.array("super_type_id", "master_type_id")).alias("master_id"))
    below = closure(up.where("master_id IS NOT NULL"), gone.select(F.col("id").alias("root")), masters=False)
    return types.join(gone.select("id").union(below.select("node")).distinct(), "id", "left_anti")


def resolve_types(types: DataFrame, attributes: DataFrame) -> DataFrame:
    """(type_id, internal_name, is_temporal, non_localisable, localisable): concrete types with the names of
    their attributes, joined in order; null where there is none."""
    resolved = resolve_attributes(types, attributes).join(attributes.select(F.col("id").alias("attr_id"), "is_localisable"), "attr_id", "left")
    local = F.coalesce("is_localisable", F.lit(False))

    def names(which) -> F.Column:
        found = F.collect_list(F.when(which, F.struct("is_inherited", "ordinal_position", "internal_name")))
        return F.nullif(F.array_join(F.transform(F.array_sort(found), lambda x: x["internal_name"]), ", "), F.lit(""))

    lists = resolved.groupBy("type_id").agg(names(~local).alias("non_localisable"), names(local).alias("localisable"))
    concrete = types.where("NOT coalesce(is_abstract, false)").select(F.col("id").alias("type_id"), "internal_name", F.coalesce("is_temporal", F.lit(False)).alias("is_temporal"))
    return concrete.join(lists, "type_id", "left")


def resolve_indexes(types: DataFrame, attributes: DataFrame, indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """(type_id, index_name, index_columns, is_unique) of concrete types, inherited indexes too. Temporal
    types add valid_to; others leave out what only versions have, and indexes without any column left."""
    spark = types.sparkSession
    owned = attributes.select(F.col("master_id").alias("_t"), F.col("internal_name").alias("meta_attr_name"), "is_owned_by_temporal_type")
    named = (
        columns.join(indexes.select(F.col("id").alias("master_id"), F.col("master_id").alias("_t")), "master_id")
        .join(owned, ["_t", "meta_attr_name"], "left")
        .select(F.col("master_id").alias("index_id"), "meta_attr_name", "ordinal_position", "is_owned_by_temporal_type")
    )
    return spark.sql(
        """WITH RECURSIVE up(type_id, ancestor_id) AS (
            SELECT id, id FROM {types} WHERE NOT coalesce(is_abstract, false)
            UNION ALL
            SELECT up.type_id, t.super_type_id FROM up JOIN {types} t ON t.id = up.ancestor_id WHERE t.super_type_id IS NOT NULL)
        SELECT up.type_id, concat(t.internal_name, '_', i.tag) AS index_name,
               concat(listagg(c.meta_attr_name, ', ') WITHIN GROUP (ORDER BY c.ordinal_position),
                      CASE WHEN t.is_temporal THEN ', valid_to' ELSE '' END) AS index_columns,
               i.is_unique
        FROM up JOIN {indexes} i ON i.master_id = up.ancestor_id
        JOIN {types} t ON t.id = up.type_id
        JOIN {named} c ON c.index_id = i.id
        WHERE t.is_temporal OR c.meta_attr_name = 'master_id'
           OR (NOT c.is_owned_by_temporal_type AND c.meta_attr_name NOT IN ('version', 'valid_from', 'valid_to'))
        GROUP BY up.type_id, t.internal_name, t.is_temporal, i.id, i.tag, i.is_unique""",
        types=types,
        indexes=indexes,
        named=named,
    )


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of the keys that a unique index would refuse; keys with a null are never equal."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def too_long(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column_name, n) of the texts longer than their column allows."""
    bound = [(f.name, f.metadata["max_length"]) for f in schema if "max_length" in f.metadata and f.name in df.columns]
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(F.length(c) > n).alias("n")) for c, n in bound))
    return df.agg(pairs.alias("p")).select(F.inline("p")).where("n > 0")
