"""Merging staged packages into entities: plain, localised and temporal (versioned) ones.

Every function maps DataFrames to a DataFrame and takes the time of the run as an argument. All look-ups
of a merge read the same state of the target, the one before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.names import undefined_max_date, undefined_min_date
from refloom.operators.numbering import numbered
from refloom.session import written

LOADED, PROCESSED, DISCARDED = "loaded", "processed", "discarded"


class PackageError(RuntimeError):
    """A package can't be processed: changed by another, not in the loaded state, or not up to date."""


def last_of_package(package: DataFrame, *key: str, order: str = "data_package_rn") -> DataFrame:
    """Of rows with the same key the one with the highest number; rows without a key all stay."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    keyed = package.where(known).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return keyed.unionByName(package.where(~known))


def with_new_ids(package: DataFrame, high_water: int, id: str = "id", order: str = "data_package_rn") -> DataFrame:
    """Rows without an id get the numbers above high_water, in their order."""
    fresh = numbered(package.where(F.col(id).isNull()).drop(id), order, name=id, start=high_water + 1)
    return package.where(F.col(id).isNotNull()).unionByName(fresh)


def high_water(df: DataFrame, column: str) -> int:
    """The largest value so far, zero if there is none."""
    return df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def adjusted_sequence(last: int, df: DataFrame, column: str, least: int = 1, may_decrease: bool = True) -> int:
    """Where a sequence that stood at last goes on: at the largest value of a column, which is below it only
    if it may decrease; never below the sequence's minimum."""
    most = df.agg(F.max(column)).first()[0]
    if most is None or most < least or most < last and not may_decrease:
        return last
    return most


def upsert_plain(target: DataFrame, package: DataFrame, run_ts: Column, new_ids: bool = True, id: str = "id") -> DataFrame:
    """Staged rows replace those of the same id with all their attributes, nulls too; others are added.
    Of repeated ids in a package the last one counts."""
    staged = last_of_package(package, id)
    if new_ids:
        staged = with_new_ids(staged, high_water(target, id), id)
    fresh = staged.withColumn("record_date", run_ts).select(*target.columns)
    return target.join(staged.select(id), id, "left_anti").unionByName(fresh)


def delete_plain(target: DataFrame, package: DataFrame, id: str = "id") -> DataFrame:
    return target.join(package.select(id).distinct(), id, "left_anti")


def delete_details(details: DataFrame, target: DataFrame, package: DataFrame, id: str = "id", ref: str = "master_id") -> DataFrame:
    """What refers to deleted rows goes with them (translations, or cascading references)."""
    gone = package.select(id).join(target.select(id), id, "left_semi").distinct()
    return details.join(gone.withColumnRenamed(id, ref), ref, "left_anti")


# ---- translations

#: What names a translation. A versioned entity's has master_version as well.
TRANSLATION = ("master_id", "attr", "lang_id")


def unpivoted(package: DataFrame, attributes: list[str], key: list[str]) -> DataFrame:
    """(key, attr, lc_string): a row for each row and localisable attribute, nulls included."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("lc_string")) for a in attributes))
    return package.select(*key, F.inline(pairs))


def upsert_localised(lc: DataFrame, changes: DataFrame, key: tuple[str, ...] = TRANSLATION) -> DataFrame:
    """Translations after changes (key, lc_string): a null text deletes, any other replaces or adds. If lc has
    is_default_value, only default translations are touched, and those that come are default ones."""
    sent, fresh = changes.select(*key).distinct(), changes.where(F.col("lc_string").isNotNull())
    key = list(key)
    if "is_default_value" in lc.columns:
        sent, fresh = (x.withColumn("is_default_value", F.lit(True)) for x in (sent, fresh))
        key.append("is_default_value")
    return lc.join(sent, key, "left_anti").unionByName(fresh.select(*lc.columns))


def pivoted(lc: DataFrame, attributes: list[str], by: tuple[str, ...] = ("master_id", "lang_id")) -> DataFrame:
    """Translations as columns, one for each attribute."""
    return lc.groupBy(*by).agg(*(F.max(F.when(F.col("attr") == a, F.col("lc_string"))).alias(a) for a in attributes))


def delete_version_details(details: DataFrame, target: DataFrame, package: DataFrame) -> DataFrame:
    """Translations (master_id, master_version) without those of deleted versions that have an outer version;
    internal versions are only closed, so theirs stay."""
    outer = target.where(F.col("external_version").isNotNull() | F.col("meta_version").isNotNull()).select("id", "version")
    gone = outer.join(package.select("id", "version").distinct(), ["id", "version"], "left_semi")
    return details.join(gone.toDF("master_id", "master_version"), ["master_id", "master_version"], "left_anti")


# ---- versions


def check_actuality(target: DataFrame, package: DataFrame) -> None:
    """A package that sends a closed internal version is refused."""
    if not stale_rows(target, package).limit(1).isEmpty():
        raise PackageError("the package sends versions that aren't actual")


def stale_rows(target: DataFrame, package: DataFrame) -> DataFrame:
    """(id, version) of staged rows whose version in the target is closed and has no outer version."""
    closed = target.where(
        (F.col("valid_to") != undefined_max_date()) & F.col("external_version").isNull() & F.col("meta_version").isNull()
    )
    return package.select("id", "version").join(closed.select("id", "version"), ["id", "version"], "left_semi")


def close_internal(target: DataFrame, package: DataFrame, run_ts: Column) -> DataFrame:
    """Open versions without an outer version that the package sends again end now."""
    sent = package.select("id", "version").where("id IS NOT NULL AND version IS NOT NULL").distinct().withColumn("_sent", F.lit(True))
    inner = F.col("external_version").isNull() & F.col("meta_version").isNull()
    return (
        target.join(sent, ["id", "version"], "left")
        .withColumn("valid_to", F.when(F.col("_sent") & inner, run_ts).otherwise(F.col("valid_to")))
        .select(*target.columns)
    )


def with_version_order(package: DataFrame) -> DataFrame:
    """package with version_ordinal: the place of a row in its series, over the whole package. Rows of
    the internal lineage are series of their own (by id, else by row)."""
    own = F.when(
        F.col("external_id").isNull() & F.col("meta_id").isNull(),
        F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.concat(F.lit("r"), F.col("data_package_rn").cast("string"))),
    )
    series = Window.partitionBy("external_id", "meta_id", "source_id", "_own").orderBy(
        F.col("external_version_ordinal_num").asc_nulls_last(),
        F.col("meta_version_ordinal_num").asc_nulls_last(),
        F.col("valid_from").asc_nulls_last(),
        "data_package_rn",
    )
    return package.withColumn("_own", own).withColumn("version_ordinal", F.row_number().over(series)).drop("_own")


def _firsts(package: DataFrame, id: str, version: str) -> DataFrame:
    """(key, source_id, from, package) of each series that a package (with version_ordinal) continues."""
    first = package.where(
        (F.col("version_ordinal") == 1) & F.col(id).isNotNull() & F.col(version).isNotNull() & F.col("valid_from").isNotNull()
    )
    return first.groupBy(F.col(id).alias("_key"), "source_id").agg(
        F.min("valid_from").alias("_from"), F.max("data_package_id").alias("_package")
    )


def close_outer(target: DataFrame, package: DataFrame) -> DataFrame:
    """Of each series that the package continues, the target's row with the latest end among those that begin
    before the first staged one ends where that one begins. Series go by external_id, and by meta_id where
    neither side has an external id.

    What may end is summed by series before it is shuffled; rows of no series (a third of all rows may have
    neither id) are dealt out by their own key, not by the null that they share."""
    firsts = _firsts(package, "external_id", "external_version").withColumn("_outer", F.lit("e")).unionByName(
        _firsts(package.where("external_id IS NULL"), "meta_id", "meta_version").withColumn("_outer", F.lit("m"))
    )
    kind = F.when(F.col("external_id").isNotNull(), "e").when(F.col("meta_id").isNotNull(), "m").otherwise("")
    key = F.coalesce("external_id", "meta_id", F.concat_ws(":", "id", "version"))
    version = F.when(F.col("external_id").isNotNull(), F.col("external_version")).otherwise(F.col("meta_version"))
    keyed = target.withColumns({"_outer": kind, "_key": key})
    by = ["_outer", "_key", "source_id"]
    other = ~F.col("data_package_id").eqNullSafe(F.col("_package"))
    may = version.isNotNull() & (F.col("valid_from") < F.col("_from")) & other
    last = keyed.join(firsts, by).where(may).groupBy(*by).agg(
        F.max("valid_to").alias("_latest"), F.any_value("_from").alias("_from"), F.any_value("_package").alias("_package")
    )
    ends = may & (F.col("valid_to") == F.col("_latest"))
    found = keyed.join(last, by, "left")
    return found.withColumn("valid_to", F.when(ends, F.col("_from")).otherwise(F.col("valid_to"))).select(*target.columns)


def _latest(target: DataFrame, staged: DataFrame, id: str, ordinal: str) -> DataFrame:
    """(id, source_id, its row's id and end) of the outer series that are staged: the id is that of the row
    that begins last, the end that of the one with the highest ordinal number (rows without one before all
    others), of equals the one that begins last."""
    by = [id, "source_id"]
    begin = F.struct(F.col("valid_from"), F.col("version"))
    order = F.struct(F.col(ordinal).isNull(), F.col(ordinal), F.col("valid_from"), F.col("version"))
    rows = target.where(F.col(id).isNotNull()).join(staged.select(*by).distinct(), by, "left_semi")
    return rows.groupBy(*by).agg(F.max_by("id", begin).alias(f"_{id}_id"), F.max_by("valid_to", order).alias(f"_{id}_to"))


def new_versions(target: DataFrame, package: DataFrame, run_ts: Column) -> DataFrame:
    """The rows that a package (with version_ordinal) adds, in the columns of target.

    A series keeps the id that was staged, else that of its latest row in the target, else gets a new one.
    Staged versions stay for rows with an outer version; others get new numbers. The first row of a
    series begins where it says, else now if it came with an id, else where the latest row ends, else at
    the open start; successors begin where they say, else now."""
    outer_rows, inner = _latest(target, package, "external_id", "external_version_ordinal_num"), target.where("external_id IS NULL")
    found = package.join(outer_rows, ["external_id", "source_id"], "left")
    found = found.join(_latest(inner, package, "meta_id", "meta_version_ordinal_num"), ["meta_id", "source_id"], "left")
    known = F.coalesce("id", "_external_id_id", F.when(F.col("external_id").isNull(), F.col("_meta_id_id")))
    found = written(found.withColumn("_known", known), "staged")  # numbered, and joined with its numbers
    series = ["external_id", "meta_id", "source_id"]
    outer = F.col("external_id").isNotNull() | F.col("meta_id").isNotNull()
    firsts = found.where((F.col("version_ordinal") == 1) & F.col("_known").isNull())
    fresh = numbered(firsts.select(*series, "data_package_rn"), "data_package_rn", name="_fresh", start=high_water(target, "id") + 1)
    by_series = fresh.where(outer).select(*(F.col(c).alias(f"_s_{c}") for c in series), F.col("_fresh").alias("_new"))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in series))
    found = found.join(by_series, match, "left").drop(*(f"_s_{c}" for c in series))
    by_row = fresh.where(~outer).select("data_package_rn", F.col("_fresh").alias("_single"))
    found = found.join(by_row, "data_package_rn", "left")
    first = F.col("version_ordinal") == 1
    start = F.when(
        first,
        F.coalesce(
            "valid_from",
            F.when(F.col("id").isNotNull(), run_ts),
            "_external_id_to",
            F.when(F.col("external_id").isNull(), F.col("_meta_id_to")),
            undefined_min_date(),
        ),
    ).otherwise(F.coalesce("valid_from", run_ts))
    keeps = F.col("external_version").isNotNull() | F.col("meta_version").isNotNull()
    found = found.withColumns(
        {
            "_id": F.coalesce("_known", "_new", "_single"),
            "_from": start,
            "version": F.when(keeps, F.col("version")),
            "valid_to": F.coalesce("valid_to", undefined_max_date()),
            "record_date": run_ts,
        }
    )
    found = found.withColumns({"id": F.col("_id"), "valid_from": F.col("_from")})
    columns = list(dict.fromkeys([*target.columns, "data_package_rn"]))
    return with_new_ids(found.select(*columns), high_water(target, "version"), "version").select(*target.columns)


def merge_temporal(target: DataFrame, package: DataFrame, run_ts: Column, check: bool = True) -> DataFrame:
    """target after a package of versions: closed ones, replaced ones (same id and version) and new ones."""
    if check:
        check_actuality(target, package)
    ordered = written(with_version_order(package), "ordered")
    closed = close_outer(close_internal(target, package, run_ts), ordered)
    fresh = written(new_versions(target, ordered, run_ts), "versions")
    return closed.join(fresh.select("id", "version"), ["id", "version"], "left_anti").unionByName(fresh)


def delete_temporal(target: DataFrame, package: DataFrame, run_ts: Column) -> DataFrame:
    """Internal versions end now; rows with an outer version go."""
    sent = package.select("id", "version").distinct().withColumn("_sent", F.lit(True))
    near = target.join(sent, ["id", "version"], "left")
    outer = F.col("external_version").isNotNull() | F.col("meta_version").isNotNull()
    hit = F.coalesce("_sent", F.lit(False))
    return near.where(~(hit & outer)).withColumn("valid_to", F.when(hit, run_ts).otherwise(F.col("valid_to"))).select(*target.columns)


def as_of(target: DataFrame, at: Column) -> DataFrame:
    """The rows that are valid at a time, ends excluded."""
    return target.where((F.col("valid_from") <= at) & (at < F.col("valid_to")))
