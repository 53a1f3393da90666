"""Data packages: registered, staged, and merged into their entity once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.operators import cdc, merge
from refloom.operators.merge import DISCARDED, LOADED, PROCESSED, PackageError
from refloom.plans.catalog import Catalog
from refloom.sources.store import Store

HEADER = "id long, type string, source string, lang string, is_deletion boolean, state string, create_date timestamp_ntz, state_change_date timestamp_ntz"
HEADERS, STATISTICS = "data_package", "table_stat_explicit_update_log"
UPDATES = "table_name string, update_time timestamp_ntz, data_package_id long"
MANUAL, DEFAULT_LANGUAGE = "manual data entry", "en"


@dataclass
class Package:
    id: int
    type: str
    source: str
    lang: str
    is_deletion: bool
    state: str
    create_date: dt.datetime
    state_change_date: dt.datetime


def state_counts(headers: DataFrame) -> DataFrame:
    """(type, state, n, last_change) of packages."""
    return headers.groupBy("type", "state").agg(F.count("*").alias("n"), F.max("state_change_date").alias("last_change"))


class Engine:
    """Entities, staged packages and logs in a store. One header reaches the driver at a time; data never does.
    What a package changes (entity, translations, logs, its own state) is one commit of the store, so a
    package that was interrupted can be processed again."""

    def __init__(self, spark: SparkSession, store: Store, catalog: Catalog, languages: dict[str, str] | None = None):
        self.spark, self.store, self.catalog = spark, store, catalog
        #: Language of each source.
        self.languages = languages or {}
        #: What to call after a package of an entity, with its id.
        self.after: dict[str, Callable[[int], None]] = {}
        #: Called with an entity's name before its data change.
        self.on_change: list[Callable[[str], None]] = []

    # ---- headers

    def headers(self) -> DataFrame:
        return self.store.read(HEADERS) if self.store.exists(HEADERS) else self.spark.createDataFrame([], HEADER)

    def package(self, id: int) -> Package:
        found = self.headers().where(F.col("id") == id).first()
        if found is None:
            raise KeyError(id)
        return Package(**found.asDict())

    def _with(self, p: Package) -> dict:
        """The entry of the headers with one of them new or changed."""
        now = self.spark.createDataFrame([tuple(asdict(p).values())], HEADER)
        return self.store.written(HEADERS, self.headers().where(F.col("id") != p.id).unionByName(now).coalesce(1))

    def default_language(self) -> str:
        """That of the source of manual entries, else English."""
        return self.languages.get(MANUAL, DEFAULT_LANGUAGE)

    def register(self, type: str, source: str, run_ts: dt.datetime, lang: str | None = None, is_deletion: bool = False) -> Package:
        """A new package in the loaded state. The language is the one given, else its source's, else the default."""
        if type not in self.catalog.types:
            raise KeyError(type)
        version = self.store.manifest(HEADERS)["version"]
        found = lang or self.languages.get(source) or self.default_language()
        new = Package(merge.high_water(self.headers(), "id") + 1, type, source, found, is_deletion, LOADED, run_ts, run_ts)
        self.store.commit({HEADERS: self._with(new)}, {HEADERS: version})
        return new

    def stage(self, package: Package, rows: DataFrame) -> None:
        """Rows of a package, in the columns of its staging table; missing ones are null."""
        wanted = self.catalog.schema(package.type, "staging")
        own = rows.withColumn("data_package_id", F.lit(package.id).cast("long"))
        columns = [(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        self.store.write(f"staging_{package.id}", own.select(*columns))

    # ---- processing

    def process(self, id: int, run_ts: dt.datetime, check_date: dt.datetime | None = None) -> dt.datetime:
        """Merge a loaded package into its entity; the new check date. A check date that isn't the package's
        state change, or a state that isn't loaded, is refused. A package without rows is only marked."""
        version = self.store.manifest(HEADERS)["version"]
        p = self.package(id)
        if check_date is not None and check_date != p.state_change_date:
            raise PackageError(f"package {id} was changed by another")
        if p.state != LOADED:
            raise PackageError(f"package {id} is {p.state}")
        rows = self.store.read(f"staging_{id}") if self.store.exists(f"staging_{id}") else None
        full = rows is not None and not rows.limit(1).isEmpty()
        changes, expected = {}, {HEADERS: version}
        if full:
            for call in self.on_change:
                call(p.type)
            expected |= {t: self.store.manifest(t)["version"] for t in (p.type, f"{p.type}_lc", f"{p.type}_log", STATISTICS)}
            changes = self._merged(p, rows, run_ts)
        p.state, p.state_change_date = PROCESSED, run_ts
        self.store.commit(changes | {HEADERS: self._with(p)}, expected)
        if full and p.type in self.after:
            self.after[p.type](id)
        return run_ts

    def _current(self, table: str, schema) -> DataFrame:
        return self.store.read(table) if self.store.exists(table) else self.spark.createDataFrame([], schema)

    def _merged(self, p: Package, rows: DataFrame, run_ts: dt.datetime) -> dict[str, dict]:
        """Entries of the tables that a package changes."""
        own, now = self.catalog.types[p.type], F.lit(run_ts).cast("timestamp_ntz")
        target = self._current(p.type, self.catalog.schema(p.type))
        if own.temporal:
            after = merge.delete_temporal(target, rows, now) if p.is_deletion else merge.merge_temporal(target, rows, now)
        else:
            after = merge.delete_plain(target, rows) if p.is_deletion else merge.upsert_plain(target, rows, now)
        out = {p.type: self.store.written(p.type, after)}
        after = self.store.state(p.type, out[p.type]["folder"])
        out |= self._translated(p, rows, target, after)
        if own.logged:
            key = ["id", "version"] if own.temporal else ["id"]
            logged = [f.name for f in self.catalog.schema(p.type, "log")][3:]
            log = cdc.audit_log(cdc.diff_snapshots(target, after, key, max(target.count(), after.count())), logged, key, now, f"package {p.id}")
            out[f"{p.type}_log"] = self.store.written(f"{p.type}_log", self._current(f"{p.type}_log", log.schema).unionByName(log))
        told = self.spark.createDataFrame([(t, run_ts, p.id) for t in out if not t.endswith("_log")], UPDATES)
        out[STATISTICS] = self.store.written(STATISTICS, self._current(STATISTICS, UPDATES).unionByName(told).coalesce(1))
        return out

    def _translated(self, p: Package, rows: DataFrame, before: DataFrame, after: DataFrame) -> dict[str, dict]:
        local = [a.name for a in self.catalog.attributes(p.type) if a.localisable]
        if not local:
            return {}
        table, temporal = f"{p.type}_lc", self.catalog.types[p.type].temporal
        lc = self._current(table, self.catalog.schema(p.type, "lc"))
        if p.is_deletion:
            found = merge.delete_version_details(lc, before, rows) if temporal else merge.delete_details(lc, before, rows)
        else:
            own = {"master_id": "id"} | ({"master_version": "version"} if temporal else {})
            numbered = after.where(F.col("data_package_id") == p.id)
            numbered = numbered.select(*(F.col(c).alias(n) for n, c in own.items()), "data_package_rn")
            changes = merge.unpivoted(rows, local, ["data_package_rn"]).join(numbered, "data_package_rn").withColumn("lang_id", F.lit(p.lang))
            found = merge.upsert_localised(lc, changes, (*own, "attr", "lang_id"))
        return {table: self.store.written(table, found)}

    # ---- the end of a package

    def discard(self, id: int, run_ts: dt.datetime) -> None:
        version, p = self.store.manifest(HEADERS)["version"], self.package(id)
        p.state, p.state_change_date = DISCARDED, run_ts
        self.store.commit({HEADERS: self._with(p)}, {HEADERS: version})

    def delete(self, id: int) -> None:
        """A package's header and staged rows."""
        version, staged = self.store.manifest(HEADERS)["version"], f"staging_{id}"
        self.package(id)
        changes = {HEADERS: self.store.written(HEADERS, self.headers().where(F.col("id") != id).coalesce(1))}
        if self.store.exists(staged):
            changes[staged] = self.store.written(staged, self.store.read(staged).limit(0))
        self.store.commit(changes, {HEADERS: version})
        if staged in changes:
            self.store.vacuum(staged)
