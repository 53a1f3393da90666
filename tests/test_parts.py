"""What the queries don't reach: engine, store, scheduler, catalogue, schema changes, streams."""

import datetime as dt
import random
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions import names
from refloom.operators import analytics, cdc, evolve, matview, merge
from refloom.operators.numbering import numbered
from refloom.plans import catalog, graph, scheduler
from refloom.sources.packages import STATISTICS, Engine, state_counts
from refloom.sources.store import ConcurrentChange, Store
from refloom.streaming import ingest

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, tmp_path.as_uri())


@pytest.fixture
def engine(spark, store):
    c = catalog.Catalog(
        [
            catalog.EntityType("product", [catalog.Attribute("price", "n", precision=12, scale=2, logged=True)], parent="directory", logged=True),
            catalog.EntityType("contract", [catalog.Attribute("number", "s", 63)], parent="entity", temporal=True),
        ]
    )
    return Engine(spark, store, c, {"erp": "ru"})


def test_names(spark):
    lit = F.lit
    assert one(spark, names.valid_system_name(lit("1st Item-No."))) == "_1st_item_no_"
    assert one(spark, names.valid_system_name(lit("2024-01-01"), False)) == "2024_01_01"
    assert one(spark, names.camel_to_snake(lit("camelCaseString"))) == "camel_case_string"
    assert one(spark, names.camel_to_snake(lit("HTTPServer"))) == "h_tt_pserver"
    assert one(spark, names.snake_to_camel(lit("meta__view_name"))) == "MetaViewName"
    assert one(spark, names.snake_to_camel(lit("___"))) is None
    assert one(spark, names.compose_system_name(lit("orders"), postfix=lit("0_idx1"))) == "orders_0_idx1"
    assert one(spark, names.compose_system_name(lit("x" * 70), postfix=lit("p"))) == "x" * 61 + "_p"
    short = lambda *a: one(spark, names.abbreviate_name(lit("meta_view_name"), *a))
    assert [short(), short(True, 12), short(True, 10), short(True, 63)] == ["M_V_N", "M_View_Name", "M_V_Name", "meta_view_name"]
    assert one(spark, names.indent_text(names.indent_text(lit("a\nb"), 1), -1)) == "a\nb"
    assert one(spark, names.pretty_size(lit(10240))) == "10 kB"


def test_macro(spark):
    def expanded(code, level):
        return one(spark, names.expand_compatibility_macros(F.lit(code), F.lit(level).cast("int")))

    code = "with t as /* #if #server_major_version >= 12 */ /* #then */materialized/* #endif */ (select 1)"
    assert expanded(code, None) == code
    assert "materialized" in expanded(code, 12)
    assert "materialized" not in expanded(code, 11)
    assert "materialized" not in expanded(code, 9)  # as numbers
    other = "a /* #if #server_major_version >= 11 */ /* #then */ x /* #else */ /* y */ /* #endif */ b"
    assert expanded(other, 12) == "a x b"
    assert expanded(other, 10) == "a y b"
    assert expanded(f"{code} {other} z", 12) == f"{expanded(code, 12)} a x b z"


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "k int").repartition(7)
    got = sorted((r["k"], r["rn"]) for r in numbered(df, "k", start=5).collect())
    assert [n for _, n in got] == list(range(5, 205))


def test_blocked_activity_of_several_targets(spark):
    rng = random.Random(4)
    draw = lambda *own: rng.choice(own)
    rows = [(draw(None, *range(40)), draw("a", "b", None), draw(1, 2), draw(1, None), draw(1, None), draw(True, False, False, None)) for _ in range(600)]
    found = analytics.blocked_activity(spark.createDataFrame(rows, "pid int, locktype string, database int, relation int, page int, granted boolean")).collect()
    wait, hold = ([r for r in rows if r[5] is g and r[0] is not None] for g in (False, True))
    pairs = sorted({(w[0], h[0]) for w in wait for h in hold if w[1:5] == h[1:5] and w[0] != h[0]})
    assert sorted((r["pid"], r["blocking_pid"]) for r in found) == pairs


def test_blocked_activity_is_dealt(spark):
    """The pairs of a single target are made by several tasks, and not all pairs are gathered to find equal ones."""
    locks = spark.range(400).selectExpr("id AS pid", "'x' AS locktype", "1 AS database", "CAST(NULL AS INT) AS relation", "1 AS page", "id % 10 = 0 AS granted")
    found = analytics.blocked_activity(locks)
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    made = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 360 * 40 and len(made) > 2


def test_changes_of_a_large_table_are_dealt_by_its_rows(spark, monkeypatch):
    """Twice the rows have twice the tasks, with the same changes; an unchanged row is told in neither."""
    monkeypatch.setattr(cdc, "TASK_ROWS", 50)
    for n in (1000, 2000):
        before = spark.range(n).withColumn("x", F.col("id") % 7)
        after = spark.range(10, n + 10).withColumn("x", F.when(F.col("id") % 100 != 0, F.col("id") % 7))
        changes = cdc.diff_snapshots(before, after, ["id"], n)
        assert changes.rdd.getNumPartitions() == n // 50
        found = {r["operation"]: r["count"] for r in changes.groupBy("operation").count().collect()}
        assert found == {"D": 10, "I": 10, "U": n // 100 - 1}
    assert cdc.dealt(before, ["id"], 100) is before


def test_images_are_told_in_one_pass_over_states_dealt_as_they_are(spark, monkeypatch):
    """The states are compared once for both images, and what is shuffled are their rows, not structs of them."""
    monkeypatch.setattr(cdc, "TASK_ROWS", 50)
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "id int, x string")
    after = spark.createDataFrame([(2, None), (3, "d"), (4, "e"), (5, None)], "id int, x string")
    found = cdc.images(cdc.diff_snapshots(before, after, ["id"], 1000), ["id"])
    assert found.columns == ["operation", "id", "x"]
    rows = [("D", 1, "a"), ("I", 5, None), ("U", 3, "c"), ("U", 3, "d"), ("U", 4, None), ("U", 4, "e")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [below for line, below in zip(plan, plan[1:], strict=False) if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and not any("struct(" in below for below in dealt)


def test_catalog(spark):
    c = catalog.Catalog([catalog.EntityType("a", parent="directory"), catalog.EntityType("b", [catalog.Attribute("a_id", "a")], master="a", temporal=True, parent="entity")])
    own = {x.name: x for x in c.attributes("a")}
    assert own["golden_record_id"].type == "a" and "external_version" not in own
    assert "external_version" in {x.name for x in c.attributes("b")}
    assert c.attributes("b")[0].name == "master_id" and c.level("b") == 1
    assert c.build_order().index("a") < c.build_order().index("b")
    target = c.schema("b")
    assert target["id"].nullable is False and "valid_to" in target.names
    assert c.schema("b", "staging")["id"].nullable and c.schema("a", "lc").names[0] == "master_id"
    assert "name" not in c.schema("a").names and "name" in c.schema("a", "staging").names
    c.types["a"].built = True
    assert set(c.touch("directory")) == {"directory", "a"} and not c.types["a"].built
    with pytest.raises(ValueError):
        c.remove("a")
    c.remove("a", cascade=True)
    assert "b" not in c.types
    d = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "zz")], "k int, s string")
    assert [tuple(r) for r in catalog.duplicates(d, ["k"]).collect()] == [(1, 2)]
    bound = T.StructType([T.StructField("s", T.StringType(), True, {"max_length": 1})])
    assert [tuple(r) for r in catalog.too_long(d, bound).collect()] == [("s", 1)]


def test_plain_package(spark, engine):
    p = engine.register("product", "erp", T1)
    assert p.lang == "ru"
    rows = [(1, None, "a", "One", 1), (2, None, "b", None, 2)]
    engine.stage(p, spark.createDataFrame(rows, "data_package_rn long, id long, code string, name string, price int"))
    changed = engine.process(p.id, T1, p.state_change_date)
    with pytest.raises(merge.PackageError):
        engine.process(p.id, T2)
    got = {r["id"]: r["code"] for r in engine.store.read("product").collect()}
    assert got == {1: "a", 2: "b"} and changed == T1
    assert [(r["master_id"], r["lang_id"], r["lc_string"]) for r in engine.store.read("product_lc").collect()] == [(1, "ru", "One")]
    q = engine.register("product", "erp", T2)
    engine.stage(q, spark.createDataFrame([(1, 1, None, None, 5), (2, None, "c", "See", 6)], "data_package_rn long, id long, code string, name string, price int"))
    with pytest.raises(merge.PackageError):
        engine.process(q.id, T2, T1 - dt.timedelta(1))
    engine.process(q.id, T2)
    got = {r["id"]: (r["code"], r["record_date"]) for r in engine.store.read("product").collect()}
    assert got == {1: (None, T2), 2: ("b", T1), 3: ("c", T2)}  # nulls overwrite
    assert sorted(r["lc_string"] for r in engine.store.read("product_lc").collect()) == ["See"]  # a null text deletes
    log = engine.store.read("product_log").groupBy("operation").count().collect()
    assert {r["operation"]: r["count"] for r in log} == {"I": 3, "U": 1}
    d = engine.register("product", "erp", T2, is_deletion=True)
    engine.stage(d, spark.createDataFrame([(1, 3)], "data_package_rn long, id long"))
    engine.process(d.id, T2)
    assert engine.store.read("product_lc").count() == 0 and engine.store.read("product").count() == 2
    engine.delete(d.id)
    with pytest.raises(KeyError):
        engine.package(d.id)
    e = engine.register("product", "other", T2, lang="de")
    assert e.lang == "de" and engine.process(e.id, T2) == T2  # nothing staged
    engine.discard(e.id, T2)
    assert engine.package(e.id).state == "discarded"
    assert {(r["state"], r["n"]) for r in state_counts(engine.headers()).collect()} == {("processed", 2), ("discarded", 1)}
    told = engine.store.read(STATISTICS).groupBy("table_name").count().collect()
    assert {r["table_name"]: r["count"] for r in told} == {"product": 3, "product_lc": 3}


def test_an_interrupted_package_can_be_processed_again(spark, engine, monkeypatch):
    p = engine.register("contract", "erp", T1)
    engine.stage(p, versions(spark, [(1, None, None, "A", "v1", 1, T1, None)]))

    def fails(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr(Store, "_placed", fails)
        with pytest.raises(OSError):
            engine.process(p.id, T2)
    assert engine.package(p.id).state == "loaded" and not engine.store.exists("contract")
    engine.process(p.id, T2)
    assert engine.store.read("contract").count() == 1


def test_a_package_registered_meanwhile_stays(spark, store, engine, monkeypatch):
    first = engine.register("product", "erp", T1)
    usual = Store._placed

    def slow(self, number, tables):
        monkeypatch.setattr(Store, "_placed", usual)
        other = Store(spark, store.path)
        other.commit({"other": {"folder": None}})
        return usual(self, number, tables)

    monkeypatch.setattr(Store, "_placed", slow)
    second = engine.register("product", "erp", T2)  # another writer took the number: tried again
    assert {r["id"] for r in engine.headers().collect()} == {first.id, second.id} and store.exists("other")


def test_translations_of_versions(spark, store):
    c = catalog.Catalog([catalog.EntityType("offer", [catalog.Attribute("title", "s", localisable=True)], parent="entity", temporal=True)])
    engine = Engine(spark, store, c, {"erp": "ru"})
    p = engine.register("offer", "erp", T1)
    rows = [(1, None, None, "A", "v1", 1, T1, None), (2, None, None, None, None, None, None, None)]
    engine.stage(p, versions(spark, rows).withColumn("title", F.concat(F.lit("t"), "data_package_rn")))
    engine.process(p.id, T1)
    lc = {r["lc_string"]: r for r in engine.store.read("offer_lc").collect()}
    assert set(lc) == {"t1", "t2"} and all(r["is_default_value"] and r["master_version"] for r in lc.values())
    d = engine.register("offer", "erp", T2, is_deletion=True)
    engine.stage(d, engine.store.read("offer").select("id", "version", F.col("data_package_rn")))
    engine.process(d.id, T2)
    left = engine.store.read("offer").collect()
    # the outer version is gone with its translation, the internal one closed and keeps it
    assert [(r["external_id"], r["valid_to"]) for r in left] == [(None, T2)]
    assert [r["lc_string"] for r in engine.store.read("offer_lc").collect()] == ["t2"]
    found = merge.upsert_localised(
        spark.createDataFrame([(1, "a", "en", "x", False), (1, "a", "en", "y", True)], "master_id long, attr string, lang_id string, lc_string string, is_default_value boolean"),
        spark.createDataFrame([(1, "a", "en", "z")], "master_id long, attr string, lang_id string, lc_string string"),
    )
    assert {(r["lc_string"], r["is_default_value"]) for r in found.collect()} == {("x", False), ("z", True)}


def test_latest_rows_of_a_series(spark):
    """The id goes by the begin, the end by the ordinal number, rows without one before all others."""
    at = [dt.datetime(2020 + i, 1, 1) for i in range(5)]
    target = versions(spark, [(1, 5, 1, "A", "v1", 3, at[0], at[1]), (2, 6, 2, "A", "v2", 1, at[2], at[3]), (3, 7, 3, "B", "v1", None, at[0], at[1]), (4, 7, 4, "B", "v2", 9, at[1], at[2])])
    staged = versions(spark, [(1, None, None, "A", "v3", 4, None, None), (2, None, None, "B", "v3", 9, None, None)])
    found = merge._latest(target, staged, "external_id", "external_version_ordinal_num").collect()
    assert {r["external_id"]: tuple(r)[2:] for r in found} == {"A": (6, at[1]), "B": (7, at[1])}


def versions(spark, rows):
    fields = "data_package_rn long, id long, version long, external_id string, external_version string, external_version_ordinal_num decimal(5,0), valid_from timestamp_ntz, valid_to timestamp_ntz, source_id long"
    from decimal import Decimal

    return spark.createDataFrame([(*r[:5], r[5] and Decimal(r[5]), *r[6:], 1) for r in rows], fields)


def test_temporal_package(spark, engine):
    day = dt.datetime
    top = day(9999, 12, 31)
    p = engine.register("contract", "erp", T1)
    engine.stage(p, versions(spark, [(1, None, 1, "A", "v1", 1, day(2020, 1, 1), day(2021, 1, 1)), (2, None, 2, "A", "v2", 2, day(2021, 1, 1), None), (3, None, None, None, None, None, None, None), (4, None, None, None, None, None, None, None)]))
    engine.process(p.id, T1)
    read = lambda: sorted((r["external_version"] or "", r["id"], r["valid_from"], r["valid_to"]) for r in engine.store.read("contract").collect())
    found = read()
    assert [x[2:] for x in found if x[0]] == [(day(2020, 1, 1), day(2021, 1, 1)), (day(2021, 1, 1), top)]
    assert len({x[1] for x in found if x[0]}) == 1 and len({x[1] for x in found}) == 3
    q = engine.register("contract", "erp", T2)
    engine.stage(q, versions(spark, [(1, None, 3, "A", "v3", 3, day(2022, 1, 1), None)]))
    engine.process(q.id, T2)
    assert [x[2:] for x in read() if x[0] in ("v2", "v3")] == [(day(2021, 1, 1), day(2022, 1, 1)), (day(2022, 1, 1), top)]
    inner = engine.store.read("contract").where("external_id IS NULL").orderBy("id").first()
    r = engine.register("contract", "erp", T2)
    engine.stage(r, versions(spark, [(1, inner["id"], inner["version"], None, None, None, None, None)]))
    engine.process(r.id, T2)
    again = engine.store.read("contract").where(F.col("id") == inner["id"]).orderBy("valid_from").collect()
    assert [(x["valid_from"], x["valid_to"]) for x in again] == [(day(1900, 1, 1), T2), (T2, top)]
    s = engine.register("contract", "erp", T2)
    engine.stage(s, versions(spark, [(1, inner["id"], inner["version"], None, None, None, None, None)]))
    with pytest.raises(merge.PackageError):
        engine.process(s.id, T2)  # that version is closed


def test_upsert_twice_is_once(spark):
    rng = random.Random(3)
    target = spark.createDataFrame([(i, rng.random(), i, T1) for i in range(50)], "id long, v double, data_package_rn long, record_date timestamp_ntz")
    package = spark.createDataFrame([(rng.randrange(80), rng.random(), i) for i in range(60)], "id long, v double, data_package_rn long")
    now = F.lit(T2).cast("timestamp_ntz")
    first = merge.upsert_plain(target, package, now)
    assert sorted(map(tuple, merge.upsert_plain(first, package, now).collect())) == sorted(map(tuple, first.collect()))
    assert first.count() == first.select("id").distinct().count()


def test_store(spark, store):
    v = store.write("t", spark.range(3))
    store.write("t", spark.range(5), v)
    with pytest.raises(ConcurrentChange):
        store.write("t", spark.range(7), v)
    assert store.read("t").count() == 5 and store.vacuum("t") == 2 and store.read("t").count() == 5
    assert store.sizes(["t", "none"]).where("n_total_relation_size > 0").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_incremental_is_full(spark, store):
    rng = random.Random(5)
    data = [(f"m {i % 7}/x", rng.random()) for i in range(100)]
    state = {"rows": data}
    build = lambda s, chunks: s.createDataFrame(state["rows"], "chunk string, x double")
    seen = []
    view = matview.ChunkedView("v", build, "chunk", lambda s: build(s, None), bucket=2, dependants=[lambda rows: seen.append(rows.count())])
    first = view.refresh(spark, store)
    assert len(first) == 7 and view.refresh(spark, store) == [] and sum(seen) == len(data)
    state["rows"] = [r for r in data if r[0] != "m 3/x" or rng.random() < 0.5] + [("m 8/x", 1.0)]
    view.invalidate(store, ["m 3/x"])
    assert view.refresh(spark, store) == ["m 3/x", "m 8/x"]
    assert sorted(map(tuple, view.read(store).collect())) == sorted(state["rows"])
    state["rows"] = [r for r in state["rows"] if r[0] != "m 1/x"]
    view.refresh_fully(spark, store)
    assert sorted(map(tuple, view.read(store).collect())) == sorted(state["rows"])
    assert view.read(store, ["m 2/x"]).count() == sum(r[0] == "m 2/x" for r in state["rows"])


def test_scheduler():
    rng = random.Random(7)
    for _ in range(10):
        masters = {v: {m for m in range(v) if rng.random() < 0.2} for v in range(15)}
        done, lock = [], threading.Lock()

        def refresh(v):
            with lock:
                assert masters[v] <= set(done)
                done.append(v)

        assert set(scheduler.refresh_all(masters, refresh, workers=4)) == set(masters)
    assert scheduler.refresh_all({1: set(), 2: {1}, 3: {2}}, lambda v: v, pending=[2, 3], order={3: {2}}) == [2, 3]
    with pytest.raises(scheduler.ScheduleError):
        scheduler.refresh_all({1: {2}, 2: {1}}, lambda v: v)
    with pytest.raises(ZeroDivisionError):
        scheduler.refresh_all({1: set()}, lambda v: 1 / 0)
    with pytest.raises(scheduler.ScheduleError):
        scheduler.refresh_all({1: set()}, lambda v: threading.Event().wait(0.5), seconds=0.05)


def test_closure_limit(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "view_id long, master_id long")
    roots = spark.createDataFrame([(4,)], "root long")
    assert {r["node"] for r in graph.closure(edges, roots, level_limit=2).collect()} == {3, 2}


def test_closure_of_many_ways(spark):
    # 2 ** 14 ways from the last to the first, and as many steps as layers
    edges = [(2 * i + a, 2 * (i - 1) + b) for i in range(1, 15) for a in (0, 1) for b in (0, 1)]
    found = graph.closure(spark.createDataFrame(edges, "view_id long, master_id long"), spark.createDataFrame([(28,)], "root long"))
    assert {r["node"]: r["level"] for r in found.collect()} == {2 * i + a: i - 14 for i in range(14) for a in (0, 1)}


def test_closure_with_a_cycle_elsewhere(spark):
    edges = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (1, 3)], "view_id long, master_id long")
    found = graph.closure(edges, spark.createDataFrame([(4,)], "root long"))
    assert {r["node"]: r["level"] for r in found.collect()} == {3: -1, 2: -2, 1: -3}
    pairs = {(r["view_id"], r["master_id"]): r["level"] for r in graph.inherited_edges(edges).collect()}
    assert pairs[4, 1] == 3 and (3, 3) not in pairs and pairs[3, 1] == 2


def test_chunk_filter_reaches_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(matview.months_between("l_shipdate", ["1997-12", "1998-01", "1996-03"]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(l_shipdate,1996-03-01" in plan
    assert rows.where(F.date_format("l_shipdate", "yyyy-MM").isin("1997-12", "1998-01", "1996-03")).count() == rows.count() > 0
    assert spark.range(1).where(matview.months_between("id", [])).count() == 0


def test_evolution(spark):
    old = T.StructType().add("a", "integer").add("b", "string").add("c", "date")
    new = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.DateType()), T.StructField("d", T.StringType(), False)])
    assert not evolve.plan_evolution(old, new).rebuild
    assert evolve.plan_evolution(old, T.StructType().add("b", "string").add("a", "integer")).reasons == ("order",)
    assert evolve.plan_evolution(old, new, "a", "c", True).reasons == ("forced", "partitioning")
    df = spark.createDataFrame([(1, "x", dt.date(2024, 1, 1))], old)
    assert tuple(evolve.evolve(df, new, {"d": "-"}).first()) == (1, dt.date(2024, 1, 1), "-")
    odd = T.StructType().add("c", "boolean")
    with pytest.raises(AnalysisException):
        evolve.evolve(df, odd)
    assert evolve.evolve(df, odd, lose=True).first()[0] is None
    assert [tuple(r) for r in evolve.nulls_in(df.withColumn("d", F.lit(None).cast("string")), new).collect()] == [("d", 1)]


def test_maintenance(spark):
    locks = spark.createDataFrame([(T1, "x")], "lock_time timestamp_ntz, locked_by string")
    views = spark.createDataFrame([(True, None)], "is_materialized boolean, refresh_time timestamp_ntz")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    assert analytics.maintenance_mode(locks, views, at(T1 + dt.timedelta(hours=3))).first()["process_name"] == "deployment"
    assert analytics.maintenance_mode(locks, views, at(T2)).first()["process_name"] == "initial refresh"
    assert analytics.maintenance_mode(locks, views.limit(0), at(T2)).count() == 0
    assert analytics.report_year(dt.date(2025, 1, 15)) == (dt.date(2024, 1, 1), dt.date(2025, 1, 1))


def test_streams(spark, store, tmp_path):
    source = (tmp_path / "in").as_uri()
    for n in range(3):
        spark.createDataFrame([(k, n * 10 + k, n) for k in range(n, n + 3)], "k long, v long, n long").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: ingest.upsert_stream(ingest.stream_of(spark, source, schema), store, "s", "k", "n", (tmp_path / "cp").as_uri())
    ingest.drained(stream())
    assert store.read_chunks("s").count() == 5
    before = store.manifest("s")
    ingest.drained(stream())
    assert store.manifest("s") == before
    got = {r["k"]: (r["v"], r["n"]) for r in store.read_chunks("s").collect()}
    assert got == {k: (n * 10 + k, n) for k, n in ((0, 0), (1, 1), (2, 2), (3, 2), (4, 2))}
