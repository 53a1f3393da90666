"""Every query with SQL against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.4f}"
    return v.isoformat() if hasattr(v, "year") else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_query_has_sql():
    assert set(OWN) <= set(ORACLE)


@pytest.mark.parametrize("name", OWN)
def test_same_as_sql(spark, sf_dir, duck, name):
    found, wanted = QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


#: Queries whose values depend on rounding or ties, over ten times as many rows.
LARGER = ("upsert_plain", "upsert_new_ids", "delete_plain", "stat_refresh_duration", "scd_external_versions", "scd_close_internal")


@pytest.mark.parametrize("name", LARGER)
def test_same_as_sql_over_more_rows(spark, name):
    to = Path("/root/testdata/sf0.01")
    if not to.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in to.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found, wanted = QUERIES[name](spark, str(to)), con.sql(ORACLE[name])
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


@pytest.fixture(scope="module")
def far(spark, sf_dir, tmp_path_factory):
    """Customers whose keys begin at 1e9, so that sums of them go beyond what is told in megabytes elsewhere."""
    to = str(tmp_path_factory.mktemp("far"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customer.withColumn("c_custkey", customer["c_custkey"] + 1_000_000_000).write.parquet(f"{to}/customer.parquet")
    return to


@pytest.mark.parametrize("name", ["ops_schema_size", "ops_size_rollup"])
def test_sizes_as_in_sql_beyond_gigabytes(spark, far, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{far}/customer.parquet/*.parquet'")
    found, wanted = QUERIES[name](spark, far), con.sql(ORACLE[name])
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", ["cdc_invalid_chunks", "view_chunk_invalidation"])
def test_chunks_as_in_sql_where_changes_are_dealt(spark, sf_dir, duck, monkeypatch, name):
    monkeypatch.setattr("refloom.operators.cdc.TASK_ROWS", 100)
    found, wanted = QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name])
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["month", "n", "revenue"]
