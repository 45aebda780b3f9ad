"""Every query of the library against its SQL in DuckDB."""

import glob
import os

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parqlane.plans import catalogue
from parqlane.sources import footer
from parqlane.sources.stores import scratch_path


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toArrow()
    if name not in catalogue.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.execute(catalogue.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(repr([r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["filter_or_of_and"](spark, sf)._jdf.queryExecution().toString()
    assert "Or(LessThan(l_quantity,5.0),And(GreaterThan(l_discount,0.05),LessThan(l_tax,0.03)))" in plan
    plan = catalogue.QUERIES["project_keeps_predicate_cols"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_files_grow_in_number_with_the_table(spark, sf, duck, monkeypatch):
    """No file takes a whole large table, or has a footer of all its row groups."""
    monkeypatch.setattr(catalogue, "FILE_ROWS", 700)
    found = footer.chunks(spark, catalogue._two_unequal_files(spark, sf)).where("column_index = 0").groupBy("file")
    files = found.agg(F.sum("group_rows"), F.count("*")).drop("file").collect()
    assert sum(n for n, _ in files) == duck.execute("SELECT count(*) FROM orders").fetchone()[0] and max(n for n, _ in files) <= 700
    assert min(g for _, g in files) == 1 and max(g for _, g in files) > 1
    got = catalogue.QUERIES["row_group_scope"](spark, sf).agg(F.count("*"), F.count_distinct("o_orderkey")).first()
    assert tuple(got) == duck.execute("SELECT count(*), count(DISTINCT o_orderkey) FROM orders").fetchone()


@pytest.mark.parametrize("name", ["filter_boolean", "might_contain_absent_in_bloom", "bloom_holds_all", "null_counts", "read_any_type"])
def test_large_tables_are_written_by_several_tasks(spark, sf, duck, monkeypatch, tmp_path, name):
    """A table above a task's bytes is written as it is scanned, not through one task, and the result is the same."""
    for table in ("lineitem", "customer", "events", "orders"):
        pq.write_table(pq.read_table(f"{sf}/{table}.parquet"), tmp_path / f"{table}.parquet", row_group_size=50)
    monkeypatch.setattr(catalogue, "TASK_BYTES", 1 << 10)
    monkeypatch.setattr(catalogue, "BLOOM_ROWS", 40)
    wrote = []
    monkeypatch.setattr(catalogue, "scratch_path", lambda spark, tag: wrote.append(scratch_path(spark, tag)) or wrote[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 << 10)
    try:
        test_query(spark, str(tmp_path), duck, name)
        assert len(footer.files_of(spark, wrote[0])) > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
