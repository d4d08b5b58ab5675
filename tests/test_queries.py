"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = compare.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLE[name])
    want = compare.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() == 3


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 100


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    cursor = con.execute(ORACLE[name])
    want = cursor.fetchall()
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of([d[0] for d in cursor.description], want)
    return want


def test_small_assignment_of_partial_volumes(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    numbers = [8 * v + k for v, held in enumerate(["01234567", "0123", "01", "02", "013", "012", "0246135", "012345", "0123457", "13", "0413", "2301"]) for k in map(int, held)]
    assert max(numbers) < e.count()
    e.where(e.vec_id.isin(numbers)).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r[:2] for r in against_sql(spark, tmp_path, "small_assignment")) == [(0, 4), (1, 2), (11, 2)]


def test_source_audit_of_long_ids(spark, sf_dir, tmp_path):
    s, e = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("supplier", "events"))
    s.withColumn("s_suppkey", s.s_suppkey + 997).write.parquet(str(tmp_path / "supplier.parquet"))
    e.withColumn("user_id", e.user_id * 101).write.parquet(str(tmp_path / "events.parquet"))
    assert any(r[0] > 999 and r[2] == "in/100_clean.png" for r in against_sql(spark, tmp_path, "source_audit"))
