"""Driver contract: entry runs; every registered query agrees with its DuckDB oracle (sf0.001)."""

import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from muniprop.fixtures import DRIVER_TABLES
from muniprop.plans import sqlapi

# The optional subpackage brings its own tests.
OWN = sorted(set(E.queries()) - set(E.LLM_QUERIES))


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "kommune_key" in df.columns


def test_every_own_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(OWN) <= set(o) <= set(q)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = E.queries()[name](spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    assert sorted(s_cols) == sorted(d_cols)
    assert _rows(s_cols, s_rows) == _rows(d_cols, res.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_gate_column_matches_python_rule(spark_text_check, text):
    spark_text_check(text)


@pytest.fixture(scope="module")
def spark_text_check(spark):
    from pyspark.sql import functions as F

    def check(text):
        # the Column rule and the Python rule agree on ASCII whitespace statements
        if any(ch.isspace() and ch not in " \t\n\x0b\f\r" for ch in text):
            return
        got = spark.createDataFrame([(text,)], "s string").select(sqlapi.verdict_of(F.col("s"))).first()[0]
        assert got == ("read" if sqlapi.only_reads(text) else "write")

    return check


def test_bounded_query_truncation(spark, sf_dir):
    for t in ("nation",):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    res = sqlapi.bounded_query(spark, "SELECT * FROM nation WHERE n_nationkey >= ?", [0], limit=10)
    got = res.frame.collect()
    assert res.columns == ["n_nationkey", "n_name", "n_regionkey"]
    assert len(got) == 10 and all(r["truncated"] and r["row_count"] == 10 for r in got)
    every = sqlapi.bounded_query(spark, "SELECT * FROM nation").frame.collect()
    assert len(every) == 25 and not any(r["truncated"] for r in every)
    with pytest.raises(PermissionError):
        sqlapi.bounded_query(spark, "WITH x AS (SELECT 1) INSERT INTO nation SELECT * FROM x")
    with pytest.raises(ValueError):
        sqlapi.bounded_query(spark, "SELECT 1", limit=2001)
