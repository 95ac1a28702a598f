"""Queries with an oracle against DuckDB."""

import duckdb
import pytest

from muniprop.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    res = con.execute(ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
