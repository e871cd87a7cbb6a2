"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lectern import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(rows, columns):
    def text(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.6f}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    found, wanted = df.collect(), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert found, "no rows to compare"
    assert _norm(found, df.columns) == _norm(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_lookups_are_not_nested_loops(spark, sf_dir):
    for name in ("active_span_asof", "active_span_first_match", "next_span_after", "tap_hit_test"):
        df = catalog.queries()[name](spark, sf_dir)
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString(), name
