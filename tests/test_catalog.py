"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from graphmill import catalog, catalog_changes, catalog_facts, catalog_index

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["commit_cadence_week", "churn_by_file", "branch_activity", "effective_files", "reconcile_targets", "symbols_contains", "containing_symbol", "name_cascade", "containment_cascade", "cohesion", "coverage_grouping_sets", "diff_changed", "callers_depth5", "connected_components", "rrf_fused", "session_quiet_period"]


def rounded(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted({*SOME, *(n for n, f in catalog.QUERIES.items() if f.__module__ in (catalog_changes.__name__, catalog_facts.__name__, catalog_index.__name__) and n in catalog.ORACLE_SQL)}))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(catalog.ORACLE_SQL[name])
    place = [[c[0] for c in rel.description].index(c) for c in cols]
    want = sorted((tuple(rounded(r[i]) for i in place) for r in rel.fetchall()), key=str)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == want and got


def test_entry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_calls_are_resolved_once(spark):
    plan = catalog.QUERIES["callers_depth5"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "callee_name" not in plan and "l_orderkey" not in plan
