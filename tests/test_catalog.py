"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from lumenspool.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))
    found = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


def test_every_query_without_oracle_runs(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", ["speaker_overlap_assign", "visual_outside_speech", "near_dup_hamming", "elementary_interval_winner", "referential_audit"])
def test_no_nested_loop_join(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
