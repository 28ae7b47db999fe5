"""Every registered query against its SQL on the smallest test tables, and plans of some of them."""

import os

import duckdb
import pytest

from graphloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["match_edge_unique", "vle_unbounded"])
def test_whole_tables(name):
    """No subset by ids in the query; test_same_rows compares the rows."""
    assert "WHERE" not in registry.GRAPH[name][0]


def text_of(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_scan(spark):
    plan = text_of(spark, "match_filter_project")
    assert "PushedFilters" in plan and "GreaterThan(c_acctbal,5000" in plan
    assert "c_nationkey" not in plan.split("== Physical Plan ==")[1].split("ReadSchema: ")[1].split("\n")[0]


def test_a_foreign_key_edge_is_one_scan(spark):
    plan = text_of(spark, "match_1hop_agg").split("== Physical Plan ==")[1]
    assert plan.count("orders.parquet") == 1


def test_existence_is_a_semi_join(spark):
    assert "LeftSemi" in text_of(spark, "exists_pattern").split("== Physical Plan ==")[1]
    assert "LeftAnti" in text_of(spark, "not_exists_pattern").split("== Physical Plan ==")[1]


def test_no_nested_loops_for_undirected_edges(spark):
    assert "NestedLoop" not in text_of(spark, "match_undirected").split("== Physical Plan ==")[1]


def test_probed_lists_are_all_that_is_read(spark, tmp_path):
    from graphloom.operators.nearest import IvfIndex

    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    index = IvfIndex(df, "embedding", 20, path=f"{tmp_path}/lists")
    found = index.search(df.where("vec_id = 0").first()["embedding"], 5, probes=2)
    assert "PartitionFilters: [list" in found._jdf.queryExecution().toString().replace("isnotnull(list", "list") and found.first()["vec_id"] == 0
    assert index.df.count() == df.count() and len(found.inputFiles()) <= 2 * 8 * 4
