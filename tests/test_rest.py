"""Sources, the index, streaming, and SQL rewrites."""

import numpy as np
import pytest

from graphloom.functions.registry import names
from graphloom.operators.nearest import IvfIndex, top_k
from graphloom.plans.sqltext import rewrite
from graphloom.sources import tables
from graphloom.streaming import windows


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        tables.write(df, path, kind)
        assert sorted(tables.read(spark, path, kind, "k int, v string").collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        tables.read(spark, "x", "xls")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_ivf_recall(spark, metric):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=8) * 0.2]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    index = IvfIndex(df, "v", 12, metric)
    assert index.df.count() == 600
    hits = 0
    for q in range(0, 50, 10):
        exact = {r[0] for r in top_k(df, "v", rows[q][1], 10, metric).select("vec_id").collect()}
        hits += len(exact & {r[0] for r in index.search(rows[q][1], 10, probes=4).select("vec_id").collect()})
    assert hits >= 45


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:1{i % 10}:00", i % 3, "click" if i % 2 else "view", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value", "props")
    folder = str(tmp_path / "events")
    df.write.parquet(folder)
    q = windows.bucket_counts_stream(spark, folder).writeStream.outputMode("complete").format("memory").queryName("bucket_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.sql("SELECT * FROM bucket_counts").collect()) == sorted(windows.bucket_counts(df).collect())


def test_rewrites_leave_texts_alone():
    assert rewrite("SELECT 'x ISNULL' AS a WHERE b ISNULL") == "SELECT 'x ISNULL' AS a WHERE b IS NULL"
    assert "RLIKE '^(a.*)$'" in rewrite("SELECT x SIMILAR TO 'a%' FROM t")
    assert rewrite("TABLE t") == "SELECT * FROM t"


def test_functions_are_many():
    assert len(names()) > 200


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1"])
def test_blocks_of_queries_and_vectors_give_the_exact_nearest(spark, monkeypatch, metric):
    """All lists probed: the k nearest of each query as top_k has them, ties of equal vectors included, and no pair of a query and a row as a row of a join."""
    from graphloom.operators import nearest

    monkeypatch.setattr(nearest, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8)).astype("float32")
    x = np.concatenate([base, base, base[:20]])
    df = spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(2)
    asked = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    found = nearest.IvfIndex(df, "embedding", 3, metric).search_all(asked, 5, 3)
    assert "cogroup" in found._jdf.queryExecution().analyzed().toString().lower()
    got = {}
    for q, r, v, d in sorted(map(tuple, found.collect())):
        got.setdefault(q, []).append((v, d))
    for k in range(0, 140, 20):
        assert got[k] == [tuple(r) for r in nearest.top_k(df, "embedding", x[k].tolist(), 5, metric).select("vec_id", "distance").collect()], k
