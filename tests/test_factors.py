"""Aggregates over parts that meet in one vertex, against the rows of the whole pattern."""

import pytest

from graphloom.plans import factors, registry
from graphloom.plans.engine import Engine

LIVES = [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (1, 1), (1, 1)]
BASED = [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (2, 2)]


@pytest.fixture(scope="module")
def land(spark):
    e = Engine(spark)
    g = e.catalog.create("land")
    table = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    g.add_vertices("Land", table([(k, n) for k, n in enumerate(["a", "b", "b", "c"])], "k long, name string"), "k")
    g.add_vertices("Buyer", table(list(enumerate([1.0, 5.0, 5.0, None, 2.5, 7.0])), "k long, v double"), "k")
    g.add_vertices("Seller", table(list(enumerate([5.0, 0.0, 9.0, 5.0, None])), "k long, v double"), "k")
    for label, kind, pairs in (("LIVES", "Buyer", LIVES), ("BASED", "Seller", BASED)):
        g.add_edges(label, table([(k, *p) for k, p in enumerate(pairs)], "e long, a long, n long"), "e", (kind, "a"), ("Land", "n"), [])
    return lambda text: [tuple(r) for r in e.run(text).collect()]


QUERIES = {
    "distinct": "MATCH (b:Buyer)-[:LIVES]->(n:Land), (s:Seller)-[:BASED]->(n) RETURN n.name AS name, count(DISTINCT b) AS b, max(s.v) AS hi, count(DISTINCT s.v) AS v",
    "no keys": "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) WHERE b.v > 1 AND s.v < 9 RETURN count(DISTINCT b) AS b, count(DISTINCT s) AS s",
    "no rows": "MATCH (b:Buyer)-[:LIVES]->(n:Land {k: 9})<-[:BASED]-(s:Seller) RETURN count(DISTINCT b) AS b, count(DISTINCT s) AS s, min(s.v) AS v",
    "order": "MATCH (b:Buyer)-[:LIVES]->(n:Land), (s)-[:BASED]->(n) RETURN n.k AS k, count(DISTINCT b) AS b, min(s.v) AS v ORDER BY b DESC, k LIMIT 2",
    "three parts": "MATCH (b:Buyer)-[:LIVES]->(n:Land), (s:Seller)-[:BASED]->(n) MATCH (n)<-[:LIVES]-(c:Buyer) WHERE c.v > 4 RETURN n.name AS name, count(*) AS n",
    "count": "MATCH (b:Buyer)-[:LIVES]->()<-[:BASED]-(s:Seller) RETURN b.k AS k, count(*) AS n",
    "count nothing": "MATCH (b:Buyer {k: 77})-[:LIVES]->()<-[:BASED]-(s:Seller) RETURN count(*) AS n",
    "with": "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) WITH n.name AS name, count(*) AS n WITH name, n WHERE n > 2 RETURN n, name",
    "vertex alone": "MATCH (n:Land), (b:Buyer)-[:LIVES]->(n), (s:Seller)-[:BASED]->(n) WHERE n.k < 2 RETURN n.k AS k, count(*) AS n, count(*) AS again",
} | {f"compare {op}": f"MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) WHERE s.v {op} b.v RETURN n.name AS name, count(*) AS n" for op in ("<", "<=", ">", ">=")} | {"compare, keys of a part": "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) WHERE b.v <= s.v AND n.k < 2 RETURN s.k AS k, count(*) AS n"}


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_the_whole_pattern(land, monkeypatch, name):
    found, made = factors.grouped, []
    monkeypatch.setattr(factors, "grouped", lambda *x: made.append(found(*x)) or made[-1])
    got = land(QUERIES[name])
    assert made[0] is not None
    monkeypatch.setattr(factors, "grouped", lambda *x: None)
    assert sorted(got, key=repr) == sorted(land(QUERIES[name]), key=repr)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:LIVES]-(c:Buyer) RETURN count(*) AS n",
        "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[]-(c) RETURN count(*) AS n",
        "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) WHERE b.v < s.v AND b.k > s.k RETURN count(*) AS n",
        "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) RETURN n.k AS k, sum(b.v) AS v",
        "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller) WHERE b.v < s.v RETURN count(DISTINCT b) AS n",
        "MATCH (b:Buyer)-[:LIVES]->(n:Land)<-[:BASED]-(s:Seller {k: b.k}) RETURN count(*) AS n",
    ],
)
def test_patterns_that_need_all_rows(land, monkeypatch, text):
    found, made = factors.grouped, []
    monkeypatch.setattr(factors, "grouped", lambda *x: made.append(found(*x)) or made[-1])
    land(text)
    assert made == [None]


@pytest.mark.parametrize("name", ["comma_paths", "match_cycle_same_nation"])
def test_no_pairs(spark, name):
    """The parts meet in a semi join or a running count, not row by row."""
    folder = "/root/testdata/sf0.001"
    df = registry.QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan or "Window" in plan
    assert not any("Join Inner" in line and "s_acctbal" in line and "c_acctbal" in line for line in plan.split("\n"))
