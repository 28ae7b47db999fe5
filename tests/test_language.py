"""Clauses, patterns and expressions on small graphs, with results worked out by hand or by enumeration."""

import itertools

import pytest

from graphloom.plans.compiler import Fault

#: A town of places: (from, to, label, name), with loops, parallel edges and a way back. "gate" and "pier" are labels of their own.
ROADS = [(0, 1, "lane", "north"), (1, 2, "lane", "north"), (2, 3, "lane", "north"), (1, 1, "ring", "ring"), (0, 2, "path", "short"), (2, 1, "path", "back"), (1, 3, "path", "wet"), (3, 2, "lane", "south"), (3, 3, "ring", "ring"), (2, 4, "lane", "north"), (4, 0, "path", "home")]
PLACES = {0: "gate", 1: "yard", 2: "yard", 3: "pier", 4: "yard"}
TOWN = "CREATE " + ", ".join(f"(p{k}:{label} {{k: {k}}})" for k, label in PLACES.items()) + ", " + ", ".join(f"(p{a})-[:{label} {{name: '{name}'}}]->(p{b})" for a, b, label, name in ROADS)


def count_trails(low, high, way, start=None, end=None, label=None, name=None):
    """Trails of low to high edges, no edge twice, by enumeration. way: 1 along edges, -1 against them, 0 either."""
    edges = [(i, a, b) for i, (a, b, t, n) in enumerate(ROADS) if label in (None, t) and name in (None, n)]
    # A loop is one edge whichever way it is read.
    steps = [(i, a, b) for i, a, b in edges if way >= 0] + [(i, b, a) for i, a, b in edges if way < 0 or (way == 0 and a != b)]
    found, todo = 0, [(k, ()) for k, kind in PLACES.items() if start in (None, kind)]
    while todo:
        at, used = todo.pop()
        if max(low, 1) <= len(used) <= high and end in (None, PLACES[at]):
            found += 1
        if len(used) < high:
            todo += [(b, (*used, i)) for i, a, b in steps if a == at and i not in used]
    return found


@pytest.fixture(scope="module")
def trails(spark):
    from graphloom.plans.engine import Engine

    e = Engine(spark)
    e.run("CREATE GRAPH v")
    e.run(TOWN)
    return e


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("(a:gate)-[*]->(z:pier)", (1, 99, 1, "gate", "pier")), ("(a:gate)-[*0..]->(z:pier)", (0, 99, 1, "gate", "pier")), ("(a:gate)-[*1..200]->(z:pier)", (1, 99, 1, "gate", "pier")), ("(a:gate)<-[*]-(z:pier)", (1, 99, -1, "gate", "pier")),
        ("(a:gate)-[*]-(z:pier)", (1, 99, 0, "gate", "pier")), ("(a:gate)-[:lane*]-(z:pier)", (1, 99, 0, "gate", "pier", "lane")), ("(a:gate)-[* {name: 'north'}]-(z:pier)", (1, 99, 0, "gate", "pier", None, "north")),
        ("()<-[*3..3 {name: 'north'}]-()", (3, 3, -1, None, None, None, "north")), ("()-[*]->()", (1, 99, 1)), ("(a:gate)-[*3..3]->(z:pier)", (3, 3, 1, "gate", "pier")), ("(a:gate)-[*2..4]-(z:pier)", (2, 4, 0, "gate", "pier")), ("()-[e1]->(v)-[e2]->()", (2, 2, 1)),
    ],
)
def test_trail_counts(trails, pattern, want):
    assert trails.run(f"MATCH {pattern} RETURN count(*) AS n").first()[0] == count_trails(*want) > 0


def test_trail_parts(trails):
    r = trails.run("MATCH p = (a:gate)-[t:lane*3]->(z:pier) RETURN length(t) AS l, size(nodes(t)) AS inner, size(nodes(p)) AS every, length(p) AS len").first()
    assert tuple(r) == (3, 2, 4, 3)


@pytest.fixture
def people(ask):
    ask("CREATE (a:P {name: 'ann', age: 30})-[:KNOWS {since: 1}]->(b:P {name: 'bob', age: 25})-[:KNOWS {since: 2}]->(c:P {name: 'cid'}), (c)-[:KNOWS {since: 3}]->(a), (a)-[:LIKES]->(a)")
    return ask


def test_match_and_null(people):
    assert people("MATCH (x:P) WHERE x.age > 26 RETURN x.name AS n") == [("ann",)]
    assert people("MATCH (x:P) WHERE x.age IS NULL RETURN x.name AS n") == [("cid",)]
    assert people("MATCH (x:P {name: null}) RETURN x.name AS n") == []
    assert sorted(people("MATCH (x:P)-[k:KNOWS]->(y) RETURN x.name AS a, k.since AS s, y.name AS b")) == [("ann", 1, "bob"), ("bob", 2, "cid"), ("cid", 3, "ann")]


def test_direction_and_loops(people):
    assert people("MATCH (x:P {name: 'ann'})-[e:KNOWS]-(y) RETURN count(*) AS n") == [(2,)]
    assert people("MATCH (x:P {name: 'ann'})-[e:LIKES]-(y) RETURN count(*) AS n") == [(1,)]
    assert people("MATCH (x)-[:KNOWS]->()-[:KNOWS]->()-[:KNOWS]->(x) RETURN count(*) AS n") == [(3,)]


def test_edges_do_not_repeat(people):
    assert people("MATCH (a)-[x:KNOWS]-(b)-[y:KNOWS]-(c) WHERE id(a) = id(c) RETURN count(*) AS n") == [(0,)]


def test_optional(people):
    rows = people("MATCH (x:P) OPTIONAL MATCH (x)-[k:KNOWS]->(y:P) WHERE y.age > 26 RETURN x.name AS a, y.name AS b ORDER BY a")
    assert rows == [("ann", None), ("bob", None), ("cid", "ann")]


def test_entity_values(people):
    r = people("MATCH (x:P {name: 'bob'}) RETURN x")[0][0]
    assert (r.id, r.label, r.properties.name) == (281474976710658, "P", "bob")
    assert people("MATCH (x:P) WITH x AS y RETURN DISTINCT label(y) AS l") == [("P",)]
    assert people("MATCH (x:P)-[k:KNOWS {since: 1}]->(y) RETURN start_id(k) = id(x) AS s, end_id(k) = id(y) AS e, type(k) AS t") == [(True, True, "KNOWS")]


def test_grouping_by_entity(people):
    assert sorted(people("MATCH (x:P)-[]->(y) WITH x, count(*) AS n RETURN x.name AS a, n")) == [("ann", 2), ("bob", 1), ("cid", 1)]


def test_nulls_order_like_the_language(people):
    assert [r[0] for r in people("MATCH (x:P) RETURN x.age AS a ORDER BY a")] == [25, 30, None]
    assert [r[0] for r in people("MATCH (x:P) RETURN x.age AS a ORDER BY a DESC")] == [None, 30, 25]
    assert [r[0] for r in people("MATCH (x:P) RETURN x.age AS a ORDER BY a DESC NULLS LAST SKIP 1 LIMIT 1")] == [25]


def test_subqueries(people):
    assert people("MATCH (x:P) WHERE x.age = ANY (MATCH (y:P) RETURN y.age) RETURN count(*) AS n") == [(2,)]
    assert people("MATCH (x:P) WHERE x.age >= ALL (MATCH (y:P) WHERE y.age > 0 RETURN y.age) RETURN x.name AS n") == [("ann",)]
    assert people("MATCH (x:P) WHERE EXISTS((x)-[:LIKES]->(x)) RETURN x.name AS n") == [("ann",)]
    assert people("MATCH (x:P) WHERE NOT EXISTS((x)-[:LIKES]->()) RETURN count(*) AS n") == [(2,)]
    assert sorted(people("MATCH (x:P) WHERE x.name IN (MATCH (y:P) WHERE y.age < 28 RETURN y.name) RETURN x.name AS n")) == [("bob",)]


def test_set_and_remove(people):
    people("MATCH (x:P {name: 'bob'}) SET x.age = x.age + 1, x.tag = 'old'")
    assert people("MATCH (x:P {name: 'bob'}) RETURN x.age AS a, x.tag AS t") == [(26, "old")]
    people("MATCH (x:P {name: 'bob'}) REMOVE x.tag")
    assert people("MATCH (x:P) WHERE x.tag IS NOT NULL RETURN count(*) AS n") == [(0,)]
    people("MATCH (x:P)-[k:KNOWS]->() SET k.since = 9")
    assert people("MATCH ()-[k:KNOWS]->() RETURN min(k.since) AS a, max(k.since) AS b") == [(9, 9)]


def test_delete(people):
    with pytest.raises(ValueError, match="DETACH"):
        people("MATCH (x:P {name: 'bob'}) DELETE x")
    assert people("MATCH (x:P) RETURN count(*) AS n") == [(3,)]
    people("MATCH (x:P {name: 'bob'}) DETACH DELETE x")
    assert people("MATCH ()-[k]->() RETURN count(*) AS n") == [(2,)]
    people("MATCH ()-[k:LIKES]->() DELETE k")
    assert people("MATCH ()-[k]->() RETURN count(*) AS n") == [(1,)]


def test_merge(ask):
    ask("MERGE (a:T {k: 1})")
    ask("MERGE (a:T {k: 1})")
    assert ask("MATCH (a:T) RETURN count(*) AS n") == [(1,)]
    assert sorted(ask("UNWIND [1, 2, 2, 3] AS v MERGE (a:T {k: v}) RETURN a.k AS k")) == [(1,), (2,), (2,), (3,)]
    assert ask("MATCH (a:T) RETURN count(*) AS n") == [(3,)]
    ask("MATCH (a:T {k: 1}) MERGE (a)-[:R]->(b:U {z: 5})")
    ask("MATCH (a:T {k: 1}) MERGE (a)-[:R]->(b:U {z: 5})")
    assert ask("MATCH (a:T)-[:R]->(b:U) RETURN a.k AS k, b.z AS z") == [(1, 5)]


def test_create_needs_direction(ask):
    with pytest.raises(ValueError, match="direction"):
        ask("CREATE (a)-[:X]-(b)")


def test_a_failed_statement_changes_nothing(engine):
    with pytest.raises(ValueError):
        engine.run("CREATE (z:Zed {k: 1}) SET nobody.x = 1")
    assert "Zed" not in engine.catalog.graph.labels


@pytest.mark.parametrize(
    "text,value",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("7 % 4", 3), ("2 ^ 10", 1024.0), ("1 + 2.5", 3.5), ("'a' + 1", "a1"), ("[1] + 2", [1, 2]), ("[1, 2] + [3]", [1, 2, 3]),
        ("1 < 2 AND NOT false", True), ("true XOR true", False), ("null = 1", None), ("1 IS DISTINCT FROM null", True), ("'abc' STARTS WITH 'ab'", True), ("'abc' =~ 'B'", False), ("'abc' ~* 'B'", True),
        ("'a%' LIKE 'a\\\\%'", True), ("3 BETWEEN SYMMETRIC 5 AND 1", True), ("CASE 2 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END", "y"), ("CASE WHEN false THEN 1 END", None), ("coalesce(null, 4)", 4),
        ("substring('hello', 2)", "ello"), ("substring('hello', 0, 3)", "he"), ("right('hello', -2)", "llo"), ("left('hello', 9)", "hello"), ("initcap('ab-cd ef')", "Ab-Cd Ef"), ("split('a,b', ',')", ["a", "b"]),
        ("size('abc')", 3), ("size([1, 2])", 2), ("head([5, 6])", 5), ("last([5, 6])", 6), ("range(3, 1)", []), ("range(1, 3)", [1, 2, 3]), ("range(5, 1, -2)", [5, 3, 1]), ("gcd(12, 18)", 6), ("lcm(4, 6)", 12), ("factorial(5)", 120),
        ("round(2.5)", 2.0), ("round(3.14159, 2)", 3.14), ("ceil(1.2)", 2), ("sign(-3.0)", -1.0), ("atan2(0.0, 1.0)", 1.5707963267948966), ("'2.5'::float", 2.5), ("2.5::int", 2), ("3.5::int", 4), ("5::string", "5"), ("'true'::boolean", True),
        ("l2_distance('[1,2]'::vector, '[4,6]'::vector)", 5.0), ("'[1,2]'::vector <#> '[3,4]'::vector", -11.0), ("'[1,0]'::vector <=> '[0,1]'::vector", 1.0), ("'[1,2]'::vector + '[1,1]'::vector", [2.0, 3.0]), ("dims('[1,2,3]'::vector)", 3), ("norm('[3,4]'::vector)", 5.0),
        ("intrange(1, 5) && intrange(5, 8)", False), ("intrange(1, 5, '[]') && intrange(5, 8)", True), ("'[1,10)'::intrange @> 10", False), ("intrange(1, 9) @> intrange(2, 3)", True), ("intrange(1, 3) << intrange(3, 4)", True), ("'{[1,3),[5,8)}'::intmultirange @> 6", True),
        ("'a fat cat'::tsvector @@ 'fat & !dog'", True), ("'a fat cat'::tsvector @@ 'fat <2> cat'", False), ("'a fat cat'::tsvector @@ 'ca:*'", True), ("plainto_tsquery('The Fat')", "the & fat"), ("phraseto_tsquery('The Fat')", "the <-> fat"),
        ("host('192.168.1.5/24'::inet)", "192.168.1.5"), ("masklen('192.168.1.5/24')", 24), ("broadcast('192.168.1.5/24')", "192.168.1.255/24"), ("network('192.168.1.5/24')", "192.168.1.0/24"), ("netmask('10.0.0.0/8')", "255.0.0.0"), ("family('::1')", 6),
        ("'192.168.1.0/24'::inet >> '192.168.1.9'::inet", True), ("'192.168.1.5'::inet - '192.168.1.1'::inet", 4), ("inet_merge('192.168.1.5/24', '192.168.2.5/24')", "192.168.0.0/22"), ("'08002B010203'::macaddr", "08:00:2b:01:02:03"), ("abbrev('10.1.0.0/16')", "10.1/16"),
        ("'(0,0)'::point <-> '(3,4)'::point", 5.0), ("'(2,2),(0,0)'::box @> '(1,1)'::point", True), ("'(2,2),(0,0)'::box && '(5,5),(3,3)'::box", False), ("width('(4,2),(1,1)'::box)", 3.0), ("'(0,0,2)'::circle @> '(1,1)'::point", True),
        ("ST_Length('LINESTRING(0 0, 3 4)'::geometry)", 5.0), ("ST_IsPolygonCCW('POLYGON((0 0, 1 0, 1 1, 0 0))'::geometry)", True), ("ST_asEWKT(ST_MakePoint(1, 2, 3))", "POINT(1 2 3)"), ("ST_XMax('LINESTRING(0 0, 3 4)'::geometry)", 3.0),
        ("ST_HausdorffDistance('LINESTRING(0 0, 2 0)'::geometry, 'LINESTRING(0 1, 2 1)'::geometry)", 1.0), ("ST_asEWKT(ST_Simplify('LINESTRING(0 0, 1 0.1, 2 0)'::geometry, 0.5))", "LINESTRING(0 0,2 0)"),
        ("size(ST_GeneratePoints('POLYGON((0 0, 4 0, 0 4, 0 0))'::geometry, 7, 3).points)", 7), ("ST_XMax(ST_SymDifference('POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))'::geometry, 'POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))'::geometry))", 3.0),
        ("ST_DistanceSpheroid('POINT(0 0)'::geometry, 'POINT(1 0)'::geometry)", 111319.49079327358), ("ST_DistanceSpheroid('POINT(0 0)'::geometry, 'POINT(1 0)'::geometry, 'SPHEROID[\"s\",6378137,298.257223563]'::spheroid)", 111319.49079327358),
        ("ST_asEWKT(ST_ConvexHull('MULTIPOINT(0 0, 2 0, 1 1, 2 2, 0 2)'::geometry))", "POLYGON((0 0,2 0,2 2,0 2,0 0))"), ("ST_azimuth('POINT(0 0)'::geometry, 'POINT(1 0)'::geometry)", 1.5707963267948966), ("ST_FrechetDistance('LINESTRING(0 0, 2 0)'::geometry, 'LINESTRING(0 1, 2 3)'::geometry)", 3.0),
        ("tointmultirange('{[1,3),[5,8)}') @> 2", True), ("build_edge(3, 1, 2, 'E', {w: 1}).end_id", 2), ("ST_DistanceCPA('LINESTRING(0 0 0 0, 10 0 0 10)'::geometry, 'LINESTRING(0 5 0 0, 10 1 0 10)'::geometry)", 1.0),
        ("extract(year FROM '2020-02-03'::timestamp)", 2020.0), ("extract(epoch FROM '1970-01-02'::timestamp)", 86400.0), ("date_part('dow', '2024-01-07'::date)", 0.0), ("isfinite('2020-01-01'::date)", True),
        ("age('2020-03-01'::timestamp, '2020-01-30'::timestamp).months", 1), ("justify_days('35 days'::interval).days", 5), ("make_date(2020, 2, 29)::string", "2020-02-29"), ("overlaps('2020-01-01'::date, '2020-02-01'::date, '2020-01-15'::date, '2020-03-01'::date)", True),
        ("{a: 1, b: 2} @> {a: 1}", True), ("{a: 1} ? 'b'", False), ("{a: {b: 7}}.a.b", 7), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3][1..]", [2, 3]), ("[1, 2, 3][..-1]", [1, 2]), ("2 IN [1, 2]", True), ("'{\"a\": 5}' ->> 'a'", "5"),
    ],
)
def test_expressions(ask, text, value):
    got = ask(f"RETURN {text} AS v")[0][0]
    if isinstance(value, float):
        assert got == pytest.approx(value)
    else:
        assert got == value and isinstance(got, type(value))


@pytest.mark.parametrize("text", ["1 / 0", "sqrt(-1)", "log(0)", "range(1, 2, 0)", "asin(2)", "intrange(5, 1)"])
def test_domain_errors(ask, text):
    with pytest.raises(Exception):
        ask(f"RETURN {text} AS v")


@pytest.mark.parametrize("text", ["MATCH (n) RETURN m.x AS a", "RETURN nothing(1) AS a", "MATCH (n:Nope) RETURN n", "UNWIND 5 AS x RETURN x", "RETURN 1 AS a, 2 AS a"])
def test_meaning_errors(people, text):
    with pytest.raises((Fault, ValueError)):
        people(text)


def test_parameters(people):
    assert people("MATCH (x:P) WHERE x.age = $a RETURN x.name AS n", {"a": 25}) == [("bob",)]
    assert people("MATCH (x:P $m) RETURN x.age AS n", {"m": {"name": "ann"}}) == [(30,)]


def test_windows_by_hand(ask):
    ask("UNWIND [1, 1, 2, 3, 3, 4] AS v CREATE (:W {v: v})")
    rows = sorted(ask("MATCH (w:W) RETURN w.v AS v, sum(w.v) OVER (ORDER BY w.v GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s"))
    values = [1, 1, 2, 3, 3, 4]
    groups = [list(g) for _, g in itertools.groupby(values)]
    want = []
    for k, g in enumerate(groups):
        want += [(x, sum(g) + (sum(groups[k - 1]) if k else 0)) for x in g]
    assert rows == sorted(want)


def test_graph_statements(engine):
    with pytest.raises(ValueError):
        engine.run("CREATE GRAPH g")
    engine.run("CREATE GRAPH h")
    engine.run("USE GRAPH h")
    engine.run("DROP GRAPH h CASCADE")
    with pytest.raises(ValueError):
        engine.run("MATCH (a) RETURN a")


def test_label_families(engine, spark):
    g = engine.catalog.graph
    g.add_vertices("Animal", spark.createDataFrame([(0, "cow")], "k int, name string"), "k")
    g.add_vertices("Dog", spark.createDataFrame([(0, "rex", 3)], "k int, name string, age int"), "k", parents=("Animal",))
    assert sorted(r[0] for r in engine.run("MATCH (a:Animal) RETURN a.name AS n").collect()) == ["cow", "rex"]
    assert engine.run("MATCH (d:Dog) RETURN d.name AS n").collect()[0][0] == "rex"
