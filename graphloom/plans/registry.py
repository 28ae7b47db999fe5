"""Queries over the test tables, one for each operator family, with SQL that gives the same rows.

Each graph query is text of the query language over the trade graph (sources.catalog.trade_graph). Columns are aliased alike on
both sides; sums of floats are rounded, since their order is free.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import IvfIndex, top_k
from ..operators.trails import shared_folder
from ..sources.catalog import trade_graph
from ..sources.tables import folder_tables
from .engine import Engine

FLAGSHIP = "match_1hop_agg"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the trade graph, and the tables as views for SQL statements."""
    e = Engine(spark)
    read = folder_tables(spark, sf_dir)
    trade_graph(e.catalog, read)
    return e


def graph(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).run(text)


def relational(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return Engine(spark).run(text)

    return run


#: name: (graph query, SQL)
GRAPH: dict[str, tuple[str, str | None]] = {
    # -- scans, filters, hops --
    "match_filter_project": ("MATCH (c:Customer) WHERE c.c_acctbal > 5000 AND c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS custkey, c.c_name AS name", "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "match_1hop_agg": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS segment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1"),
    "match_2hop": ("MATCH (c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "match_5hop_region": ("MATCH (r:Region)<-[:IN_REGION]-(:Nation)<-[:LIVES_IN]-(:Customer)-[:PLACED]->(:Orders)-[l:CONTAINS]->(p:Part) WHERE p.p_size < 10 RETURN r.r_name AS region, count(*) AS n, round(sum(l.l_extendedprice), 0) AS price", "SELECT r_name AS region, count(*) AS n, round(sum(l_extendedprice), 0) AS price FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY 1"),
    "match_props": ("MATCH (n:Nation {n_regionkey: 2})<-[:BASED_IN]-(s:Supplier) RETURN n.n_name AS nation, s.s_suppkey AS supp", "SELECT n_name AS nation, s_suppkey AS supp FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "match_undirected": ("MATCH (n:Nation)-[:IN_REGION]-(x) RETURN label(x) AS kind, count(*) AS n", "SELECT 'Region' AS kind, count(*) AS n FROM nation"),
    "match_cycle_same_nation": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > c.c_acctbal RETURN n.n_nationkey AS nation, count(*) AS n", "SELECT n_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > c_acctbal GROUP BY 1"),
    "match_edge_unique": ("MATCH (o:Orders)-[a:CONTAINS]->(p:Part)<-[b:CONTAINS]-(q:Orders) RETURN count(*) AS n", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND (a.l_orderkey, a.l_suppkey, a.l_linenumber) <> (b.l_orderkey, b.l_suppkey, b.l_linenumber)"),
    "comma_paths": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.n_name AS nation, count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers", "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "comma_cartesian_small": ("MATCH (r:Region), (n:Nation) RETURN r.r_name AS region, n.n_name AS nation", "SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation"),
    "multi_match": ("MATCH (n:Nation) WHERE n.n_nationkey < 5 MATCH (c:Customer)-[:LIVES_IN]->(n) RETURN n.n_nationkey AS nation, count(*) AS n", "SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_nationkey < 5 GROUP BY 1"),
    "all_labels_scan": ("MATCH (x) RETURN label(x) AS kind, count(*) AS n", "SELECT 'Region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Orders', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Vec', count(*) FROM embeddings"),
    "optional_match": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, count(s) AS n", "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1"),
    "optional_outer_where": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.s_suppkey > n.n_nationkey RETURN n.n_nationkey AS nation, count(s) AS n", "SELECT n_nationkey AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey > n_nationkey GROUP BY 1"),
    "path_functions": ("MATCH p = (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN length(p) AS len, size(nodes(p)) AS nodes, size(relationships(p)) AS edges, count(*) AS n", "SELECT 2 AS len, 3 AS nodes, 2 AS edges, count(*) AS n FROM customer"),
    "entity_functions": ("MATCH (r:Region)<-[e:IN_REGION]-(n:Nation) RETURN n.n_nationkey AS k, label(r) AS l, type(e) AS t, size(keys(r)) AS nk, end_id(e) = id(r) AS same", "SELECT n_nationkey AS k, 'Region' AS l, 'IN_REGION' AS t, 2 AS nk, true AS same FROM nation"),
    # -- subqueries --
    "exists_pattern": ("MATCH (c:Customer) WHERE exists((c)-[:PLACED]->(:Orders {o_orderpriority: '1-URGENT'})) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "not_exists_pattern": ("MATCH (c:Customer) WHERE NOT exists((c)-[:PLACED]->()) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "exists_query": ("MATCH (c:Customer) WHERE EXISTS(MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * 40 RETURN o) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"),
    "exists_in_case": ("MATCH (n:Nation) RETURN n.n_name AS nation, CASE WHEN exists((n)<-[:BASED_IN]-(:Supplier)) THEN 'yes' ELSE 'no' END AS supplied", "SELECT n_name AS nation, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'yes' ELSE 'no' END AS supplied FROM nation"),
    "exists_or": ("MATCH (n:Nation) WHERE n.n_nationkey < 3 OR exists((n)<-[:BASED_IN]-(:Supplier)) RETURN n.n_nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)"),
    "in_subquery": ("MATCH (o:Orders) WHERE o.o_custkey IN (MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_custkey) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "any_subquery": ("MATCH (c:Customer) WHERE c.c_acctbal > ANY (MATCH (s:Supplier) RETURN s.s_acctbal) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier)"),
    "all_subquery": ("MATCH (c:Customer) WHERE c.c_acctbal <= ALL (MATCH (s:Supplier) WHERE s.s_acctbal > 5000 RETURN s.s_acctbal) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal <= ALL (SELECT s_acctbal FROM supplier WHERE s_acctbal > 5000)"),
    "call_subquery": ("CALL { MATCH (c:Customer) RETURN c.c_nationkey AS k, count(*) AS n } WITH k, n WHERE n > 55 RETURN k, n", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 55"),
    # -- projections --
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c.c_custkey AS k, count(*) AS n HAVING count(*) > 15 RETURN k, n", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "with_order_limit": ("MATCH (o:Orders) WITH o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10 RETURN k, p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10 OFFSET 5"),
    "return_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s, c.c_nationkey AS n", "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer"),
    "rollup": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, o.o_orderpriority AS p, count(*) AS n GROUP BY ROLLUP(o.o_orderstatus, o.o_orderpriority)", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)"),
    "cube": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, o.o_orderpriority AS p, count(*) AS n GROUP BY CUBE(o.o_orderstatus, o.o_orderpriority)", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)"),
    "grouping_sets": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, o.o_orderpriority AS p, count(*) AS n GROUP BY GROUPING SETS ((o.o_orderstatus), (o.o_orderpriority), ())", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "unwind_list": ("UNWIND [3, 1, 2] AS x WITH x, x * x AS y RETURN x, y", "SELECT x, x * x AS y FROM (SELECT unnest([3, 1, 2]) AS x)"),
    "unwind_collect": ("MATCH (n:Nation) WITH n.n_regionkey AS r, collect(n.n_nationkey) AS ks UNWIND ks AS k RETURN r, k", "SELECT n_regionkey AS r, n_nationkey AS k FROM nation"),
    "call_function": ("CALL range(1, 9, 2) AS x WHERE x > 2 RETURN x, x % 3 AS m", "SELECT x, x % 3 AS m FROM (SELECT unnest(range(1, 10, 2)) AS x) WHERE x > 2"),
    "union_all": ("MATCH (r:Region) RETURN r.r_name AS name UNION ALL MATCH (n:Nation) RETURN n.n_name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS k INTERSECT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "except_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS k EXCEPT ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    # -- aggregates --
    "aggs_basic": ("MATCH (l:Orders) RETURN l.o_orderstatus AS s, count(*) AS n, count(DISTINCT l.o_custkey) AS d, round(avg(l.o_totalprice), 4) AS a, min(l.o_totalprice) AS lo, max(l.o_totalprice) AS hi, round(stdev(l.o_totalprice), 4) AS sd, round(stdevp(l.o_totalprice), 4) AS sp", "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS d, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_pop(o_totalprice), 4) AS sp FROM orders GROUP BY 1"),
    "aggs_regr": ("MATCH ()-[l:CONTAINS]->() RETURN l.l_returnflag AS f, round(corr(l.l_extendedprice, l.l_quantity), 6) AS c, round(covar_pop(l.l_extendedprice, l.l_quantity), 2) AS p, round(covar_samp(l.l_extendedprice, l.l_quantity), 2) AS q, round(regr_slope(l.l_extendedprice, l.l_quantity), 4) AS sl, round(regr_intercept(l.l_extendedprice, l.l_quantity), 2) AS i, round(regr_r2(l.l_extendedprice, l.l_quantity), 6) AS r, round(regr_avgx(l.l_extendedprice, l.l_quantity), 4) AS ax, round(regr_avgy(l.l_extendedprice, l.l_quantity), 4) AS ay", "SELECT l_returnflag AS f, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS p, round(covar_samp(l_extendedprice, l_quantity), 2) AS q, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem GROUP BY 1"),
    "aggs_percentile": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, round(percentilecont(c.c_acctbal, 0.25), 4) AS q1, percentiledisc(c.c_acctbal, 0.5) AS med", "SELECT c_mktsegment AS s, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, quantile_disc(c_acctbal, 0.5) AS med FROM customer GROUP BY 1"),
    "aggs_filter": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, count(*) FILTER (WHERE o.o_totalprice > 200000) AS big, sum(o.o_custkey) FILTER (WHERE o.o_custkey < 100) AS k", "SELECT o_orderstatus AS s, count(*) FILTER (WHERE o_totalprice > 200000) AS big, CAST(sum(o_custkey) FILTER (WHERE o_custkey < 100) AS BIGINT) AS k FROM orders GROUP BY 1"),
    "aggs_global": ("MATCH (p:Part) RETURN count(*) AS n, sum(p.p_size) AS s, round(avg(p.p_retailprice), 4) AS a", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_retailprice), 4) AS a FROM part"),
    # -- windows --
    "window_rank": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS nt WINDOW w AS (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey)", "SELECT o_orderkey AS k, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    "window_lag_lead": ("MATCH (e:Event) RETURN e.event_id AS k, lag(e.event_id, 1) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS a, lead(e.event_id, 2) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS b, first_value(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS f", "SELECT event_id AS k, lag(event_id, 1) OVER w AS a, lead(event_id, 2) OVER w AS b, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "window_frame_rows": ("MATCH (e:Event) RETURN e.event_id AS k, round(sum(e.value) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n", "SELECT event_id AS k, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM events"),
    "window_groups": ("MATCH (p:Part) RETURN p.p_partkey AS k, count(*) OVER (PARTITION BY p.p_brand ORDER BY p.p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n", "SELECT p_partkey AS k, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part"),
    "window_exclude_current": ("MATCH (c:Customer) RETURN c.c_custkey AS k, count(c.c_acctbal) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n", "SELECT c_custkey AS k, count(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n FROM customer"),
    # -- variable length --
    "vle_1_3": ("MATCH (a:Event)-[e:NEXT*1..3]->(b:Event) RETURN length(e) AS hops, count(*) AS n", "WITH nx AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nid FROM events), e AS (SELECT * FROM nx WHERE nid IS NOT NULL) SELECT 1 AS hops, count(*) AS n FROM e UNION ALL SELECT 2, count(*) FROM e a JOIN e b ON a.nid = b.event_id UNION ALL SELECT 3, count(*) FROM e a JOIN e b ON a.nid = b.event_id JOIN e c ON b.nid = c.event_id"),
    "vle_bound_start": ("MATCH (a:Event {event_id: 7})-[e:NEXT*2..5]->(b:Event) RETURN b.event_id AS id, length(e) AS hops", "WITH RECURSIVE nx AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nid FROM events), t(id, hops) AS (SELECT nid, 1 FROM nx WHERE event_id = 7 AND nid IS NOT NULL UNION ALL SELECT nid, hops + 1 FROM t JOIN nx ON nx.event_id = t.id WHERE hops < 5 AND nid IS NOT NULL) SELECT id, hops FROM t WHERE hops >= 2"),
    "vle_unbounded": ("MATCH (s:Supplier)-[e*]->(x) RETURN s.s_suppkey AS k, label(x) AS kind, length(e) AS hops", "SELECT s_suppkey AS k, 'Nation' AS kind, 1 AS hops FROM supplier UNION ALL SELECT s_suppkey, 'Region', 2 FROM supplier"),
    "vle_undirected": ("MATCH (r:Region {r_regionkey: 1})-[e:IN_REGION*1..3]-(x) RETURN length(e) AS hops, count(*) AS n", "SELECT 1 AS hops, count(*) AS n FROM nation WHERE n_regionkey = 1"),
    # -- expressions --
    "str_funcs": ("MATCH (c:Customer) RETURN c.c_custkey AS k, toupper(c.c_name) AS u, tolower(c.c_mktsegment) AS l, substring(c.c_name, 2, 5) AS s, left(c.c_name, 3) AS a, right(c.c_name, 4) AS b, left(c.c_name, -2) AS d, reverse(c.c_name) AS r, replace(c.c_name, '0', '#') AS p, size(c.c_name) AS n, initcap(c.c_mktsegment) AS i, c.c_name + '/' + c.c_mktsegment AS j, md5(c.c_name) AS m", "SELECT c_custkey AS k, upper(c_name) AS u, lower(c_mktsegment) AS l, substring(c_name, 2, 5) AS s, left(c_name, 3) AS a, right(c_name, 4) AS b, left(c_name, length(c_name) - 2) AS d, reverse(c_name) AS r, replace(c_name, '0', '#') AS p, length(c_name) AS n, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i, c_name || '/' || c_mktsegment AS j, md5(c_name) AS m FROM customer"),
    "regex_like": ("MATCH (p:Part) WHERE p.p_name =~ '[a-e]' AND p.p_type ILIKE '%e%' AND NOT p.p_brand LIKE '%9' RETURN p.p_partkey AS k, p.p_name STARTS WITH 'p' AS a, p.p_name ENDS WITH '1' AS b, p.p_type CONTAINS 'A' AS c", "SELECT p_partkey AS k, starts_with(p_name, 'p') AS a, ends_with(p_name, '1') AS b, contains(p_type, 'A') AS c FROM part WHERE regexp_matches(p_name, '[a-e]') AND p_type ILIKE '%e%' AND NOT p_brand LIKE '%9'"),
    "hash_funcs": ("MATCH (r:Region) RETURN r.r_name AS n, sha256(r.r_name) AS h", "SELECT r_name AS n, sha256(r_name) AS h FROM region"),
    "math_funcs": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(sqrt(p.p_retailprice), 6) AS s, round(log(p.p_retailprice), 6) AS l, round(p.p_size ^ 2, 2) AS q, p.p_size / 7 AS d, p.p_size % 7 AS m, abs(-p.p_size) AS a, sign(p.p_retailprice) AS g, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, round(sin(p.p_size), 6) AS sn, round(cbrt(p.p_size), 6) AS cb, gcd(p.p_size, 12) AS gc, lcm(p.p_size, 12) AS lc", "SELECT p_partkey AS k, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(p_size ** 2, 2) AS q, p_size // 7 AS d, p_size % 7 AS m, abs(p_size) AS a, CAST(sign(p_retailprice) AS DOUBLE) AS g, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sin(p_size), 6) AS sn, round(cbrt(p_size), 6) AS cb, gcd(p_size, 12) AS gc, lcm(p_size, 12) AS lc FROM part"),
    "case_coalesce": ("MATCH (c:Customer) RETURN c.c_custkey AS k, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS a, CASE WHEN c.c_acctbal < 0 THEN 'neg' WHEN c.c_acctbal > 9000 THEN 'rich' ELSE 'mid' END AS b, coalesce(c.nothing, c.c_nationkey) AS d, c.c_nationkey IN [1, 2, 3] AS i, c.c_acctbal IS NULL AS z, c.c_nationkey = 1 XOR c.c_acctbal > 0 AS x", "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS a, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal > 9000 THEN 'rich' ELSE 'mid' END AS b, c_nationkey AS d, c_nationkey IN (1, 2, 3) AS i, c_acctbal IS NULL AS z, (c_nationkey = 1) <> (c_acctbal > 0) AS x FROM customer"),
    "casts": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_retailprice::int AS i, p.p_partkey::string AS s, '12'::int + 1 AS t, p.p_size::float / 4 AS f, 'true'::boolean AS b", "SELECT p_partkey AS k, CAST(round_even(p_retailprice, 0) AS BIGINT) AS i, CAST(p_partkey AS VARCHAR) AS s, 13 AS t, CAST(p_size AS DOUBLE) / 4 AS f, true AS b FROM part"),
    "lists": ("MATCH (r:Region) WITH r.r_regionkey AS k, range(0, r.r_regionkey + 3) AS l RETURN k, l[0] AS a, l[-1] AS z, l[9] AS none, size(l[1..3]) AS n, head(l) AS h, last(l) AS e, 2 IN l AS i, size(l + [7, 8]) AS c", "SELECT r_regionkey AS k, 0 AS a, r_regionkey + 3 AS z, NULL AS none, 2 AS n, 0 AS h, r_regionkey + 3 AS e, true AS i, r_regionkey + 6 AS c FROM region"),
    "maps": ("MATCH (r:Region) WITH r.r_name AS n, {a: r.r_regionkey, b: {c: r.r_name}} AS m RETURN n, m.a AS a, m.b.c AS c, m @> {a: 1} AS has, m ? 'a' AS key", "SELECT r_name AS n, r_regionkey AS a, r_name AS c, r_regionkey = 1 AS has, true AS key FROM region"),
    "json_props": ("MATCH (e:Event) RETURN e.props.k AS k, count(*) AS n", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "temporal_trunc": ("MATCH (o:Orders) RETURN date_trunc('month', o.o_orderdate) AS m, count(*) AS n", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1"),
    "temporal_extract": ("MATCH (o:Orders) RETURN extract(year FROM o.o_orderdate) AS y, extract(month FROM o.o_orderdate) AS m, extract(dow FROM o.o_orderdate) AS d, count(*) AS n", "SELECT CAST(extract(year FROM o_orderdate) AS DOUBLE) AS y, CAST(extract(month FROM o_orderdate) AS DOUBLE) AS m, CAST(extract(dow FROM o_orderdate) AS DOUBLE) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "temporal_bin": ("MATCH (e:Event) RETURN date_bin('15 minutes'::interval, e.ts, '2020-01-01 00:07:00'::timestamp) AS b, count(*) AS n", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2020-01-01 00:07:00') AS b, count(*) AS n FROM events GROUP BY 1"),
    "temporal_interval": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_orderdate + '3 days'::interval AS a, overlaps(o.o_orderdate, o.o_orderdate + '10 days'::interval, '1995-01-01'::timestamp, '1996-01-01'::timestamp) AS o", "SELECT o_orderkey AS k, o_orderdate + INTERVAL 3 DAY AS a, (o_orderdate < TIMESTAMP '1996-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 10 DAY) AS o FROM orders"),
    "range_overlap": ("MATCH (p:Part) RETURN p.p_partkey AS k, intrange(p.p_size, p.p_size + 5) && intrange(20, 30) AS o, intrange(10, 40) @> intrange(p.p_size, p.p_size + 5) AS c, intrange(10, 40, '[]') @> p.p_size AS e, intrange(0, 10) << intrange(p.p_size, p.p_size + 5) AS b", "SELECT p_partkey AS k, p_size < 30 AND 20 < p_size + 5 AS o, p_size >= 10 AND p_size + 5 <= 40 AS c, p_size BETWEEN 10 AND 40 AS e, p_size >= 10 AS b FROM part"),
    "tsearch_and_or": ("MATCH (d:Document) WHERE d.text::tsvector @@ 'the & (of | and) & !license' RETURN count(*) AS n", "WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS ws FROM documents) SELECT count(*) AS n FROM w WHERE list_contains(ws, 'the') AND (list_contains(ws, 'of') OR list_contains(ws, 'and')) AND NOT list_contains(ws, 'license')"),
    "tsearch_phrase": ("MATCH (d:Document) WHERE d.text::tsvector @@ 'of <-> the' RETURN count(*) AS n", "WITH w AS (SELECT ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents) SELECT count(*) AS n FROM w WHERE contains(t, ' of the ')"),
    "spatial_bbox": ("MATCH (c:Customer) WITH c.c_custkey AS k, point(c.c_nationkey, c.c_acctbal / 1000.0) AS p RETURN k, '(10,8),(3,1)'::box @> p AS inside, round(p <-> '(5,5)'::point, 6) AS d", "SELECT c_custkey AS k, c_nationkey BETWEEN 3 AND 10 AND c_acctbal / 1000 BETWEEN 1 AND 8 AS inside, round(sqrt((c_nationkey - 5) ** 2 + (c_acctbal / 1000 - 5) ** 2), 6) AS d FROM customer"),
    "spatial_geometry": ("MATCH (r:Region) WITH r.r_regionkey AS k, 'LINESTRING(0 0, 3 4, 3 10)'::geometry AS g RETURN k, ST_Length(g) AS l, ST_XMax(g) AS x, ST_YMax(ST_Translate(g, 1, k)) AS y, round(ST_XMax(ST_Rotate(g, pi() / 2)), 6) AS r", "SELECT r_regionkey AS k, 11::DOUBLE AS l, 3::DOUBLE AS x, 10::DOUBLE + r_regionkey AS y, 0::DOUBLE AS r FROM region"),
    "network": ("MATCH (c:Customer) WITH c.c_custkey AS k, ('10.0.' + (c.c_nationkey)::string + '.' + (c.c_custkey % 250)::string + '/24')::inet AS a RETURN k, host(a) AS h, masklen(a) AS m, network(a) AS n, a << '10.0.0.0/16'::inet AS w", "SELECT c_custkey AS k, '10.0.' || c_nationkey || '.' || c_custkey % 250 AS h, 24 AS m, '10.0.' || c_nationkey || '.0/24' AS n, true AS w FROM customer"),
    # -- vectors --
    "vec_topk_l2": ("MATCH (a:Vec {vec_id: 0}), (v:Vec) RETURN v.vec_id AS id, round(v.embedding <-> a.embedding, 5) AS d ORDER BY v.embedding <-> a.embedding, id LIMIT 10", "SELECT v.vec_id AS id, round(list_distance(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS d FROM embeddings a, embeddings v WHERE a.vec_id = 0 ORDER BY list_distance(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), id LIMIT 10"),
    "vec_topk_ip": ("MATCH (a:Vec {vec_id: 1}), (v:Vec) RETURN v.vec_id AS id, round(v.embedding <#> a.embedding, 5) AS d ORDER BY v.embedding <#> a.embedding, id LIMIT 10", "SELECT v.vec_id AS id, round(-list_inner_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS d FROM embeddings a, embeddings v WHERE a.vec_id = 1 ORDER BY -list_inner_product(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), id LIMIT 10"),
    "vec_topk_cosine": ("MATCH (a:Vec {vec_id: 2}), (v:Vec) RETURN v.vec_id AS id, round(v.embedding <=> a.embedding, 5) AS d ORDER BY v.embedding <=> a.embedding, id LIMIT 10", "SELECT v.vec_id AS id, round(list_cosine_distance(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS d FROM embeddings a, embeddings v WHERE a.vec_id = 2 ORDER BY list_cosine_distance(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), id LIMIT 10"),
    "vec_norms": ("MATCH (v:Vec) RETURN v.vec_id AS id, dims(v.embedding) AS n, round(norm(v.embedding), 5) AS l2, round(l1_distance(v.embedding, v.embedding), 5) AS z", "SELECT vec_id AS id, len(embedding) AS n, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS l2, 0::DOUBLE AS z FROM embeddings"),
    # -- further forms --
    "leading_with": ("WITH 3 AS k MATCH (n:Nation) WHERE n.n_regionkey = k RETURN n.n_name AS nation", "SELECT n_name AS nation FROM nation WHERE n_regionkey = 3"),
    "cypher_prefix": ("CYPHER MATCH (r:Region) RETURN r.r_name AS name", "SELECT r_name AS name FROM region"),
    "label_by_id": ("MATCH (c:Customer)-[e]->(x:Nation) RETURN type(e) AS t, count(*) AS n", "SELECT 'LIVES_IN' AS t, count(*) AS n FROM customer"),
    "vle_edge_property": ("MATCH (o:Orders)-[e:CONTAINS*1..2 {l_linenumber: 1}]->(x) RETURN length(e) AS hops, count(*) AS n", "SELECT 1 AS hops, count(*) AS n FROM lineitem WHERE l_linenumber = 1"),
    "vle_zero_length": ("MATCH (r:Region)-[e:IN_REGION*0..1]-(x) RETURN r.r_regionkey AS r, length(e) AS hops, count(*) AS n", "SELECT n_regionkey AS r, 1 AS hops, count(*) AS n FROM nation GROUP BY 1"),
    "group_by_distinct": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, count(*) AS n GROUP BY DISTINCT o.o_orderstatus", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "within_group": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c.c_acctbal), 4) AS q, percentile_disc(0.5) WITHIN GROUP (ORDER BY c.c_acctbal) AS m", "SELECT c_mktsegment AS s, round(quantile_cont(c_acctbal, 0.25), 4) AS q, quantile_disc(c_acctbal, 0.5) AS m FROM customer GROUP BY 1"),
    "aggs_lists": ("MATCH (n:Nation) RETURN n.n_regionkey AS r, size(array_agg(n.n_name)) AS a, size(collect(DISTINCT n.n_regionkey)) AS d, bool_and(n.n_nationkey < 20) AS b, bool_or(n.n_nationkey > 20) AS o, size(string_agg(n.n_name, ',')) AS l", "SELECT n_regionkey AS r, count(*) AS a, 1 AS d, bool_and(n_nationkey < 20) AS b, bool_or(n_nationkey > 20) AS o, length(string_agg(n_name, ',')) AS l FROM nation GROUP BY 1"),
    "aggs_empty": ("MATCH (n:Nation) WHERE n.n_name = 'nowhere' RETURN count(*) AS n, sum(n.n_nationkey) AS s, min(n.n_name) AS m, avg(n.n_nationkey) AS a, size(collect(n.n_name)) AS c", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, min(n_name) AS m, avg(n_nationkey) AS a, CAST(0 AS INTEGER) AS c FROM nation WHERE n_name = 'nowhere'"),
    "window_shares": ("MATCH (p:Part) RETURN p.p_partkey AS k, round(percent_rank() OVER w, 6) AS r, round(cume_dist() OVER w, 6) AS c WINDOW w AS (PARTITION BY p.p_brand ORDER BY p.p_size)", "SELECT p_partkey AS k, round(percent_rank() OVER w, 6) AS r, round(cume_dist() OVER w, 6) AS c FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)"),
    "window_nth": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, nth_value(o.o_orderkey, 2) OVER w AS b, first_value(o.o_orderkey) OVER w AS a, last_value(o.o_orderkey) OVER w AS z WINDOW w AS (PARTITION BY o.o_custkey ORDER BY o.o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "SELECT o_orderkey AS k, nth_value(o_orderkey, 2) OVER w AS b, first_value(o_orderkey) OVER w AS a, last_value(o_orderkey) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "window_range": ("MATCH (p:Part) RETURN p.p_partkey AS k, count(*) OVER (PARTITION BY p.p_brand ORDER BY p.p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n", "SELECT p_partkey AS k, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM part"),
    "window_exclude_rows": ("MATCH (p:Part) RETURN p.p_partkey AS k, max(p.p_size) OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS a, min(p.p_size) OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS b, sum(p.p_size) OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS c", "SELECT p_partkey AS k, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS a, min(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS b, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS BIGINT) AS c FROM part"),
    "order_using": ("MATCH (n:Nation) RETURN n.n_name AS k ORDER BY n.n_name USING > LIMIT 5", "SELECT n_name AS k FROM nation ORDER BY n_name DESC LIMIT 5"),
}

#: name: (SQL for the engine, SQL for DuckDB)
SQL: dict[str, tuple[str, str]] = {
    "sql_similar_between": ("SELECT p_partkey AS k, p_size BETWEEN SYMMETRIC 30 AND 10 AS b, p_brand SIMILAR TO 'Brand#(1|2)%' AS s FROM part", "SELECT p_partkey AS k, p_size BETWEEN 10 AND 30 AS b, regexp_full_match(p_brand, 'Brand#(1|2).*') AS s FROM part"),
    "sql_any_fetch": ("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') ORDER BY n_nationkey FETCH FIRST 7 ROWS ONLY", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') ORDER BY n_nationkey LIMIT 7"),
    "sql_recursive": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t"),
    "sql_joins": ("SELECT r_name AS r, count(DISTINCT c_custkey) AS c, count(DISTINCT s_suppkey) AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name", "SELECT r_name AS r, count(DISTINCT c_custkey) AS c, count(DISTINCT s_suppkey) AS s FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name"),
    "sql_lateral": ("SELECT c_custkey AS k, t.o_orderkey AS o FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t", "SELECT c_custkey AS k, t.o_orderkey AS o FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t"),
    "sql_pricing_summary": ("SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "sql_values": ("SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)"),
    "sql_tablesample": ("SELECT count(*) AS n FROM orders TABLESAMPLE BERNOULLI (100)", "SELECT count(*) AS n FROM orders"),
    "sql_series": ("SELECT n, c FROM generate_series(2, 11, 3) WITH ORDINALITY AS g(n, c)", "SELECT * FROM (VALUES (2, 1), (5, 2), (8, 3), (11, 4)) AS t(n, c)"),
    "sql_series_join": ("SELECT n_nationkey AS k, g AS g FROM nation, generate_series(1, 3) AS g WHERE g <> n_regionkey", "SELECT n_nationkey AS k, g::INTEGER AS g FROM nation, range(1, 4) AS t(g) WHERE g <> n_regionkey"),
    "sql_rows_from": ("SELECT a, b FROM ROWS FROM (generate_series(1, 3), unnest(ARRAY['x', 'y'])) AS t(a, b)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)"),
    "sql_distinct_on": ("SELECT DISTINCT ON (c_nationkey) c_nationkey AS n, c_custkey AS k FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey", "SELECT DISTINCT ON (c_nationkey) c_nationkey AS n, c_custkey AS k FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey"),
    "sql_with_ties": ("SELECT p_partkey AS k, p_size AS s FROM part ORDER BY s FETCH FIRST 5 ROWS WITH TIES", "SELECT p_partkey AS k, p_size AS s FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 5"),
    "sql_natural_using": ("SELECT n_nationkey AS k, r_name AS r, s.t FROM (SELECT n_nationkey, n_regionkey AS rk FROM nation) NATURAL JOIN (SELECT r_regionkey AS rk, r_name FROM region) LEFT JOIN (SELECT n_nationkey, count(*) AS t FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) s USING (n_nationkey)", "SELECT n_nationkey AS k, r_name AS r, s.t FROM (SELECT n_nationkey, n_regionkey AS rk FROM nation) NATURAL JOIN (SELECT r_regionkey AS rk, r_name FROM region) LEFT JOIN (SELECT n_nationkey, count(*) AS t FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) s USING (n_nationkey)"),
    "sql_right_full": ("SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT s.k, r_regionkey FROM (SELECT n_nationkey AS k, n_regionkey FROM nation WHERE n_nationkey > 9) s RIGHT JOIN region ON r_regionkey = s.n_regionkey) b ON a.k = b.k", "SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT s.k, r_regionkey FROM (SELECT n_nationkey AS k, n_regionkey FROM nation WHERE n_nationkey > 9) s RIGHT JOIN region ON r_regionkey = s.n_regionkey) b ON a.k = b.k"),
    "sql_any_all": ("SELECT c_custkey AS k, c_acctbal > ALL (SELECT s_acctbal FROM supplier) AS a, c_acctbal <= ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0) AS b, c_nationkey = ALL (SELECT n_nationkey FROM nation WHERE n_nationkey = 7) AS c, c_nationkey <> ANY (SELECT n_nationkey FROM nation WHERE n_nationkey = 7) AS d, c_nationkey < ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 99) AS e, c_nationkey > ANY (SELECT nullif(n_nationkey, 3) FROM nation) AS f FROM customer", "SELECT c_custkey AS k, c_acctbal > ALL (SELECT s_acctbal FROM supplier) AS a, c_acctbal <= ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0) AS b, c_nationkey = ALL (SELECT n_nationkey FROM nation WHERE n_nationkey = 7) AS c, c_nationkey <> ANY (SELECT n_nationkey FROM nation WHERE n_nationkey = 7) AS d, true AS e, CASE WHEN c_nationkey > 0 THEN true END AS f FROM customer"),
    "sql_null_tests": ("SELECT event_id AS k, nullif(event_type, 'view') ISNULL AS a, nullif(event_type, 'view') NOTNULL AS b, (value > 50) IS NOT TRUE AS c, nullif(event_type, 'view') IS DISTINCT FROM 'error' AS d FROM events", "SELECT event_id AS k, nullif(event_type, 'view') IS NULL AS a, nullif(event_type, 'view') IS NOT NULL AS b, coalesce(value <= 50, true) AS c, nullif(event_type, 'view') IS DISTINCT FROM 'error' AS d FROM events"),
    "sql_overlaps": ("SELECT o_orderkey AS k, (o_orderdate, o_orderdate) OVERLAPS (timestamp '1996-01-01', timestamp '1997-01-01') AS o FROM orders WHERE (date '2020-01-01', date '2020-02-01') OVERLAPS (date '2020-01-15', date '2020-03-01')", "SELECT o_orderkey AS k, o_orderdate < TIMESTAMP '1997-01-01' AND TIMESTAMP '1996-01-01' <= o_orderdate AS o FROM orders"),
    "sql_time_zone": ("SELECT o_orderkey AS k, o_orderdate AT TIME ZONE '+05:00' AS t, timestamp '2020-06-01 12:00:00' AT TIME ZONE '+02:00' AS u FROM orders", "SELECT o_orderkey AS k, o_orderdate + INTERVAL 5 HOUR AS t, TIMESTAMP '2020-06-01 10:00:00' AS u FROM orders"),
    "sql_current": ("SELECT current_date IS NOT NULL AS d, current_timestamp >= localtimestamp AS t, current_user IS NOT NULL AS u", "SELECT true AS d, true AS t, true AS u"),
    "sql_scalar_row": ("SELECT r_regionkey AS k, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS m, size(ARRAY(SELECT n_name FROM nation)) AS a, (r_regionkey, r_name) = (1, 'AMERICA') AS w FROM region", "SELECT r_regionkey AS k, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS m, 25 AS a, r_regionkey = 1 AND r_name = 'AMERICA' AS w FROM region"),
    "sql_collate_using": ("SELECT n_name AS n FROM nation ORDER BY n_name COLLATE \"C\" USING > LIMIT 3", "SELECT n_name AS n FROM nation ORDER BY n_name DESC LIMIT 3"),
}


def updated(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs statements on the trade graph in order; the last one gives the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        out = None
        for s in statements:
            out = e.run(s)
        return out

    return run


def session(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    """As updated(), with the tables that the statements name as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if any(re.search(rf"\b{t}\b", s) for s in statements):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return updated(*statements)(spark, sf_dir)

    return run


def copy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO and COPY FROM over the session's shared folder."""
    path = shared_folder(spark)
    return session("CREATE TABLE copied AS SELECT n_nationkey AS k, n_name AS v FROM nation", f"COPY (SELECT k + 100 AS k, v FROM copied) TO '{path}' WITH (FORMAT csv, HEADER)", f"COPY copied FROM '{path}' WITH (FORMAT csv, HEADER)", "SELECT k, v FROM copied")(spark, sf_dir)


UPDATES: dict[str, tuple[Callable, str]] = {
    "update_eager": (updated("MATCH (n:Nation) CREATE (:Copy {k: n.n_nationkey})", "MATCH (n:Copy) CREATE (:Copy {k: n.k + 100})", "MATCH (n:Copy) RETURN n.k AS k"), "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation"),
    "property_containment": (updated("MATCH (r:Region) CREATE (:Box {k: r.r_regionkey, l: [r.r_regionkey, 7, 9]})", "MATCH (b:Box {l: [9, 3]}) RETURN b.k AS k"), "SELECT r_regionkey AS k FROM region WHERE r_regionkey = 3"),
    "graph_ddl": (updated("CREATE GRAPH other", "USE GRAPH other", "SELECT create_vlabel('other', 'A')", "SELECT create_elabel('other', 'E')", "UNWIND [1, 2, 3] AS i CREATE (:A {k: i})", "MATCH (a:A {k: 1}), (b:A) WHERE b.k > 1 CREATE (a)-[:E {w: b.k}]->(b)", "CREATE GRAPH gone", "DROP GRAPH gone CASCADE", "MATCH (a:A)-[e:E]->(b:A) RETURN a.k AS a, e.w AS w, b.k AS b"), "SELECT * FROM (VALUES (1, 2, 2), (1, 3, 3)) AS t(a, w, b)"),
    "label_ddl": (updated("SELECT create_vlabel('trade', 'Spare')", "SELECT create_unique_properties_constraint('trade', 'Spare', 'k')", "SELECT create_property_index('trade', 'Spare', 'k')", "MATCH (n:Nation) CREATE (:Spare {k: n.n_nationkey})", "SELECT create_vlabel('trade', 'Brief')", "SELECT drop_label('trade', 'Brief')", "MATCH (s:Spare) RETURN s.k AS k"), "SELECT n_nationkey AS k FROM nation"),
    "prepared": (session("PREPARE p AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2", "EXECUTE p(2, 8)"), "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8"),
    "cursor": (session("DECLARE c CURSOR FOR SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey", "FETCH 3 FROM c", "FETCH 7 FROM c"), "SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 3"),
    "dml": (session("CREATE TABLE changed AS SELECT n_nationkey AS k, n_name AS v FROM nation", "UPDATE changed SET v = 'x' WHERE k < 5", "DELETE FROM changed WHERE k > 20", "INSERT INTO changed VALUES (99, 'new')", "INSERT INTO changed (k, v) VALUES (3, 'y'), (98, 'z') ON CONFLICT (k) DO UPDATE SET v = excluded.v", "INSERT INTO changed (k, v) VALUES (4, 'no'), (97, 'w') ON CONFLICT (k) DO NOTHING", "SELECT k, v FROM changed"), "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'y' WHEN n_nationkey < 5 THEN 'x' ELSE n_name END AS v FROM nation WHERE n_nationkey <= 20 UNION ALL SELECT * FROM (VALUES (99, 'new'), (98, 'z'), (97, 'w'))"),
    "dml_returning": (session("CREATE TABLE given AS SELECT n_nationkey AS k, n_name AS v FROM nation", "UPDATE given SET v = concat(v, '!') WHERE k < 3 RETURNING k, v"), "SELECT n_nationkey AS k, n_name || '!' AS v FROM nation WHERE n_nationkey < 3"),
    "truncate_view": (session("CREATE TABLE emptied AS SELECT n_nationkey AS k FROM nation", "CREATE VIEW seen AS SELECT count(*) AS n FROM nation", "TRUNCATE emptied", "SELECT n, (SELECT count(*) FROM emptied) AS z FROM seen"), "SELECT count(*) AS n, 0 AS z FROM nation"),
    "copy": (copy_round_trip, "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation"),
    "create_function": (session("CREATE FUNCTION plus_twice(a int, b int) RETURNS int LANGUAGE sql AS 'SELECT a + 2 * b'", "SELECT n_nationkey AS k, plus_twice(n_nationkey, n_regionkey) AS s FROM nation"), "SELECT n_nationkey AS k, n_nationkey + 2 * n_regionkey AS s FROM nation"),
    "call_user_function": (updated("CREATE FUNCTION thrice(a int) RETURNS int RETURN 3 * $1", "MATCH (n:Nation) WHERE thrice(n.n_nationkey) > 60 RETURN n.n_nationkey AS k, thrice(n.n_nationkey) AS t"), "SELECT n_nationkey AS k, 3 * n_nationkey AS t FROM nation WHERE n_nationkey > 20"),
    "maintenance": (session("VACUUM nation", "ANALYZE nation"), "SELECT 'analyze' AS done"),
    "update_create": (updated("MATCH (n:Nation) WHERE n.n_nationkey < 3 CREATE (n)-[:HOSTS {since: n.n_nationkey + 2000}]->(x:Fair {name: n.n_name})", "MATCH (n:Nation)-[h:HOSTS]->(x:Fair) RETURN n.n_nationkey AS k, h.since AS since, x.name AS name"), "SELECT n_nationkey AS k, n_nationkey + 2000 AS since, n_name AS name FROM nation WHERE n_nationkey < 3"),
    "update_set": (updated("MATCH (s:Supplier) WHERE s.s_acctbal < 0 SET s.s_acctbal = 0.0, s.risky = true", "MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.s_acctbal AS b, s.risky AS r"), "SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS b, CASE WHEN s_acctbal < 0 THEN true END AS r FROM supplier"),
    "update_remove": (updated("MATCH (n:Nation) WHERE n.n_nationkey > 20 REMOVE n.n_name", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name"), "SELECT n_nationkey AS k, CASE WHEN n_nationkey <= 20 THEN n_name END AS name FROM nation"),
    "update_detach_delete": (updated("MATCH (n:Nation) WHERE n.n_regionkey = 0 DETACH DELETE n", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_nationkey AS k, count(*) AS n"), "SELECT n_nationkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY 1"),
    "update_merge": (updated("MATCH (c:Customer) MERGE (s:Segment {name: c.c_mktsegment})", "MERGE (s:Segment {name: 'BUILDING'})", "MERGE (s:Segment {name: 'SPACE'})", "MATCH (s:Segment) RETURN s.name AS name, count(*) AS n"), "SELECT DISTINCT c_mktsegment AS name, 1 AS n FROM customer UNION ALL SELECT 'SPACE', 1"),
}


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of vector 0 by an index of 20 lists, all of them probed, so that the result is exact."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    q = df.where("vec_id = 0").first()["embedding"]
    return IvfIndex(df, "embedding", 20).search(q, 10, probes=20).select("vec_id", F.round("distance", 5).alias("d"))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50, against all rows; whether an index of 20 lists, 12 of them probed, finds nine tenths of their true 10 nearest."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = IvfIndex(df, "embedding", 20)
    found, true = (index.search_all(asked, 10, probes).select("query_id", "vec_id") for probes in (12, 20))
    hits = true.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def exact_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    q = df.where("vec_id = 3").first()["embedding"]
    return top_k(df, "embedding", q, 10, "l1").select("vec_id", F.round("distance", 4).alias("d"))


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import bucket_counts_batch

    return bucket_counts_batch(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: graph(q) for n, (q, _) in GRAPH.items()} | {n: relational(q) for n, (q, _) in SQL.items()} | {n: f for n, (f, _) in UPDATES.items()} | {"ivf_search": ivf_search, "ivf_recall": ivf_recall, "vec_topk_l1": exact_l1, "stream_buckets": stream_buckets}
ORACLE_SQL: dict[str, str] = {n: o for n, (_, o) in GRAPH.items() if o} | {n: o for n, (_, o) in SQL.items()} | {n: o for n, (_, o) in UPDATES.items()} | {
    "ivf_search": "SELECT v.vec_id, round(list_distance(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS d FROM embeddings a, embeddings v WHERE a.vec_id = 0 ORDER BY list_distance(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), v.vec_id LIMIT 10",
    "ivf_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "vec_topk_l1": "SELECT v.vec_id, round(list_sum([abs(v.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE) FOR i IN range(1, len(a.embedding) + 1)]), 4) AS d FROM embeddings a, embeddings v WHERE a.vec_id = 3 ORDER BY list_sum([abs(v.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE) FOR i IN range(1, len(a.embedding) + 1)]), v.vec_id LIMIT 10",
    "stream_buckets": "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
