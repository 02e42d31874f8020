"""Graph queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.graph import PropertyGraph, warehouse_graph


@dataclass
class Entry:
    """cypher: the query, or several of which all but the last update a graph of their own; rounded: result columns whose last digits depend on the order of additions."""

    cypher: str | list[str]
    sql: str
    params: dict = field(default_factory=dict)
    rounded: tuple[str, ...] = ()
    sorted_lists: tuple[str, ...] = ()


_graphs: dict[tuple[str, str], PropertyGraph] = {}


def declared(spark: SparkSession, folder: str) -> PropertyGraph:
    """The graph over a folder's tables, declared once for a session: it holds plans, no rows, and never changes."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _graphs:
        _graphs[key] = warehouse_graph(spark, folder)
    return _graphs[key]


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = declared(spark, sf_dir)
        *updates, last = [entry.cypher] if isinstance(entry.cypher, str) else entry.cypher
        for update in updates:
            _, graph = graph.execute(update, **entry.params)
        out = graph.cypher(last, **entry.params)
        out = out.withColumns({c: F.round(c, 2) for c in entry.rounded}) if entry.rounded else out
        return out.withColumns({c: F.array_sort(c) for c in entry.sorted_lists}) if entry.sorted_lists else out

    return run


TURNS = "t AS (SELECT conv_id, turn, conv_id * 65536 + turn AS k FROM conversations)"
TRAILS = f"""WITH RECURSIVE {TURNS}, w AS (
    SELECT conv_id, turn, k, 0 AS hops FROM t WHERE turn = 0
    UNION ALL SELECT w.conv_id, n.turn, n.k, w.hops + 1 FROM w JOIN t n ON n.k = w.k + 1 WHERE w.hops < {{most}}
)"""

ENTRIES: dict[str, Entry] = {
    "nation_customers": Entry(
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.acctbal > 0 RETURN n.name AS nation, count(*) AS customers ORDER BY customers DESC, nation LIMIT 10",
        "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "all_nodes_count": Entry(
        "MATCH (n) RETURN count(n) AS nodes",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS nodes",
    ),
    "label_scan_filter": Entry("MATCH (p:Part) WHERE p.size > 40 RETURN p.name AS name, p.size AS size", "SELECT p_name AS name, p_size::BIGINT AS size FROM part WHERE p_size > 40"),
    "index_seek": Entry("MATCH (p:Part {partkey: $k}) RETURN p.name AS name", "SELECT p_name AS name FROM part WHERE p_partkey = 17", {"k": 17}),
    "index_range_seek": Entry("MATCH (o:Order) WHERE 100 <= o.orderkey < 160 RETURN o.orderkey AS k, o.orderpriority AS p", "SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 160"),
    "string_predicates": Entry(
        "MATCH (p:Part) WHERE p.type STARTS WITH 'E' OR p.name CONTAINS '7' AND NOT p.brand ENDS WITH '3' RETURN p.partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE starts_with(p_type, 'E') OR contains(p_name, '7') AND NOT ends_with(p_brand, '3')",
    ),
    "rel_type_scan": Entry("MATCH ()-[r:IN_NATION|IN_REGION]->() RETURN type(r) AS t, count(*) AS c", "SELECT 'IN_REGION' AS t, count(*) AS c FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"),
    "rel_index_seek": Entry("MATCH (o)-[l:CONTAINS {quantity: 50.0}]->(p:Part) RETURN p.brand AS brand, count(l) AS lines", "SELECT p_brand AS brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50 GROUP BY 1"),
    "rel_index_range_seek": Entry("MATCH ()-[l:CONTAINS]->() WHERE l.discount > 0.05 AND l.discount <= 0.07 RETURN l.returnflag AS flag, count(*) AS c", "SELECT l_returnflag AS flag, count(*) AS c FROM lineitem WHERE l_discount > 0.05 AND l_discount <= 0.07 GROUP BY 1"),
    "expand_out": Entry("MATCH (c:Customer {mktsegment: 'BUILDING'})-[:IN_NATION]->(n) RETURN c.custkey AS c, n.name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "expand_in": Entry("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS n, s.name AS s", "SELECT n_name AS n, s_name AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "expand_both": Entry(
        "MATCH (n:Nation)-[r]-(x) RETURN n.name AS n, type(r) AS t, count(x) AS c",
        "SELECT n_name AS n, t, count(*) AS c FROM nation JOIN (SELECT n_nationkey AS k, 'IN_REGION' AS t FROM nation UNION ALL SELECT c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT s_nationkey, 'IN_NATION' FROM supplier) x ON k = n_nationkey GROUP BY 1, 2",
    ),
    "two_hop_agg": Entry(
        "MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN r.name AS region, count(*) AS customers, min(c.acctbal) AS low, max(c.acctbal) AS high",
        "SELECT r_name AS region, count(*) AS customers, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "rel_props_agg": Entry(
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN p.brand AS brand, sum(l.quantity) AS quantity, count(DISTINCT o) AS orders",
        "SELECT p_brand AS brand, sum(l_quantity) AS quantity, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
    "four_hop_revenue": Entry(
        "MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.size < 20 RETURN n.name AS nation, sum(l.extendedprice * (1 - l.discount)) AS revenue ORDER BY revenue DESC",
        "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'ASIA' AND p_size < 20 GROUP BY 1",
        rounded=("revenue",),
    ),
    "uniqueness": Entry("MATCH (a:Customer)-[:IN_NATION]->(n:Nation {nationkey: 3})<-[:IN_NATION]-(b:Customer) RETURN count(*) AS pairs", "SELECT count(*) AS pairs FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey WHERE a.c_nationkey = 3"),
    "expand_into": Entry(
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:SUPPLIED]-(s:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(c) WHERE p.size = 1 RETURN n.name AS nation, count(*) AS c",
        "SELECT n_name AS nation, count(*) AS c FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN part ON p_partkey = a.l_partkey JOIN lineitem b ON b.l_partkey = p_partkey JOIN supplier ON s_suppkey = b.l_suppkey JOIN nation ON n_nationkey = s_nationkey AND n_nationkey = c_nationkey WHERE p_size = 1 GROUP BY 1",
    ),
    "node_hash_join": Entry(
        "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier), (n)<-[:IN_NATION]-(c:Customer) WHERE s.acctbal > 5000 AND c.acctbal > 9000 RETURN n.name AS n, count(*) AS c",
        "SELECT n_name AS n, count(*) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey WHERE s_acctbal > 5000 AND c_acctbal > 9000 GROUP BY 1",
    ),
    "value_join": Entry("MATCH (c:Customer), (s:Supplier) WHERE c.nationkey = s.nationkey AND c.acctbal > 9000 RETURN c.custkey AS c, s.suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000"),
    "theta_join": Entry("MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey <> b.regionkey RETURN count(*) AS c", "SELECT count(*) AS c FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey"),
    "cartesian": Entry("MATCH (r:Region), (n:Nation) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation"),
    "optional_match": Entry(
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 9000 RETURN n.name AS n, count(s) AS c, max(s.acctbal) AS m",
        "SELECT n_name AS n, count(s_suppkey) AS c, max(s_acctbal) AS m FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1",
    ),
    "exists_semi": Entry("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order {orderstatus: 'F'}) } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "not_exists_anti": Entry(
        "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 450000 } AND c.acctbal > 0 RETURN c.custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "exists_skip_limit": Entry(
        "MATCH (c:Customer) RETURN c.custkey AS k, EXISTS { MATCH (c)-[:PLACED]->(o) RETURN o SKIP 12 } AS many, EXISTS { MATCH (c)-[:PLACED]->(o) RETURN o LIMIT 0 } AS none",
        "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12 AS many, false AS none FROM customer",
    ),
    "exists_with_limit": Entry(
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o) WITH o ORDER BY o.totalprice DESC, o.orderkey SKIP 1 LIMIT 2 WHERE o.orderstatus = 'F' RETURN o } RETURN c.custkey AS k",
        "SELECT DISTINCT o_custkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n BETWEEN 2 AND 3 AND o_orderstatus = 'F'",
    ),
    "exists_union": Entry(
        "MATCH (n:Nation) WHERE NOT EXISTS { MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 9000 RETURN s.name AS x UNION MATCH (n)-[:IN_REGION]->(r:Region {name: 'ASIA'}) RETURN r.name AS x } RETURN n.name AS n",
        "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
    ),
    "exists_aggregate": Entry(
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order {orderstatus: 'F'}) WITH count(*) AS n, max(o.totalprice) AS high WHERE n = 0 OR high > 490000 RETURN n } RETURN c.custkey AS k, EXISTS { MATCH (c)-[:PLACED]->(:Order {orderpriority: 'none such'}) RETURN count(*) } AS always",
        "SELECT c_custkey AS k, true AS always FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1 HAVING count(o_orderkey) = 0 OR max(o_totalprice) > 490000",
    ),
    "exists_projection": Entry(
        "MATCH (n:Nation) RETURN n.name AS n, EXISTS { MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 8000 RETURN 1 } AS rich, EXISTS { (n)-[:IN_REGION]->(:Region {name: 'ASIA'}) } OR n.nationkey < 3 AS near",
        "SELECT n_name AS n, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) AS rich, (n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') OR n_nationkey < 3) AS near FROM nation",
    ),
    "pattern_comprehension": Entry(
        "MATCH (n:Nation) RETURN n.name AS n, size([(n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 0 | s.name]) AS c, [(n)-[:IN_REGION]->(r) | r.name] AS regions",
        "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS c, [r_name] AS regions FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "optional_anti_agg": Entry(
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE NOT EXISTS { (n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 9500 } OPTIONAL MATCH (n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 9000 RETURN r.name AS region, count(c) AS rich",
        "SELECT r_name AS region, count(c_custkey) AS rich FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9500) GROUP BY 1",
    ),
    "agg_suite": Entry(
        "MATCH (o:Order) RETURN o.orderstatus AS s, count(*) AS c, count(DISTINCT o.orderpriority) AS p, sum(o.totalprice) AS total, avg(o.totalprice) AS mean, min(o.totalprice) AS low, max(o.totalprice) AS high, percentileCont(o.totalprice, 0.25) AS cont, percentileDisc(o.orderkey, 0.5) AS disc",
        "SELECT o_orderstatus AS s, count(*) AS c, count(DISTINCT o_orderpriority) AS p, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, round(quantile_cont(o_totalprice, 0.25), 2) AS cont, quantile_disc(o_orderkey, 0.5)::BIGINT AS disc FROM orders GROUP BY 1",
        rounded=("total", "mean", "cont"),
    ),
    "agg_empty": Entry("MATCH (o:Order) WHERE o.totalprice < -1 RETURN count(*) AS c, sum(o.orderkey) AS s, avg(o.totalprice) AS a, collect(o.orderkey) AS l, max(o.orderkey) AS m", "SELECT 0::BIGINT AS c, 0::BIGINT AS s, NULL::DOUBLE AS a, []::BIGINT[] AS l, NULL::BIGINT AS m"),
    "agg_expression": Entry(
        "MATCH (c:Customer) RETURN c.mktsegment AS seg, sum(c.acctbal) / count(*) AS r, 1 + count(*) * 2 AS n ORDER BY count(*) DESC, seg",
        "SELECT c_mktsegment AS seg, round(sum(c_acctbal) / count(*), 2) AS r, 1 + count(*) * 2 AS n FROM customer GROUP BY 1",
        rounded=("r",),
    ),
    "collect_lists": Entry("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS r, collect(n.name) AS names, collect(DISTINCT n.nationkey % 2) AS parity", "SELECT r_name AS r, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT (n_nationkey % 2)::BIGINT)) AS parity FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", sorted_lists=("names", "parity")),
    "distinct_rows": Entry("MATCH (p:Part) RETURN DISTINCT p.brand AS b, p.size % 5 AS s", "SELECT DISTINCT p_brand AS b, (p_size % 5)::BIGINT AS s FROM part"),
    "union_distinct": Entry("MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": Entry("MATCH (r:Region) RETURN r.name AS x UNION ALL MATCH (n:Nation) RETURN n.name AS x", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation"),
    "with_having": Entry("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, count(*) AS k WHERE k > 50 RETURN n.name AS n, k", "SELECT n_name AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 50"),
    "with_pipeline": Entry(
        "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 20 MATCH (c)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.totalprice) AS t RETURN c.custkey AS k, n, t",
        "SELECT c_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        rounded=("t",),
    ),
    "sort_skip_limit": Entry("MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY p DESC, k SKIP 10 LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 10"),
    "unwind_range": Entry("UNWIND range(1, 10) AS x WITH x WHERE x % 3 <> 0 RETURN x, range(x, 1, -2) AS down, [y IN range(1, x) WHERE y % 2 = 0 | y * y] AS squares", "SELECT x, list_reverse(range(x - 2 * ((x - 1) // 2), x + 1, 2)) AS down, list_transform(list_filter(range(1, x + 1), lambda y: y % 2 = 0), lambda y: y * y) AS squares FROM (SELECT unnest(range(1, 11)) AS x) WHERE x % 3 <> 0"),
    "list_ops": Entry(
        "UNWIND [[1, 2, 3], [4], []] AS l RETURN l, size(l) AS n, head(l) AS h, last(l) AS z, tail(l) AS t, reverse(l) AS r, l + 9 AS a, l[0..2] AS s, 4 IN l AS has",
        "SELECT l, len(l) AS n, l[1] AS h, l[-1] AS z, l[2:] AS t, list_reverse(l) AS r, list_append(l, 9) AS a, l[1:2] AS s, list_contains(l, 4) AS has FROM (SELECT unnest([[1, 2, 3], [4], []]::BIGINT[][]) AS l)",
    ),
    "quantifiers": Entry(
        "MATCH (p:Part) WITH p, [p.size, p.partkey, 25] AS l RETURN all(x IN l WHERE x > 5) AS a, any(x IN l WHERE x = 7) AS b, none(x IN l WHERE x > 45) AS c, single(x IN l WHERE x < 20) AS d, count(*) AS n",
        "SELECT p_size > 5 AND p_partkey > 5 AS a, p_size = 7 OR p_partkey = 7 AS b, NOT (p_size > 45 OR p_partkey > 45) AS c, ((p_size < 20)::INT + (p_partkey < 20)::INT) = 1 AS d, count(*) AS n FROM part GROUP BY 1, 2, 3, 4",
    ),
    "case_expressions": Entry(
        "MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'some' ELSE 'rich' END AS band, CASE c.mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code, count(*) AS n",
        "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END::BIGINT AS code, count(*) AS n FROM customer GROUP BY 1, 2",
    ),
    "null_logic": Entry(
        "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS n, a = b AS e, a IS NULL AS u",
        "SELECT a, b, a AND b AS x, a OR b AS y, a <> b AS z, NOT a AS n, a = b AS e, a IS NULL AS u FROM (SELECT unnest([true, false, null]) AS a), (SELECT unnest([true, false, null]) AS b)",
    ),
    "math_functions": Entry(
        "MATCH (s:Supplier) RETURN s.suppkey AS k, abs(s.acctbal) AS a, ceil(s.acctbal) AS c, sign(s.acctbal) AS g, sqrt(s.suppkey) AS q, s.suppkey / 7 AS d, s.suppkey % 7 AS m, s.suppkey ^ 2 AS p, -s.suppkey AS n",
        "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal)::DOUBLE AS c, sign(s_acctbal)::BIGINT AS g, round(sqrt(s_suppkey), 2) AS q, s_suppkey // 7 AS d, s_suppkey % 7 AS m, (s_suppkey * s_suppkey)::DOUBLE AS p, -s_suppkey AS n FROM supplier",
        rounded=("q",),
    ),
    "string_functions": Entry(
        "MATCH (p:Part) RETURN p.partkey AS k, toUpper(p.name) AS u, substring(p.name, 1, 3) AS s, reverse(p.brand) AS r, split(p.type, ' ') AS w, size(p.name) AS n, toString(p.size) AS t, toInteger(substring(p.brand, size(p.brand) - 1)) AS i, trim('  x ') + p.brand AS c",
        "SELECT p_partkey AS k, upper(p_name) AS u, substr(p_name, 2, 3) AS s, reverse(p_brand) AS r, string_split(p_type, ' ') AS w, length(p_name) AS n, p_size::VARCHAR AS t, TRY_CAST(substr(p_brand, length(p_brand)) AS BIGINT) AS i, 'x' || p_brand AS c FROM part",
    ),
    "conversions": Entry(
        "UNWIND ['12', '-3', '1.5', 'x', ''] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, coalesce(toInteger(s), -1) AS c, isEmpty(s) AS e",
        "SELECT s, CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN s::BIGINT END AS i, TRY_CAST(s AS DOUBLE) AS f, CASE s WHEN 'true' THEN true WHEN 'false' THEN false END AS b, coalesce(CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN s::BIGINT END, -1) AS c, s = '' AS e FROM (SELECT unnest(['12', '-3', '1.5', 'x', '']) AS s)",
    ),
    "entity_functions": Entry(
        "MATCH (n:Nation {nationkey: 4})-[r:IN_REGION]->(g) RETURN labels(n) AS l, type(r) AS t, keys(g) AS k, id(n) = id(startNode(r)) AS s, endNode(r).name = g.name AS e, n:Nation AS a, g:Nation AS b",
        "SELECT ['Nation'] AS l, 'IN_REGION' AS t, ['name', 'regionkey'] AS k, true AS s, true AS e, true AS a, false AS b",
    ),
    "varlen_bounded": Entry("MATCH (a:Turn {turn: 0})-[r:NEXT*1..3]->(b) RETURN a.conv_id AS c, b.turn AS t, size(r) AS hops", TRAILS.format(most=3) + " SELECT conv_id AS c, turn AS t, hops::BIGINT AS hops FROM w WHERE hops >= 1"),
    "varlen_zero": Entry("MATCH (a:Turn {turn: 0})-[r:NEXT*0..2]->(b) RETURN a.conv_id AS c, b.turn AS t, size(r) AS hops", TRAILS.format(most=2) + " SELECT conv_id AS c, turn AS t, hops::BIGINT AS hops FROM w"),
    "varlen_both": Entry(
        "MATCH (a:Nation)-[r:IN_REGION*2..2]-(b) WHERE a.nationkey % 2 = 0 RETURN a.name AS a, b.name AS b, size(r) AS n",
        "SELECT a.n_name AS a, b.n_name AS b, 2::BIGINT AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey % 2 = 0",
    ),
    "varlen_unbounded": Entry(
        "MATCH (a:Turn {turn: 0})-[r:NEXT*]->(b) RETURN a.conv_id AS c, max(size(r)) AS longest",
        "SELECT conv_id AS c, max(turn)::BIGINT AS longest FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE turn >= 0) WHERE turn = place GROUP BY 1 HAVING max(turn) >= 1",
    ),
    "named_path": Entry(
        "MATCH p = (a:Turn {turn: 0})-[:NEXT*2..3]->(b:Turn) RETURN length(p) AS len, nodes(p)[1].turn AS second, [x IN nodes(p) | x.turn] AS turns, size(relationships(p)) AS n, count(*) AS c",
        TRAILS.format(most=3) + " SELECT hops::BIGINT AS len, 1::BIGINT AS second, range(0, hops + 1) AS turns, hops::BIGINT AS n, count(*) AS c FROM w WHERE hops >= 2 GROUP BY hops",
    ),
    "path_single": Entry("MATCH p = (c:Customer {custkey: 5})-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN [x IN nodes(p) | x.name] AS names, [x IN relationships(p) | type(x)] AS types", "SELECT [c_name, n_name, r_name] AS names, ['IN_NATION', 'IN_REGION'] AS types FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 5"),
    "temporal_accessors": Entry(
        "MATCH (o:Order) RETURN o.orderdate.year AS y, o.orderdate.quarter AS q, o.orderdate.month AS m, o.orderdate.week AS w, o.orderdate.weekDay AS d, count(*) AS n",
        "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, week(o_orderdate) AS w, isodow(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4, 5",
    ),
    "temporal_truncate": Entry(
        "MATCH (o:Order) RETURN date.truncate('month', o.orderdate) AS m, date.truncate('decade', o.orderdate) AS d, date.truncate('week', o.orderdate) = date(o.orderdate) AS monday, count(*) AS n",
        "SELECT date_trunc('month', o_orderdate)::DATE AS m, date_trunc('decade', o_orderdate)::DATE AS d, date_trunc('week', o_orderdate)::DATE = o_orderdate::DATE AS monday, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    ),
    "temporal_duration": Entry(
        "MATCH (o:Order)-[l:CONTAINS]->() RETURN o.orderkey AS k, duration.inDays(o.orderdate, l.shipdate).days AS days, duration.inSeconds(o.orderdate, l.shipdate).seconds AS seconds",
        "SELECT o_orderkey AS k, trunc(epoch(l_shipdate - o_orderdate) / 86400)::BIGINT AS days, epoch(l_shipdate - o_orderdate)::BIGINT AS seconds FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    ),
    "temporal_literals": Entry(
        "RETURN date('2024-W09-4').day AS a, date({year: 2020, ordinalDay: 60}).month AS b, localdatetime('2015-07-21T21:40:32.142').millisecond AS c, duration('P1Y2M10DT2H30M').minutes AS d, time('12:50:35.556+01:00').offset AS e, datetime('2015-11-11T12:31:14+02:00').epochSeconds AS f, date('2020-01-01') < date('2020-01-02') AS g, duration.between(date('1984-10-11'), date('2015-06-24')).months AS h",
        "SELECT 29::BIGINT AS a, 2::BIGINT AS b, 142::BIGINT AS c, 150::BIGINT AS d, '+01:00' AS e, 1447237874::BIGINT AS f, true AS g, 368::BIGINT AS h",
    ),
    "procedures_labels": Entry("CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Customer', 'Document', 'Event', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'Turn', 'User']) AS label"),
    "procedures_types": Entry("CALL db.relationshipTypes() YIELD relationshipType AS t WHERE t STARTS WITH 'IN' RETURN t", "SELECT unnest(['IN_NATION', 'IN_REGION']) AS t"),
    "procedures_standalone": Entry("CALL db.relationshipTypes()", "SELECT unnest(['CONTAINS', 'DID', 'IN_NATION', 'IN_REGION', 'NEXT', 'PLACED', 'SUPPLIED']) AS \"relationshipType\""),
    "procedures_keys": Entry("CALL db.propertyKeys() YIELD propertyKey AS k WHERE k STARTS WITH 'o' OR k ENDS WITH 'name' RETURN k", "SELECT unnest(['name', 'orderdate', 'orderkey', 'orderpriority', 'orderstatus']) AS k"),
    "procedures_list": Entry("CALL dbms.procedures() YIELD name, mode RETURN name, mode", "SELECT unnest(['db.labels', 'db.propertyKeys', 'db.relationshipTypes', 'dbms.procedures']) AS name, 'READ' AS mode"),
    "clocks": Entry(
        "RETURN date.transaction() = date.statement() AS a, localtime.transaction() = localtime.statement() AS b, time.transaction() = time.statement() AS c, localdatetime.transaction() = localdatetime.statement() AS d, datetime.transaction() = datetime.statement() AS e, "
        "duration.inDays(date.statement(), date.realtime()).days IN [0, 1] AS f, duration.inSeconds(localdatetime.statement(), localdatetime.realtime()).seconds < 3600 AS g, datetime.realtime().epochSeconds >= datetime.statement().epochSeconds AS h, localtime.realtime().hour IN range(0, 23) AS i, time.realtime().offset = time.statement().offset AS j",
        "SELECT true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, true AS j",
    ),
    "rand_range": Entry("MATCH (p:Part) WITH p, rand() AS x RETURN min(x) >= 0 AND max(x) < 1 AS inside, count(DISTINCT x) > 1 AS several", "SELECT true AS inside, true AS several"),
    "lower_and_properties": Entry(
        "MATCH (g:Region)<-[r:IN_REGION]-(n:Nation) RETURN toLower(n.name) AS low, properties(g).name AS region, size(keys(properties(n))) AS size, keys(properties(r)) AS own",
        "SELECT lower(n_name) AS low, r_name AS region, 3::BIGINT AS size, []::VARCHAR[] AS own FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "literals_and_names": Entry("MATCH (`odd name`:Region) WHERE `odd name`.regionkey = 0x1 + 0o0 RETURN `odd name`.regionkey + 0x1F AS h, 017 AS o, 'tab\\t\\u0041' AS t, $p[1] AS p, $m.k AS m", "SELECT 32::BIGINT AS h, 15::BIGINT AS o, 'tab' || chr(9) || 'A' AS t, 6::BIGINT AS p, 'v' AS m", {"p": [5, 6], "m": {"k": "v"}}),
    "implicit_names": Entry("MATCH (r:Region) RETURN r.name, r.regionkey + 1", 'SELECT r_name AS "r.name", r_regionkey::BIGINT + 1 AS "r.regionkey + 1" FROM region'),
    "return_star": Entry("MATCH (r:Region) WITH r.name AS name, r.regionkey AS k RETURN *", "SELECT r_name AS name, r_regionkey::BIGINT AS k FROM region"),
    "user_events": Entry("MATCH (u:User)-[:DID]->(e:Event) WHERE e.value > 50 RETURN e.event_type AS t, count(DISTINCT u) AS users, count(e) AS events", "SELECT event_type AS t, count(DISTINCT user_id) AS users, count(*) AS events FROM events WHERE value > 50 GROUP BY 1"),
    "write_create_match": Entry(
        ["MATCH (r:Region) CREATE (c:Club {name: r.name, size: r.regionkey * 10})-[:LOCATED {since: 2000}]->(r)", "MATCH (c:Club)-[l:LOCATED]->(r:Region) WHERE l.since = 2000 RETURN c.name AS name, c.size AS size, r.regionkey AS k"],
        "SELECT r_name AS name, r_regionkey::BIGINT * 10 AS size, r_regionkey::BIGINT AS k FROM region",
    ),
    "write_set_remove": Entry(
        ["MATCH (n:Nation) WHERE n.regionkey = 2 SET n.name = 'asian', n:Chosen", "MATCH (n:Chosen) WHERE n.nationkey > 10 REMOVE n.name, n:Chosen", "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name, n:Chosen AS chosen"],
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey <> 2 THEN n_name WHEN n_nationkey <= 10 THEN 'asian' END AS name, n_regionkey = 2 AND n_nationkey <= 10 AS chosen FROM nation",
    ),
    "write_delete": Entry(
        ["MATCH (r:Region {regionkey: 1}) DETACH DELETE r", "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r) RETURN n.nationkey AS k, r.regionkey AS r"],
        "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey <> 1 THEN n_regionkey::BIGINT END AS r FROM nation",
    ),
    "write_merge": Entry(
        ["MATCH (s:Supplier) MERGE (b:Band {level: s.nationkey % 3}) ON CREATE SET b.made = true", "MATCH (n:Nation) MERGE (b:Band {level: n.nationkey % 5}) ON CREATE SET b.late = true ON MATCH SET b.again = true", "MATCH (b:Band) RETURN b.level AS level, b.made AS made, b.again AS again, b.late AS late, count(*) AS n"],
        """SELECT level, CASE WHEN s THEN true END AS made, CASE WHEN n > CASE WHEN s THEN 0 ELSE 1 END THEN true END AS again, CASE WHEN NOT s THEN true END AS late, 1::BIGINT AS n
        FROM (SELECT level, bool_or(k = 's') AS s, count(*) FILTER (k = 'n') AS n FROM (SELECT (s_nationkey % 3)::BIGINT AS level, 's' AS k FROM supplier UNION ALL SELECT (n_nationkey % 5)::BIGINT, 'n' FROM nation) GROUP BY 1)""",
    ),
    "write_delete_plain": Entry(
        ["MATCH ()-[r:IN_REGION]->(g:Region {name: 'ASIA'}) DELETE r", "MATCH (g:Region {name: 'ASIA'}) DELETE g", "MATCH (g:Region) OPTIONAL MATCH (g)<-[r:IN_REGION]-() RETURN g.name AS name, count(r) AS n"],
        "SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1",
    ),
    "write_set_map": Entry(
        ["MATCH (r:Region) WHERE r.regionkey < 2 SET r = {title: r.name, code: r.regionkey + 100}", "MATCH (r:Region) WHERE r.regionkey > 2 SET r += {code: 7, name: null}", "MATCH (r:Region) RETURN r.name AS name, r.title AS title, r.code AS code, r.regionkey AS k"],
        "SELECT CASE WHEN r_regionkey = 2 THEN r_name END AS name, CASE WHEN r_regionkey < 2 THEN r_name END AS title, CASE WHEN r_regionkey < 2 THEN r_regionkey::BIGINT + 100 WHEN r_regionkey > 2 THEN 7 END AS code, CASE WHEN r_regionkey >= 2 THEN r_regionkey::BIGINT END AS k FROM region",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(e) for name, e in ENTRIES.items()}
SQL: dict[str, str] = {name: e.sql for name, e in ENTRIES.items()}
