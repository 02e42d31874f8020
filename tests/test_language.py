"""The language, operator by operator: rows on a graph of the tests, values of expressions, and errors."""

import datetime as dt

import pytest
from pathloom.plans.ast import GraphQueryError
from pathloom.plans.parser import parse
from pathloom.sources.graph import PropertyGraph

from .harbours import harbours

SCANS = [
    ("MATCH (x) RETURN count(x) AS n", [(6,)]),
    ("MATCH (p:Port) RETURN p.name AS n ORDER BY n", [("Kobe",), ("Oslo",), ("Porto",)]),
    ("MATCH (t:Ship:Tug) RETURN t.name, t.tons", [("Selene", 0.25)]),
    ("MATCH (p:Port {depth: 9}) RETURN id(p)", [(11,)]),
    ("MATCH (p:Port) WHERE 9 < p.depth <= 14 RETURN p.name", [("Oslo",)]),
    ("MATCH ()-[c:CALLS {days: 7}]->(p) RETURN p.name", [("Porto",)]),
    ("MATCH ()-[r:ROUTE|SERVES]->() RETURN type(r) AS t, count(*) AS n ORDER BY t", [("ROUTE", 3), ("SERVES", 1)]),
]
EXPANSIONS = [
    ("MATCH (s:Ship)-[c:CALLS]->(p) RETURN s.name AS s, p.name AS p, c.days AS d ORDER BY d", [("Selene", "Porto", 1), ("Mira", "Oslo", 4), ("Mira", "Porto", 7)]),
    ("MATCH (p {name: 'Porto'})<-[:CALLS]-(s) RETURN s.name AS s ORDER BY s", [("Mira",), ("Selene",)]),
    ("MATCH (k {name: 'Kobe'})-[r:ROUTE]-(x) RETURN x.name AS x, r.miles AS m ORDER BY m", [("Kobe", 0.0), ("Porto", 21000.0)]),
    ("MATCH (a:Ship)-[:CALLS]->(p)<-[:CALLS]-(b:Ship) RETURN a.name AS a, b.name AS b ORDER BY a", [("Mira", "Selene"), ("Selene", "Mira")]),
    ("MATCH (s:Ship)-[:CALLS]->(a)-[:ROUTE]->(b)<-[:CALLS]-(s) RETURN s.name, a.name, b.name", [("Mira", "Oslo", "Porto")]),
    ("MATCH (a:Port)-[r:ROUTE*2]->(b) RETURN a.name AS a, b.name AS b ORDER BY a", [("Oslo", "Kobe"), ("Porto", "Kobe")]),
    ("MATCH (a {name: 'Oslo'})-[r:ROUTE*0..]->(b) RETURN b.name AS b, size(r) AS n ORDER BY n, b", [("Oslo", 0), ("Porto", 1), ("Kobe", 2), ("Kobe", 3)]),
    ("MATCH (c:Crane)-[r*1..2]->(b) RETURN b.name AS b, [x IN r | type(x)] AS t ORDER BY b", [("Oslo", ["SERVES"]), ("Porto", ["SERVES", "ROUTE"])]),
    ("MATCH (a:Port)-[:ROUTE*1..3 {miles: 21000.0}]->(b) RETURN a.name, b.name", [("Porto", "Kobe")]),
    ("MATCH (a {name: 'Oslo'}), (b {name: 'Kobe'}) WITH a, b MATCH (a)-[r:ROUTE*..3]->(b) RETURN size(r) AS n ORDER BY n", [(2,), (3,)]),
    ("MATCH w = (s {name: 'Selene'})-[:CALLS]->()-[:ROUTE*1..2]->(z) RETURN length(w) AS n, [x IN nodes(w) | x.name] AS names ORDER BY n", [(2, ["Selene", "Porto", "Kobe"]), (3, ["Selene", "Porto", "Kobe", "Kobe"])]),
    ("MATCH w = (z {name: 'Kobe'})<-[:ROUTE*2..2]-(a) RETURN [x IN nodes(w) | x.name] AS n, [x IN relationships(w) | x.miles] AS m ORDER BY n[2]", [(["Kobe", "Porto", "Oslo"], [21000.0, 2900.5]), (["Kobe", "Kobe", "Porto"], [0.0, 21000.0])]),
]
SUBQUERIES = [
    ("MATCH (p:Port) OPTIONAL MATCH (p)<-[c:CALLS]-(s {name: 'Mira'}) RETURN p.name AS p, c.days AS d ORDER BY p", [("Kobe", None), ("Oslo", 4), ("Porto", 7)]),
    ("MATCH (p:Port) OPTIONAL MATCH (p)<-[:CALLS]-(s) RETURN p.name AS p, count(s) AS n, sum(s.tons) AS t ORDER BY n, p", [("Kobe", 0, 0.0), ("Oslo", 1, 3.5), ("Porto", 2, 3.75)]),
    ("MATCH (p:Port) WHERE EXISTS { (p)<-[:CALLS]-(:Tug) } RETURN p.name", [("Porto",)]),
    ("MATCH (p:Port) WHERE NOT (p)<-[:CALLS]-() RETURN p.name", [("Kobe",)]),
    ("MATCH (p:Port) RETURN EXISTS { MATCH (p)-[r:ROUTE]->(q) WHERE r.miles > 5000 RETURN q } AS far, count(*) AS n ORDER BY far", [(False, 2), (True, 1)]),
    ("MATCH (p:Port) WHERE EXISTS { MATCH (p)<-[c:CALLS]-() RETURN c SKIP 1 } RETURN p.name", [("Porto",)]),
    ("MATCH (p:Port) WHERE EXISTS { MATCH (p)<-[c:CALLS]-() WITH c ORDER BY c.days LIMIT 1 WHERE c.days > 1 RETURN c } RETURN p.name", [("Oslo",)]),
    ("MATCH (p:Port) WHERE EXISTS { MATCH (p)<-[c:CALLS]-() WITH count(c) AS n WHERE n <> 1 RETURN n } RETURN p.name AS n ORDER BY n", [("Kobe",), ("Porto",)]),
    ("MATCH (p:Port) WHERE EXISTS { MATCH (p)<-[:SERVES]-(x) RETURN x UNION MATCH (p)<-[:CALLS]-(x:Tug) RETURN x } RETURN p.name AS n ORDER BY n", [("Oslo",), ("Porto",)]),
    ("RETURN EXISTS { MATCH (x:Crane) RETURN x LIMIT 0 } AS a, EXISTS { MATCH (x:Nothing) RETURN count(x) } AS b, EXISTS { MATCH (x:Nothing) RETURN x } AS c", [(False, True, False)]),
    ("MATCH (s:Ship) RETURN s.name AS s, size([(s)-[c:CALLS]->(p) WHERE c.days < 5 | p.name]) AS n ORDER BY s", [("Mira", 1), ("Selene", 1)]),
    ("MATCH ()-[r:SERVES]->() RETURN startNode(r).electric, endNode(r).name", [(True, "Oslo")]),
]
ROWS = [
    ("MATCH (p:Port) RETURN count(*), count(p.depth), sum(p.depth), avg(p.depth), min(p.name), max(p.depth)", [(3, 2, 23, 11.5, "Kobe", 14)]),
    ("MATCH (s:Ship)-[c:CALLS]->() RETURN s.name AS s, c.days % 3 AS d, c.days % 3 + count(*) AS n ORDER BY s", [("Mira", 1, 3), ("Selene", 1, 2)]),
    ("MATCH (x) RETURN x:Port AS port, 2 * count(*) AS n ORDER BY port", [(False, 6), (True, 6)]),
    ("MATCH (x) RETURN count(x.nothing), collect(x.nothing), sum(x.nothing), max(x.nothing)", [(0, [], 0, None)]),
    ("UNWIND [5, null, 5, 8] AS v RETURN count(DISTINCT v), collect(DISTINCT v), sum(DISTINCT v), avg(v)", [(2, [5, 8], 13, 6.0)]),
    ("UNWIND [12, 2, 6, 4] AS v RETURN percentileDisc(v, 0.75), percentileCont(v, 0.5)", [(6, 5.0)]),
    ("MATCH (p:Port) WITH p ORDER BY p.depth DESC SKIP 1 LIMIT 1 RETURN p.name AS n UNION ALL RETURN 'sea' AS n", [("Oslo",), ("sea",)]),
    ("MATCH (p:Port) RETURN p.depth AS d ORDER BY d", [(9,), (14,), (None,)]),
    ("MATCH (p:Port) RETURN p.depth AS d ORDER BY d DESC", [(None,), (14,), (9,)]),
    ("MATCH (s:Ship) RETURN labels(s) AS l, keys(s) AS k, properties(s).name AS n ORDER BY n", [(["Ship"], ["name", "tons"], "Mira"), (["Ship", "Tug"], ["name", "tons"], "Selene")]),
    ("UNWIND [[2, 3], []] AS l UNWIND l AS x RETURN x", [(2,), (3,)]),
    ("UNWIND 7 AS x RETURN x", []),
    ("UNWIND null AS x RETURN x", []),
    ("MATCH (x:Tug) RETURN *", [((21, ["Ship", "Tug"], (None, None, "Selene", 0.25)),)]),
    ("CALL db.labels() YIELD label AS l WHERE l < 'D' RETURN l", [("Crane",)]),
    ("CALL db.relationshipTypes()", [("CALLS",), ("ROUTE",), ("SERVES",)]),
    ("CALL db.propertyKeys() YIELD propertyKey RETURN count(*) AS n", [(6,)]),
    ("CALL dbms.procedures() YIELD name RETURN count(name) AS n", [(4,)]),
]

VALUES = [
    ("false OR null, true OR null, null AND true, null XOR false, NOT (null AND false)", (None, True, None, None, True)),
    ("true OR 9 % 0 = 1, false AND 9 / 0 > 2", (True, False)),
    ("null + 'x', 3 > null, null IN [3], null IS NULL, 'q' IS NOT NULL, [null][0] IS NULL", (None, None, None, True, True, True)),
    ("[7, [8]] = [7, [8]], [7, null] = [7, null], [7, null] = [8, null], [] = [7]", (True, None, False, False)),
    ("8 IN [7, 8.0], 9 IN [7, null], 9 IN [], 'a' IN ['b']", (True, None, False, False)),
    ("all(v IN [4, 6] WHERE v > 3), any(v IN [] WHERE v), none(v IN [null, 2] WHERE v = 2), single(v IN [2, 3, 2] WHERE v = 3), all(v IN [5, null] WHERE v > 1)", (True, False, False, True, None)),
    ("6 = 6.0, 9007199254740993 = 9007199254740992.0, 0.0 / 0.0 > 1, 0.0 / 0.0 <> 0.0 / 0.0, 'b' > 'a', 'b' > 1, 1 < 3 <= 3 < 2", (True, False, False, True, True, None, False)),
    ("17 / 5, -17 / 5, -17 % 5, 17.0 / 5, 3 ^ 3, 2 + 3 * 4 - 1, -(4 - 9), 7.5 % 2", (3, -3, -2, 3.4, 27.0, 13, 5, 1.5)),
    ("[4] + 5, 3 + [4], [3] + [4, 5], 'ab' + 'cd'", ([4, 5], [3, 4], [3, 4, 5], "abcd")),
    ("'harbour' STARTS WITH 'har', 'harbour' ENDS WITH 'our', 'harbour' CONTAINS 'x', 7 CONTAINS '7'", (True, True, False, None)),
    ("[6, 7, 8, 9][2], [6, 7][-2], [6, 7][5], [6, 7, 8, 9][1..-1], [6, 7, 8][2..], [6][null]", (8, 6, None, [7, 8], [8], None)),
    ("abs(-2.5), ceil(2.01), sqrt(6.25), sign(-0.1), sign(12)", (2.5, 3.0, 2.5, -1, 1)),
    ("toInteger('-40'), toInteger('4x'), toInteger(8.99), toFloat('2.50'), toFloat(3), toBoolean('False'), toString(2.5), toString(true)", (-40, None, 8, 2.5, 3.0, False, "2.5", "true")),
    ("toUpper('quay'), toLower('QUAY'), trim('\\t quay '), split('a-b-', '-'), substring('lighthouse', 5), substring('lighthouse', 0, 5), reverse('dock'), size('dock')", ("QUAY", "quay", "quay", ["a", "b", ""], "house", "light", "kcod", 4)),
    ("head([9, 8]), last([9, 8]), tail([9, 8]), reverse([9, 8, 7]), size([]), isEmpty([]), isEmpty('x'), isEmpty({}), head([])", (9, 8, [8], [7, 8, 9], 0, True, False, True, None)),
    ("range(2, 8, 3), range(4, 2), range(4, 2, -1), coalesce(null, null, 'z')", ([2, 5, 8], [], [4, 3, 2], "z")),
    ("{k: {l: 5}}.k.l, {k: 5}.m, {k: 5} = {k: 5.0}, {k: null} = {k: 5}, {k: 5} = {m: 5}", (5, None, True, None, False)),
    ("CASE 'p' WHEN 'q' THEN 1 WHEN 'p' THEN 2 END, CASE WHEN 3 > 4 THEN 'x' ELSE 'y' END, CASE null WHEN null THEN 'n' END", (2, "y", None)),
    ("[v IN range(1, 6) WHERE v % 2 = 0 | v * v], [v IN ['a', 'b']], [v IN [1, 2] | [w IN [v] | w + v]]", ([4, 16, 36], ["a", "b"], [[2], [4]])),
    ("0xFF, 0o17, 2e2, .25, 'it\\'s', \"a\\tb\", 'caf\\u00e9'", (255, 15, 200.0, 0.25, "it's", "a\tb", "café")),
    ("$low * 2, $names[1], $place.lat", (14, "Kobe", 34.5)),
    ("['5', 5][0] = ['5', 5][1], ['5', 5][1] = 5, ['5', 5][0] = '5', 5.0 IN ['x', 5], [true, 'true'][0] = 'true'", (False, True, True, True, False)),
    ("date('2031-05-06').week, date({year: 2031, month: 5, day: 6}).ordinalDay, localdatetime('2031-05-06T07:08:09').hour, time('07:08+09:00').offset", (19, 126, 7, "+09:00")),
    ("duration({hours: 49}).days, duration('P2Y4M').months, duration.between(date('2031-01-31'), date('2031-03-01')).days, date('2031-05-06') < date('2031-05-07')", (0, 28, 1, True)),
    ("date.truncate('quarter', date('2031-05-06')), localtime.truncate('minute', localtime('07:08:09')).second", (dt.date(2031, 4, 1), 0)),
    ("date() = date.statement(), localtime() = localtime.transaction(), time() = time.statement(), datetime().epochSeconds > 1700000000, localdatetime.realtime() >= localdatetime.statement(), 0 <= rand() < 1", (True,) * 6),
]

ERRORS = [
    ("MATCH (a) RETURN a +", "SyntaxError"), ("RETURN b", "undefined"), ("MATCH (a) WHERE sum(a.x) > 2 RETURN a", "aggregation"), ("RETURN frobnicate(2)", "unknown function"), ("RETURN 2 AS x, 3 AS x", "same name"),
    ("MATCH (a) WITH a.x RETURN 3", "WITH needs a name"), ("RETURN max(min(3))", "aggregation"), ("RETURN 3 AS x UNION RETURN 3 AS y", "columns"), ("MATCH (a) RETURN a SKIP -2", "whole numbers"), ("MATCH (a) RETURN a SKIP a.x", "variables"),
    ("MATCH (a)-[a]-() RETURN a", "both"), ("MATCH (a) RETURN a.x * sum(3)", "neither"), ("RETURN head([1], [2])", "arguments"), ("CALL db.nothing() YIELD q RETURN q", "unknown procedure"), ("MATCH (a) RETURN a.x ORDER BY max(a.x)", "ORDER BY"),
    ("RETURN 3 IN 4", "list"), ("RETURN 'v' + 3", "string"), ("RETURN 3 AND true", "boolean"), ("MATCH (a)", "ends with"), ("RETURN 123456789012345678901", "too large"), ("MATCH ()-[r]->()-[r]->() RETURN r", "twice"), ("RETURN $nowhere", "missing parameter"),
    ("RETURN *", "scope"), ("MATCH (a) DELETE a", "execute"), ("RETURN EXISTS { MATCH (a) DELETE a }", "EXISTS"),
]


@pytest.fixture(scope="module")
def graph(spark):
    return harbours(spark)


@pytest.mark.parametrize(("query", "rows"), [*SCANS, *EXPANSIONS, *SUBQUERIES, *ROWS])
def test_rows(graph, query, rows):
    assert [tuple(r) for r in graph.cypher(query).collect()] == rows


@pytest.mark.parametrize(("items", "values"), VALUES)
def test_values(graph, items, values):
    assert tuple(graph.cypher(f"RETURN {items}", low=7, names=["Oslo", "Kobe"], place={"lat": 34.5}).first()) == values


@pytest.mark.parametrize(("query", "message"), ERRORS)
def test_errors(graph, query, message):
    with pytest.raises(GraphQueryError, match=message):
        graph.cypher(query)


@pytest.mark.parametrize("items", ["9223372036854775806 + 2", "-9223372036854775806 - 3", "4 / 0", "4 % 0", "range(2, 5, 0)", "substring('quay', -2)"])
def test_failures_at_run_time(graph, items):
    with pytest.raises(Exception, match="OVERFLOW|BY_ZERO|step|negative"):
        graph.cypher(f"RETURN {items}").collect()


def test_implicit_names_and_entities(graph):
    df = graph.cypher("MATCH (s:Tug)-[c]->(p) RETURN s, c, p.name, p.depth * 2")
    assert df.columns == ["s", "c", "p.name", "p.depth * 2"]
    row = df.first()
    assert row.s.properties.name == "Selene" and row.c.type == "CALLS" and row.c.src == row.s.id and row[3] == 18


def test_empty_graph(spark):
    graph = PropertyGraph(spark)
    assert graph.cypher("MATCH (a)-[r]-(b) RETURN a").count() == 0
    assert tuple(graph.cypher("MATCH (a) RETURN count(a), collect(a.y), min(a.y)").first()) == (0, [], None)


def test_spans_and_comments():
    tree = parse("/* ports */ MATCH (x)-[w:P|:Q*3..5]->(y) RETURN `y`.`a key` // end\n;")
    assert tree.clauses[0].parts[0].rels[0].span == (3, 5) and tree.clauses[1].items[0][0].key == "a key"
