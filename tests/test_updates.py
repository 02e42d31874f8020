"""Updates: the rows of the query, and the graph before and after it."""

import pytest
from pathloom.plans.ast import GraphQueryError

from .harbours import harbours


@pytest.fixture(scope="module")
def graph(spark):
    return harbours(spark)


def nodes(graph):
    return {r.n.id: (sorted(r.n.labels), {k: v for k, v in r.n.properties.asDict().items() if v is not None}) for r in graph.cypher("MATCH (n) RETURN n").collect()}


def rels(graph):
    return {r.r.id: (r.r.src, r.r.dst, r.r.type) for r in graph.cypher("MATCH ()-[r]->() RETURN r").collect()}


NODES = {
    10: (["Port"], {"name": "Oslo", "depth": 14}), 11: (["Port"], {"name": "Porto", "depth": 9}), 12: (["Port"], {"name": "Kobe"}),
    20: (["Ship"], {"name": "Mira", "tons": 3.5}), 21: (["Ship", "Tug"], {"name": "Selene", "tons": 0.25}), 30: (["Crane"], {"electric": True}),
}
RELS = {100: (20, 10, "CALLS"), 101: (20, 11, "CALLS"), 102: (21, 11, "CALLS"), 200: (10, 11, "ROUTE"), 201: (11, 12, "ROUTE"), 202: (12, 12, "ROUTE"), 300: (30, 10, "SERVES")}

#: Query, its rows, and what changes: nodes and relationships by id, None for those that go.
CASES = [
    ("CREATE (f:Fleet {size: 2})-[o:OWNS {since: 2019}]->(s:Ship {name: 'Nova'}) RETURN f.size, o.since, id(s) - id(f) AS d", [(2, 2019, 1)], {40: (["Fleet"], {"size": 2}), 41: (["Ship"], {"name": "Nova"})}, {400: (40, 41, "OWNS")}),
    ("MATCH (s:Ship) CREATE (s)<-[:CREWS]-(c:Crew {of: s.name}) RETURN count(c)", [(2,)], {40: None, 41: None}, None),
    ("UNWIND [7, 8] AS v CREATE (b:Buoy {v: v}) WITH b MATCH (c:Buoy) RETURN count(c)", [(4,)], {40: (["Buoy"], {"v": 7}), 41: (["Buoy"], {"v": 8})}, {}),
    ("CREATE (b:Buoy $props) RETURN b.v, b.w", [(6, "red")], {40: (["Buoy"], {"v": 6, "w": "red"})}, {}),
    ("MATCH (s:Tug) SET s.tons = s.tons * 2, s:Old RETURN s.tons", [(0.5,)], {21: (["Old", "Ship", "Tug"], {"name": "Selene", "tons": 0.5})}, {}),
    ("MATCH (p:Port {name: 'Kobe'}) SET p = {name: 'Kobe', berths: 5}", [], {12: (["Port"], {"name": "Kobe", "berths": 5})}, {}),
    ("MATCH (p:Port {depth: 9}) SET p += {depth: null, berths: 1}", [], {11: (["Port"], {"name": "Porto", "berths": 1})}, {}),
    ("MATCH (s:Tug) REMOVE s.tons, s:Tug RETURN s.name, s:Tug", [("Selene", False)], {21: (["Ship"], {"name": "Selene"})}, {}),
    ("MATCH (c:Crane)-[r]->() DELETE r, c", [], {30: "gone"}, {300: "gone"}),
    ("MATCH (p:Port {name: 'Kobe'}) DETACH DELETE p", [], {12: "gone"}, {201: "gone", 202: "gone"}),
    ("MATCH w = (:Crane)-[:SERVES]->() WITH w LIMIT 0 DELETE w", [], {}, {}),
    ("MATCH (s:Ship) MERGE (c:Crew {of: s.name}) ON CREATE SET c.fresh = true ON MATCH SET c.fresh = false RETURN count(c.fresh)", [(2,)], {40: None, 41: None}, {}),
    ("UNWIND ['n', 's', 'n'] AS k MERGE (l:Light {side: k}) ON CREATE SET l.lit = 1 ON MATCH SET l.again = 1 RETURN k, l.lit ORDER BY k", [("n", 1), ("n", 1), ("s", 1)], {40: (["Light"], {"side": "n", "lit": 1, "again": 1}), 41: (["Light"], {"side": "s", "lit": 1})}, {}),
    ("MATCH (p:Port {depth: 14}) MERGE (q:Port {depth: 14}) ON MATCH SET q.seen = 3 RETURN q.name, q.seen", [("Oslo", 3)], {10: (["Port"], {"name": "Oslo", "depth": 14, "seen": 3})}, {}),
    ("MATCH (s:Tug), (p:Port {name: 'Kobe'}) MERGE (s)-[r:CALLS]->(p) RETURN type(r)", [("CALLS",)], {}, {400: (21, 12, "CALLS")}),
    ("MATCH (a:Port {name: 'Porto'}), (b:Port {name: 'Oslo'}) MERGE (a)-[r:ROUTE]-(b) RETURN r.miles", [(2900.5,)], {}, {}),
]


def changed(before, after):
    return {i: after.get(i, "gone") for i in {*before, *after} if before.get(i) != after.get(i)}


@pytest.mark.parametrize(("query", "rows", "new_nodes", "new_rels"), CASES)
def test_updates(graph, query, rows, new_nodes, new_rels):
    got, after = graph.execute(query, props={"v": 6, "w": "red"})
    assert [tuple(r) for r in got.collect()] == rows
    found = changed(NODES, nodes(after))
    assert {*found} == {*new_nodes} and all(found[i] == v for i, v in new_nodes.items() if v is not None)
    assert new_rels is None or changed(RELS, rels(after)) == new_rels
    assert nodes(graph) == NODES and rels(graph) == RELS  # the snapshot at hand never changes


REJECTED = [
    ("MATCH (p:Port) DELETE p", "still has relationships"), ("MERGE (b:Buoy {v: null}) RETURN b", "null"), ("MATCH (s:Ship) CREATE (s)-[:P|Q]->(:Port)", "exactly one type"), ("MATCH (s:Ship) CREATE (s:Ferry)", "bound already"),
    ("CREATE (:A)-[:P]-(:B)", "one direction"), ("CREATE (:A)-[:P*3]->(:B)", "no length"), ("MATCH (s:Ship) SET s = 5", "map"), ("MATCH (s:Ship), (p:Port) SET s = p", "map"), ("MATCH (s:Ship) DELETE s.tons", "DELETE"), ("MERGE (b:Buoy $props)", "parameter"),
]


@pytest.mark.parametrize(("query", "message"), REJECTED)
def test_rejected(graph, query, message):
    with pytest.raises(GraphQueryError, match=message):
        graph.execute(query, props={})
    assert nodes(graph) == NODES
