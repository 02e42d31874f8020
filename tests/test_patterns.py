"""Patterns on random small graphs against a matcher that tries all assignments."""

import random

import pytest
from pathloom.sources.graph import PropertyGraph


def small_graph(spark, seed):
    r = random.Random(seed)
    nodes = [(i, sorted(r.sample(["A", "B"], r.randint(0, 2))), r.randint(0, 3)) for i in range(6)]
    rels = [(i, r.randrange(6), r.randrange(6), r.choice("XY"), r.randint(0, 2)) for i in range(9)]
    frame = spark.createDataFrame(nodes, "id long, labels array<string>, v long")
    graph = PropertyGraph(spark).with_entities(frame, [(t, spark.createDataFrame([(i, a, b, w) for i, a, b, k, w in rels if k == t], "id long, src long, dst long, w long")) for t in "XY"])
    return graph, nodes, rels


def steps(rels, at, types, direction):
    for i, a, b, t, w in rels:
        if types and t not in types:
            continue
        if direction in ("out", "both") and a == at:
            yield i, b
        if direction in ("in", "both") and b == at and not (direction == "both" and a == b):
            yield i, a


def trails(rels, at, types, direction, low, high, used=()):
    if low <= len(used):
        yield at, used
    if len(used) < high:
        for i, b in steps(rels, at, types, direction):
            if i not in used:
                yield from trails(rels, b, types, direction, low, high, (*used, i))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_assignments(spark, seed):
    graph, nodes, rels = small_graph(spark, seed)
    label = {i: set(ls) for i, ls, _ in nodes}
    run = lambda q: sorted(tuple(r) for r in graph.cypher(q).collect())
    ids = [i for i, *_ in nodes]
    assert run("MATCH (a:A)-[r:X]->(b)<-[s]-(c) RETURN id(a), id(b), id(c)") == sorted((a, b, c) for a in ids if "A" in label[a] for i, b in steps(rels, a, "X", "out") for j, c in steps(rels, b, "", "in") if i != j)
    assert run("MATCH (a)-[r]-(b:B) RETURN id(a), id(b)") == sorted((a, b) for a in ids for _, b in steps(rels, a, "", "both") if "B" in label[b])
    assert run("MATCH (a)-[r]->(b)-[s]->(a) RETURN id(a), id(b)") == sorted((a, b) for a in ids for i, b in steps(rels, a, "", "out") for j, c in steps(rels, b, "", "out") if c == a and i != j)
    assert run("MATCH (a)-[r*0..3]->(b) RETURN id(a), id(b), size(r)") == sorted((a, b, len(u)) for a in ids for b, u in trails(rels, a, "", "out", 0, 3))
    assert run("MATCH (a)-[r:Y*1..2]-(b:A) RETURN id(a), id(b), size(r)") == sorted((a, b, len(u)) for a in ids for b, u in trails(rels, a, "Y", "both", 1, 2) if "A" in label[b])
    assert run("MATCH (a:B)-[r*1..2]->(b)-[s]->(c) RETURN id(a), id(c)") == sorted((a, c) for a in ids if "B" in label[a] for b, u in trails(rels, a, "", "out", 1, 2) for j, c in steps(rels, b, "", "out") if j not in u)
    p = run("MATCH p = (a)<-[r*2..2]-(b:A) RETURN [x IN nodes(p) | id(x)] AS n, [x IN relationships(p) | id(x)] AS r")
    assert [tuple(map(tuple, x)) for x in p] == sorted((tuple(walk(rels, a, u, "in")), u) for a in ids for b, u in trails(rels, a, "", "in", 2, 2) if "A" in label[b])
    assert run("MATCH (a) WHERE NOT (a)-[:X]->() RETURN id(a)") == [(a,) for a in ids if not [*steps(rels, a, "X", "out")]]
    assert run("MATCH (a) RETURN id(a), size([(a)-[r:Y]->(b:B) WHERE b.v > 0 | b.v])") == sorted((a, sum(1 for _, b in steps(rels, a, "Y", "out") if "B" in label[b] and nodes[b][2] > 0)) for a in ids)


def walk(rels, at, used, direction):
    out = [at]
    for i in used:
        at = next(b for j, b in steps(rels, at, "", direction) if j == i)
        out.append(at)
    return out
