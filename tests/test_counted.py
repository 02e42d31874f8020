"""Branches that are counted instead of joined: the counts of rows that are listed, and plans whose joins do not multiply."""

import os
import re
from collections import Counter

import pytest
from pathloom import catalog
from pathloom.sources.graph import PropertyGraph

from .test_patterns import small_graph

#: A pattern with its predicates, and what its rows are grouped by; each is compared with its own rows.
PATTERNS = [
    ("MATCH (a)-[r]->(n)<-[s]-(b)", "id(n)"),
    ("MATCH (a:A)-[r:X]->(n)<-[s:X]-(b:B)", "n.v"),
    ("MATCH (a)-[r:X]->(n:A), (n)<-[s:Y]-(b) WHERE a.v > 0 AND b.v < 3 AND n.v >= 0", "id(n), a.v"),
    ("MATCH (n {v: 1})<-[r]-(a), (n)<-[s {w: 1}]-(b)", "id(a)"),
    ("MATCH (n:A)-[r]-(a), (n)-[s]-(b)", "id(n)"),
    ("MATCH (a)<-[r]-(n)-[s]->(b)<-[t]-(c)", "n.v"),
    ("MATCH (a)-[q]->(b)-[r]->(n)<-[s]-(c)", "id(a)"),
    ("MATCH (a)-[r]->(n)<-[s]-(n)", "id(n)"),
    ("MATCH (a)-[r]->(n)<-[s]-(b) WHERE a.v = b.v", "id(n)"),
    ("MATCH (a)-[r]->(n)<-[s]-(b) WHERE b.v > 0 AND (b)-[:X]->()", "id(n)"),
    ("MATCH (a)-[r:X]->(n)<-[s:X]-(b) WHERE (a)-[:Y]->()", "id(n)"),
    ("MATCH (n:B) MATCH (n)<-[r]-(a) MATCH (n)<-[s]-(b)-[t]-(c)<-[u]-(d)", "n.v"),
]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("pattern,by", PATTERNS)
def test_counts_are_those_of_the_rows(spark, seed, pattern, by):
    graph, _, _ = small_graph(spark, seed)
    keys = [f"k{i}" for i in range(len(by.split(",")))]
    named = ", ".join(f"{e} AS {k}" for e, k in zip(by.split(","), keys, strict=True))
    rows = Counter(tuple(r)[:-1] for r in graph.cypher(f"{pattern} RETURN {named}, 1 AS one").collect())
    assert {tuple(r)[:-1]: r["c"] for r in graph.cypher(f"{pattern} RETURN {named}, count(*) AS c").collect()} == dict(rows)
    assert [tuple(r) for r in graph.cypher(f"{pattern} RETURN count(*) AS c, 2 * count(*) AS d").collect()] == [(rows.total(), 2 * rows.total())]
    assert graph.cypher(f"{pattern} WITH count(*) AS c WHERE c > 0 RETURN c").count() == (rows.total() > 0)


def test_repeated_and_missing_ids(spark):
    """Relationships that share an id differ from none of them, one without an id matches nothing, and nodes that are there twice count twice."""
    nodes = spark.createDataFrame([(1, ["N"], 0), (1, ["N"], 5), (2, ["N"], 0), (7, ["L"], 0), (8, ["L"], 0)], "id long, labels array<string>, v long")
    rels = spark.createDataFrame([(10, 7, 1), (10, 8, 1), (11, 8, 1), (None, 7, 1), (12, 7, 2), (13, 9, 2), (14, 7, None)], "id long, src long, dst long")
    graph = PropertyGraph(spark).with_entities(nodes, [("T", rels)])
    for pattern in ("MATCH (a:L)-[:T]->(n:N)<-[:T]-(b:L)", "MATCH (n:N)<-[:T]-(a), (n)<-[:T]-(b)"):
        rows = Counter(tuple(r) for r in graph.cypher(f"{pattern} RETURN n.v AS v, id(n) AS n").collect())
        assert {(r["v"], r["n"]): r["c"] for r in graph.cypher(f"{pattern} RETURN n.v AS v, id(n) AS n, count(*) AS c").collect()} == dict(rows)


def joined_rows(df):
    """The most rows that a join of the query gave."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        if "Join" in kind:
            most = max(most, plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


@pytest.mark.parametrize("name", ["node_hash_join", "uniqueness"])
def test_joins_give_no_more_rows_than_their_input(spark, name):
    """The pairs of a nation's customers and suppliers grow with their product; no join may give them one by one."""
    folder, rows = "/root/testdata/sf0.1", 16_000
    df = catalog.QUERIES[name](spark, folder)
    assert joined_rows(df) <= rows < sum(r[-1] for r in df.collect())


def test_a_distinct_count_is_dealt_by_the_size_of_its_files(spark, monkeypatch):
    """Nodes too large to broadcast meet their relationships in partitions of a size of their own, whichever size Spark would take; the rows stay the same."""
    from pathloom.operators import match

    folder, key = "/root/testdata/sf0.1", "spark.sql.autoBroadcastJoinThreshold"
    want = sorted(map(tuple, catalog.QUERIES["rel_props_agg"](spark, folder).collect()))
    monkeypatch.setattr(match, "DEALT_BYTES", 1 << 20)
    parts = os.path.getsize(f"{folder}/lineitem.parquet") // match.DEALT_BYTES + 1
    before = spark.conf.get(key)
    try:
        for least, exchanges in (("200KB", 2), ("1KB", 5)):
            spark.conf.set(key, least)
            df = catalog.QUERIES["rel_props_agg"](spark, folder)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(rf"Exchange hashpartitioning\(.*, {parts}\), REPARTITION_BY_NUM", plan)) == exchanges
            assert plan.count("Exchange hashpartitioning") == exchanges + 1
            assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.set(key, before)
