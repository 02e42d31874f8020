"""Every catalogue entry against its SQL, and the plans of some."""

import datetime
import os

import duckdb
import pytest
from pathloom import catalog
from pathloom.sources.graph import warehouse_graph
from pyspark.sql import functions as F

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", catalog.ENTRIES)
def test_entry(spark, sql, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), sql.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.select(*[f'"{c}"' for c in got.columns]).fetchall()
    assert sorted(str(plain(tuple(r))) for r in got.collect()) == sorted(str(plain(r)) for r in rows)


def test_scans_read_only_what_is_asked(spark, sf_dir):
    plan = warehouse_graph(spark, sf_dir).cypher("MATCH (o:Order) WHERE o.orderkey = 7 RETURN o.totalprice AS p")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_end_nodes_are_not_joined_for_their_ids(spark, sf_dir):
    plan = warehouse_graph(spark, sf_dir).cypher("MATCH (c:Customer)-[:PLACED]->(o) RETURN count(o) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1


def scanned(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.count(f"Relation {x}") for x in ("[", "spark_catalog")) + plan.count("LogicalRelation")


def test_only_tables_that_ends_can_lie_in_are_read(spark, sf_dir):
    graph = warehouse_graph(spark, sf_dir)
    assert scanned(graph.cypher("MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN r.name AS region, count(*) AS c")) <= 6
    assert scanned(graph.cypher("MATCH p = (a:Turn {turn: 0})-[:NEXT*2..3]->(b) RETURN nodes(p)[1].turn AS t")) <= 1 + 3 * 3 + 1


def test_trails_paths_and_durations_cover_whole_tables(spark, tmp_path):
    """Large ids, gaps, and a conversation longer than 8 hops."""
    at = datetime.datetime(2020, 1, 1)
    turns = [(c, t, "user", "x") for c, n in ((5, 2), (500, 12), (501, 1)) for t in range(n)] + [(502, 0, "user", "x"), (502, 2, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for t in set(TABLES) - {"conversations", "orders", "lineitem"}:
        os.symlink(os.path.join(SF, f"{t}.parquet"), f"{tmp_path}/{t}.parquet")
    for t, keys, dates in (("orders", ["o_orderkey"], ["o_orderdate"]), ("lineitem", ["l_orderkey"], ["l_shipdate"])):
        one = spark.read.parquet(f"{SF}/{t}.parquet").limit(1)
        one = one.withColumns({k: F.lit(7000).cast(one.schema[k].dataType) for k in keys})
        one.withColumns({d: F.lit(at + datetime.timedelta(days=3 * (t == "lineitem"))).cast(one.schema[d].dataType) for d in dates}).write.parquet(f"{tmp_path}/{t}.parquet")
    got = {n: [tuple(r) for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()] for n in ("varlen_unbounded", "named_path", "temporal_duration")}
    assert sorted(got["varlen_unbounded"]) == [(5, 1), (500, 11)]
    assert sorted(got["named_path"]) == [(2, 1, [0, 1, 2], 2, 1), (3, 1, [0, 1, 2, 3], 3, 1)]
    assert got["temporal_duration"] == [(7000, 3, 3 * 86400)]
