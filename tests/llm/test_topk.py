import math

import numpy as np
from pathloom.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, uid int, q string"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(queries.op6_top_k(spark, sf_dir)) == brute(rows)


def test_blocks_and_ties(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + r.normal(size=6) * 0.01 * (i % 3)).round(2).tolist()) for i in range(700)]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "GROUP_ROWS", 200)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 5)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert found(topk.top_k(spark, frame)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (50, [0.0, 0.0]), (100, None), (150, [None, 1.0]), (200, [float("nan"), 0.0]), (250, [float("inf"), 0.0]), (None, [1.0, 1.0]), (300, []), (350, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert found(topk.top_k(spark, frame)) == brute(rows)
    assert topk.top_k(spark, frame.limit(0)).count() == 0


def test_bounds_hold_and_tighten():
    r = np.random.default_rng(3)
    vectors, queries = np.floor(256 * r.normal(size=(300, 8))), np.floor(99 * r.normal(size=(5, 8)))
    queries[0, 2] = 0
    lists, exact, width = topk.Lists(np.arange(300), np.arange(300), vectors), vectors @ queries.T, np.inf
    parts = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).T
    for depth in (0.01, 0.1, 0.5, 1.0):
        lower, upper = (lists.bounds(parts, depth, x) for x in ("worst", "last"))
        assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).sum() <= width
        width = (upper - lower).sum()
    assert width == 0


def test_unread_entries_are_not_looked_at():
    r = np.random.default_rng(5)
    vectors, query = np.floor(256 * r.normal(size=(200, 3))), np.array([[9.0, -4.0, 7.0]])
    lists = topk.Lists(np.arange(200), np.arange(200), vectors)
    parts = np.concatenate([np.maximum(query, 0), np.minimum(query, 0)], axis=1).T
    before = lists.bounds(parts, 0.25, "last")
    unread = [lists.place[:, 0] < 150, lists.place[:, 1] >= 50, lists.place[:, 2] < 150]
    for d, u in enumerate(unread):
        lists.vectors[u, d] = -123456
    assert (lists.bounds(parts, 0.25, "last") == before).all()


def test_reading_stops_early():
    r = np.random.default_rng(4)
    vectors = np.floor(256 * r.normal(size=(4000, 16)))
    vectors[7] = vectors[9] = 900
    lists = topk.Lists(np.arange(4000), np.arange(4000), vectors)
    scores = vectors @ np.full(16, 50.0)
    best = np.argsort(-scores)[:5]
    (left,), (depth,) = lists.contenders(np.full((1, 16), 50.0), 5, np.full(1, scores[best[-1]]), 0)
    assert set(best) <= set(left.tolist()) and len(left) <= topk.FEW * 5 and topk.DEPTHS[depth] < 1


def test_share_of_the_lists_that_is_read(spark):
    """Independent components: the stop rule fires before the end; a few strong ones: long before."""
    r = np.random.default_rng(6)
    for size, most in ((32, 0.97), (4, 0.6)):
        rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(3000, size)))]
        got = topk.top_k(spark, spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), every=300)
        rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
        assert found(got) == brute(rows, every=300)
        assert np.mean([x.read for x in got.collect()]) < most
