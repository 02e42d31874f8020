import random

import numpy as np
import pytest
import xxhash
from pathloom.llm import queries, simhash
from pathloom.llm.common import Scratch

from .fixtures import TEXTS, documents


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(fps):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, f"{fp:016x}", least.get(find(i))) for i, (key, fp) in enumerate(fps)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(queries.op3_simhash(spark, sf_dir)) == brute(rows)


def test_awkward_rows(spark):
    got = queries.simhash_digests(simhash.grouped_documents(spark, documents(spark)))
    assert found(got) == brute([(i, t) for i, t, _ in TEXTS])
    assert simhash.grouped_documents(spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("correlated", [False, True])
def test_no_link_is_lost(spark, correlated):
    r = random.Random(3)
    base = [r.getrandbits(64) & (0xFFFF0000FFFF0000 if correlated else (1 << 64) - 1) for _ in range(60)]
    values = {v ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for v in base for _ in range(12)}
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {(r.a, r.b) for r in simhash.near_pairs(spark, nodes).collect()}
    signed = sorted(map(simhash.signed, values))
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_thresholds_are_complete_and_cheap():
    share, both = np.full(64, 0.5), np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for n in (1000, 10**6, 10**9):
        plan = simhash.probing_plan(n, both * n / 1000, np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
        assert sum(t + 1 for _, _, t in plan) == 4 and share.sum()
    assert simhash.allocated([[0, 1, 5, 9, 9], [0, 1, 2, 3, 9]], 3) == (4.0, [0, 2])


def test_components_of_chains(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i * 7 + 3) % 30) for i in range(30)]
    links = spark.createDataFrame([(a, b) if r.random() < 0.5 else (b, a) for a, b in edges if a != b], "a long, b long")
    got = {x.node: x.root for x in simhash.components(spark, links, Scratch(spark, "t")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: x for n, x in root.items() if n != x}
