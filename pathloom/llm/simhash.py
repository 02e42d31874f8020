"""SimHash near-duplicates: fingerprints, all links within a Hamming distance by the generalised pigeonhole, components.

Fingerprints are grouped first, so that copies are one node. The 64 bits are cut into parts such that correlated bits
share a part; each part gets a threshold of its own (-1: the part is not used), with thresholds that add up to
``distance - parts + 1``. Two fingerprints within the distance are then within the threshold of some part. Number of
parts and thresholds come from a dynamic program over estimated costs: probes (values within the threshold of a
part) and candidates (pairs that agree to within it, estimated on a bounded sample and by bit frequencies). Every
fingerprint is indexed under its parts and probes all values in reach; candidates are verified in the join.

Links feed alternating star contractions until each node points at the smallest id of its component; every round is a
written table. Nothing that grows with the documents comes to the driver.

Defined cases: a text without words (null, empty, white space) has fingerprint zero, which links like any other;
a text of any length is hashed whole (8 bytes a shingle in memory);
repeated rows and copies share a component; null ids never name a component unless it has no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy

BITS = 64
#: Fingerprints that the cost estimate looks at; links never depend on them.
SAMPLE = 4096


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space alone
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[: len(tokens) - words].tolist()]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], ">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def of(batches):
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(values)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bits set, for each pair of bits."""

    def count(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            total += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([[total, *both.astype(np.int64).ravel().tolist()]], pa.list_(pa.int64()))], names=["counts"])

    sums = nodes.select("fp").mapInArrow(count, "counts array<long>").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(1 + BITS * BITS)
    for r in sums:
        flat[r["at"]] = r.n
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def correlated_parts(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits (0: the highest) in parts of about equal size; each part takes in turn the bit that agrees best with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda b: (correlation[b, sorted(left)].sum(), -b))
        part = [first]
        left.discard(first)
        while len(part) < size:
            part.append(max(left, key=lambda b: (correlation[b, part].sum(), -b)))
            left.discard(part[-1])
        out.append(sorted(part))
    return out


def mask_of(bits) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def agreement(part: list[int], share: np.ndarray, sample: np.ndarray, most: int) -> list[float]:
    """The estimated probability that two fingerprints differ in at most 0, 1, ... most bits of a part."""
    law = np.zeros(most + 1)
    law[0] = 1
    for b in part:
        differ = 2 * share[b] * (1 - share[b])
        law = law * (1 - differ) + np.concatenate([[0], law[:-1]]) * differ
    independent, seen = np.cumsum(law), np.zeros(most + 1)
    masked = sample & np.uint64(mask_of(part))
    for at in range(1, len(masked)):
        seen += np.bincount(np.minimum(np.bitwise_count(masked[:-at] ^ masked[at:]), most + 1), minlength=most + 2)[: most + 1]
    pairs = len(sample) * (len(sample) - 1) / 2
    return np.maximum(independent, np.cumsum(seen) / pairs if pairs else 0).tolist()


def allocated(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Dynamic program: thresholds from -1 for each part, costs[part][threshold + 1], with sum of (threshold + 1) = distance + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                u = used + t + 1
                if u <= distance + 1 and (u not in step or cost + part[t + 1] < step[u][0]):
                    step[u] = (cost + part[t + 1], [*chosen, t])
        best = step
    return best[distance + 1]


def probing_plan(n: int, both: np.ndarray, sample: np.ndarray, distance: int, probe_cost: float = 1.0, candidate_cost: float = 0.1) -> list[tuple[int, list[int], int]]:
    """Parts that are probed: number, bits, threshold; the cheapest number of parts by estimated cost."""
    share, found = np.diag(both) / max(n, 1), []
    for m in range(2, distance + 3):
        parts = correlated_parts(both, n, m)
        costs = []
        for part in parts:
            near = agreement(part, share, sample, distance)
            reach = [sum(comb(len(part), d) for d in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *(probe_cost * n * r + candidate_cost * n * n / 2 * p for r, p in zip(reach, near, strict=True))])
        found.append((*allocated(costs, distance), m, parts))
    _, thresholds, _, parts = min(found, key=lambda x: (x[0], x[2]))
    return [(i, part, t) for i, (part, t) in enumerate(zip(parts, thresholds, strict=True)) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(spark: SparkSession, nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a < b as longs) of distinct fingerprints within the distance."""
    n, both = bit_statistics(nodes)
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp")
    if n > 2 * SAMPLE:
        sample = nodes.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(n)) < 2 * SAMPLE).orderBy(F.xxhash64("fp"), "fp")
    sample = np.array([r.fp for r in sample.limit(SAMPLE).collect()], np.int64).view(np.uint64)
    plan = probing_plan(n, both, sample, distance)
    masks = [(i, signed(mask_of(bits)), [signed(mask_of(flip)) for d in range(t + 1) for flip in combinations(bits, d)]) for i, bits, t in plan]
    part = lambda i, mask: F.col("fp").bitwiseAND(F.lit(mask))
    entry = lambda i, value: F.struct(F.lit(i).alias("part"), value.alias("value"))
    index = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*[entry(i, part(i, m)) for i, m, _ in masks])).alias("e"))
    around = lambda i, mask: lambda flip: entry(i, part(i, mask).bitwiseXOR(flip))
    reach = F.concat(*[F.transform(F.array(*[F.lit(f) for f in flips]), around(i, m)) for i, m, flips in masks])
    probes = nodes.select(F.col("fp").alias("a"), F.explode(reach).alias("e"))
    index, probes = (x.select(c, "e.part", "e.value") for x, c in ((index, "b"), (probes, "a")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    joined = probes.join(index, (probes.part == index.part) & (probes.value == index.value) & (probes.a < index.b) & near)
    return joined.select("a", "b")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root of the nodes that have links, root being the smallest node of the component; links: written, columns a and b.

    Alternating large-star and small-star steps; each round is written, so a lost executor costs one round at most."""
    edges, rounds, before = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), 0, None
    edges = scratch.write(edges, "edges0")
    while True:
        rounds += 1
        # large star: the larger neighbours of each node go to its smallest neighbour or itself
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of each node, and itself, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = scratch.write(small.filter("u <> v").distinct(), f"edges{rounds}")
        now = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(now):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        scratch.drop(f"edges{rounds - 1}")
        edges, before = small, tuple(now)


def grouped_documents(spark: SparkSession, docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """Every document with its fingerprint and component: doc_id, fp (long), component_id."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(docs, words), "fingerprints")
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    pairs = scratch.write(near_pairs(spark, nodes, distance), "pairs")
    tidy(spark)
    roots = components(spark, pairs, scratch)
    of_node = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of_node.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = scratch.write(of_node.join(least, "root").select("fp", "component_id"), "components")
    scratch.keep("fingerprints", "components")
    return rows.join(of_node, "fp").select("doc_id", "fp", "component_id")
