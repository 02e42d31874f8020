"""Exact top-k by integer inner product with no-random-access aggregation over sorted lists.

Vectors are quantised to floor(scale * x). Candidates are cut into blocks; a block has for each dimension a list of
its vectors in the order of that component. For a query every list is read from its better end, in batches of equal
depth, and only entries that have been read are added up: a vector has an upper bound (the last value read stands for
each unread component) and, while no k scores are known, a lower bound (the list's worst value stands for it).
Reading stops when the vectors whose upper bound reaches the k-th best lower bound are few: all others cannot qualify.
The scores of those few are then resolved. Scores of earlier blocks carry over as a bound that later blocks start
with, and a block looks at its bounds first where the block before could stop. ``read`` is the share of the lists that
a query has read, on average over the blocks.

All queries meet all candidates, block by block, so work grows with the product of their numbers; a pair of groups is
a task, and no task holds more than GROUP_ROWS candidates and GROUP_QUERIES queries.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids;
only vectors of the query's length are its candidates; a repeated row is a candidate of its own (each row is left
out of its own result only); a query with fewer candidates than k returns all of them; an empty table gives no rows;
other columns are ignored. Scores are exact while their absolute parts sum to less than 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, FIRST = 4096, 512
GROUP_ROWS, GROUP_QUERIES = 4 * BLOCK, 1024
#: Shares of the lists after which bounds can be looked at, and queries that read together.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1.0)
TOGETHER = 256
#: So many vectors for each wanted one may be left when reading stops.
FEW = 8


class Lists:
    """A block's vectors and their places in the sorted list of each dimension.

    A query reads the lists of its positive components from the top and those of its negative ones from the bottom, so
    what queries have read to a depth is one of two fixed sets of entries for each dimension, and the sums over them
    are matrix products of a block's read entries with many queries."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray):
        self.ids, self.uids, self.vectors, n = ids, uids, vectors, len(ids)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], vectors.shape), axis=0)

    def entries(self, depth: float, unread: str) -> tuple[np.ndarray, np.ndarray]:
        """What stands for unread entries of the lists from the top and of those from the bottom (last: the last value read, worst: the list's other end), and by how much entries that are read differ from it (0 where unread)."""
        n = len(self.ids)
        read = max(1, int(np.ceil(n * depth)))
        instead = np.concatenate([self.values[n - read], self.values[read - 1]] if unread == "last" else [self.values[0], self.values[-1]])
        seen = np.concatenate([self.place >= n - read, self.place < read], axis=1)
        return instead, (np.concatenate([self.vectors, self.vectors], axis=1) - instead) * seen

    def bounds(self, parts: np.ndarray, depth: float, unread: str) -> np.ndarray:
        """Bounds of all vectors' scores (rows) for queries' positive and negative parts (columns)."""
        instead, more = self.entries(depth, unread)
        return instead @ parts + more @ parts

    def contenders(self, queries: np.ndarray, k: int, known: np.ndarray, first: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the vectors that may be among its k best, given that k scores of at least ``known`` are known elsewhere, and the index of the depth where it stopped; bounds are looked at from depth ``first`` on."""
        n, out = len(self.ids), [np.arange(len(self.ids))] * len(queries)
        depth_of = np.full(len(queries), len(DEPTHS) - 1)
        parts = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).T
        open_ = np.arange(len(queries)) if n > FEW * k else np.zeros(0, np.int64)
        for at in range(first, len(DEPTHS)):
            if not len(open_):
                break
            best = known[open_]
            if not np.isfinite(best).all():  # k + 1: one of these vectors may be the query's own row
                lower = self.bounds(parts[:, open_], DEPTHS[at], "worst")
                best = np.maximum(best, np.partition(lower, n - (k + 1), axis=0)[n - (k + 1)])
            left = self.bounds(parts[:, open_], DEPTHS[at], "last") >= best[None, :]
            few = (left.sum(axis=0) <= FEW * k) | (at == len(DEPTHS) - 1)
            for j in np.flatnonzero(few).tolist():
                out[open_[j]] = np.flatnonzero(left[:, j])
            depth_of[open_[few]] = at
            open_ = open_[~few]
        return out, depth_of


def best_of_group(k: int):
    """For one group of candidates and one of queries: each query's k best candidates of the group."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(rows):
            rows = rows.sort_by("uid")
            matrix = np.array(rows["q"].to_pylist(), np.float64)
            ids, uids = rows["vec_id"].to_numpy(), rows["uid"].to_numpy()
            cuts = [0, *range(FIRST, len(ids), BLOCK), len(ids)] if len(ids) > FIRST else [0, len(ids)]
            asked = np.array(queries["query"].to_pylist(), np.float64)
            qids, quids = queries["query_id"].to_pylist(), queries["quid"].to_pylist()
            tops: list[list] = [[] for _ in asked]
            read, first = np.zeros(len(asked)), 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                block, stops = Lists(ids[a:b], uids[a:b], matrix[a:b]), []
                for at in range(0, len(asked), TOGETHER):
                    some = asked[at : at + TOGETHER]
                    known = np.array([-t[-1][0] if len(t) == k else -np.inf for t in tops[at : at + TOGETHER]])
                    left, depth = block.contenders(some, k, known, first)
                    stops.append(depth)
                    for j, own in enumerate(left):
                        own = own[block.uids[own] != quids[at + j]]
                        scores = block.vectors[own] @ some[j]
                        tops[at + j] = sorted([*tops[at + j], *zip((-scores).tolist(), block.ids[own].tolist(), block.uids[own].tolist(), strict=True)])[:k]
                stops = np.concatenate(stops)
                read += np.array(DEPTHS)[stops] * (b - a) / len(ids)
                first = int(np.median(stops))
            for j, top in enumerate(tops):
                found += [(quids[j], qids[j], i, int(-s), u, float(read[j])) for s, i, u in top]
        columns = [*zip(*found, strict=True)] if found else [[]] * 6
        names = ["quid", "query_id", "vec_id", "score", "uid", "read"]
        return pa.table({c: pa.array(x, pa.float64() if c == "read" else pa.int64()) for c, x in zip(names, columns, strict=True)})

    return best


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """The k best of all other rows for each row whose id is divisible by ``every``: query_id, rank, vec_id, score, read."""
    x = F.col("embedding")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter("vec_id is not null").filter(F.coalesce(whole, F.lit(False)))
    rows = rows.select("vec_id", F.monotonically_increasing_id().alias("uid"), F.transform("embedding", lambda v: F.floor(v * scale).cast("double")).alias("q"))
    rows = Scratch(spark, "topk").write(rows, "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    groups, chunks = max(1, -(-n // GROUP_ROWS)), max(1, -(-m // GROUP_QUERIES))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = rows.select("vec_id", "uid", "q", F.size("q").alias("d"), F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("g"), spread(chunks).alias("c"))
    # names and columns of their own: both sides of a cogroup come from one table
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("uid").alias("quid"), F.col("q").alias("query"), F.size("q").alias("d"), F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int").alias("c"), spread(groups).alias("g"))
    keys = ["d", "g", "c"]
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(best_of_group(k), "quid long, query_id long, vec_id long, score long, uid long, read double")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read")
