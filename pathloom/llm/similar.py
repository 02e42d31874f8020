"""Near-duplicates by SimHash with the generalised pigeonhole, min-hash bands for what it cannot reach, exact checks, components.

The first 64 bits of each set's SimHash sketch go through op3's pigeonhole (``simhash.near_pairs``): all fingerprints within
DISTANCE bits meet, and sets with one fingerprint meet its least. Every such pair is a candidate.

A similarity of 0.8 moves about 15 % of a SimHash's bits: a pigeonhole for that distance needs parts whose number grows
with the corpus (their width must grow with the logarithm of its size). So the other candidates meet in BANDS bands of ROWS
min-hashes, which sets of equal similarity share with the same probability in a corpus of any size: pairs of exactly
0.8 meet with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.988. SimHash sketches of 512 bits estimate the similarity of pairs
that meet, which rules most others out.

First each set is paired with the least of its fingerprint, each fingerprint with the least in reach, and each set with one
of each of its buckets, the least by hash; a checked link to the least of these collapses groups of near copies. Then all
sets of different components whose fingerprints are in reach, or that share a bucket of up to CROWD, are paired; in larger
ones (families of texts that are alike) blocks of BLOCK times BLOCK members, tasks of their own, count the shingles that
each two have in common, and give only links that join components: as many as members at most, however many pairs are
similar. No pair is linked without a check of its shingle sets.

Defined cases: texts with equal shingle sets (so all without words) are copies; a text of fewer words is one shingle;
of a group the document with the smallest id stays (null ids last, of repeated rows one); an empty table gives no
rows; a text of any length is read whole, one at a time; other columns stay as they were.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, release, row_of, tidy
from .simhash import components, near_pairs

BANDS, ROWS = 24, 8
WORDS64 = 8
BITS = 64 * WORDS64
#: So far below the wanted similarity, and by 1 / n more for sets of n shingles, an estimate (standard error 0.04) rules a pair out.
BELOW = 0.20
#: Fingerprints of 64 bits within so many bits meet, as in op3.
DISTANCE = 3
#: Larger buckets are crowded; their members are compared in blocks, of up to BLOCK members and about BLOCK_SHINGLES shingles a side.
CROWD, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 21
#: Columns of a block's incidence matrix that are multiplied at a time.
SLAB = 4096


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, sorted."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[: len(tokens) - words].tolist()]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, words64: int = WORDS64) -> np.ndarray:
    """Bits as 64-bit words: a bit is set if it is set in over half the shingles."""
    counts = np.zeros(64 * words64, np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        every = mixed(part[:, None] + np.arange(1, words64 + 1, dtype=np.uint64) * step)
        bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        for row in range(0, len(bits), 255):  # sums of up to 255 ones fit a byte
            counts += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: what its min-hashes are."""
    if not len(hashes):
        return mixed(np.arange(BANDS, dtype=np.uint64))
    numbers = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)[:, None]
    factor, shift = mixed(numbers) | np.uint64(1), mixed(numbers + np.uint64(BANDS * ROWS))
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[None, at : at + 1024] * factor + shift) >> np.uint64(32)).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, node (128 bits of the shingle set, as text), n (its size), sketch, keys (of the bands)."""
    names = ["row", "doc_id", "node", "n", "sketch", "keys"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def of(batches):
        for batch in batches:
            out = []
            for row, key, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                h = shingle_set(text.as_py(), words)
                out.append((row, key, node_of(h), len(h), sketch(h).view(np.int64).tolist(), band_keys(h).view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        release()

    return docs.select("row", "doc_id", "text").mapInArrow(of, "row long, doc_id long, node string, n long, sketch array<long>, keys array<long>")


def node_of(hashes: np.ndarray) -> str:
    """A name of the set, 128 bits of a hash of its members in order."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def meetings(nodes: DataFrame) -> DataFrame:
    """key, node, size, first: the nodes that meet others in a band, with the bucket's size and the least node by hash."""
    met = nodes.select(F.explode("keys").alias("key"), "node")
    least = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node")))
    buckets = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"), least.alias("first")).filter("size > 1")
    return met.join(buckets.select("key", "size", F.col("first.node").alias("first")), "key")


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def in_small_buckets(met: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes of different components that share a bucket of up to CROWD; met: with roots, in buckets of several."""
    lists = met.filter(F.col("size") <= CROWD).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("m"))
    one = lists.select("m", F.explode("m").alias("x"))
    both = one.select("x", F.explode(F.filter("m", lambda y: (y["node"] > F.col("x.node")) & (y["root"] != F.col("x.root")))).alias("y"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, n, hashes: the sets as sorted 64-bit numbers, in bytes."""

    def of(batches):
        for batch in batches:
            sets = [shingle_set(text.as_py(), words) for text in batch["text"]]
            hashes = pa.array([h.tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([len(h) for h in sets], pa.int64()), hashes], names=["node", "n", "hashes"])

    return texts.select("node", "text").mapInArrow(of, "node string, n long, hashes binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left has in common with each on the right."""
    common = np.intersect1d(*(np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)))
    out = np.zeros((len(left), len(right)), np.float64)
    if not len(common):
        return out
    sides = []
    for sets in (left, right):
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.minimum(np.searchsorted(common, values), len(common) - 1)
        held = common[column] == values
        row, column = row[held], column[held]
        order = np.argsort(column, kind="stable")
        sides.append((len(sets), row[order], column[order]))
    for at in range(0, len(common), SLAB):
        dense = []
        for size, row, column in sides:
            a, b = np.searchsorted(column, [at, at + SLAB])
            part = np.zeros((size, min(SLAB, len(common) - at)), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def joining(near: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Pairs out of a symmetric matrix that join all groups which its pairs join, one pair for each group less."""
    group, out = group.copy(), []
    for i in range(len(near)):
        others = np.flatnonzero(near[i] & (group != group[i]))
        for j in others.tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def in_crowds(scratch: Scratch, met: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a < b) that join all components of which members share a larger bucket and have the similarity; met: with roots, in buckets of several."""
    crowd = met.filter(F.col("size") > CROWD)
    sets = scratch.write(shingle_sets(texts.join(crowd.select("node").distinct(), "node", "left_semi"), words), "sets")
    before = Window.partitionBy("key").orderBy("root", "node")
    filled = [F.floor((F.row_number().over(before) - 1) / BLOCK), F.floor((F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) / BLOCK_SHINGLES)]
    chunk = F.dense_rank().over(Window.partitionBy("key").orderBy("full", "long")).cast("int")
    numbered = crowd.join(sets.select("node", "n"), "node").select("key", "node", "root", filled[0].alias("full"), filled[1].alias("long"))
    members = scratch.write(numbered.select("key", "node", "root", chunk.alias("chunk")), "members")
    chunks = members.groupBy("key", "chunk").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    x, y = (chunks.select("key", F.col("chunk").alias(c), F.col("lo").alias(f"lo{c}"), F.col("hi").alias(f"hi{c}")) for c in "ij")
    blocks = x.join(y, "key").filter("i <= j and least(loi, loj) <> greatest(hii, hij)")
    sides = blocks.select("key", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("chunk"))

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by([("chunk", "ascending"), ("node", "ascending")])
        chunk, node = block["chunk"].to_numpy(), block["node"].to_pylist()
        hashes = [np.frombuffer(h, np.uint64) for h in block["hashes"].to_pylist()]
        cut = int(np.searchsorted(chunk, block["i"][0].as_py(), side="right"))
        left, right = (hashes[:cut], hashes[cut:]) if cut < len(node) else (hashes, hashes)
        n = np.array([len(h) for h in hashes], float)
        shared = shared_counts(left, right)
        alike = shared >= similarity * (n[: len(left)][:, None] + n[len(n) - len(right) :][None, :] - shared)
        near = alike
        if cut < len(node):
            near = np.zeros((len(node), len(node)), bool)
            near[:cut, cut:] = alike
            near |= near.T
        links = joining(near, np.unique(np.array(block["root"].to_pylist(), object), return_inverse=True)[1])
        pairs = [(min(node[i], node[j]), max(node[i], node[j])) for i, j in links]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string())})

    dealt = members.join(sides, ["key", "chunk"]).join(sets, "node").select("key", "i", "j", "chunk", "node", "root", "hashes")
    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a string, b string").distinct()


def fingerprint_pairs(spark: SparkSession, scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of nodes by the generalised pigeonhole: each with the least of its fingerprint and each fingerprint with the least in reach; and all fingerprints in reach, by their least nodes. Both written."""
    prints = nodes.select("node", F.col("sketch")[0].alias("fp"))
    least = scratch.write(prints.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    side = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"n{x}"))
    reach = near_pairs(spark, least.select("fp"), DISTANCE).distinct().join(side("a"), "a").join(side("b"), "b")
    reach = scratch.write(reach.select(*ordered(F.col("na"), F.col("nb"))), "reach")
    same = prints.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    first = reach.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    return scratch.write(same.unionByName(first), "near-first"), reach


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the similarity that the sketches and the sets' sizes let expect."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    shared = F.cos(differ * F.lit(pi / BITS)) * F.sqrt(F.col("na") * F.col("nb"))
    return both.select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("estimate"), F.least("na", "nb").alias("n"))


def exact(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs whose shingle sets have the similarity."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["ta"], batch["tb"], strict=True):
                a, b = shingle_set(x.as_py(), words), shingle_set(y.as_py(), words)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(check, "a string, b string")


def rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds the components of nodes that meet, and keeps buckets that hold several."""
    of = met.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    several = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return of.join(several, "key", "left_semi")


def first_of_each(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, its columns as they were."""
    scratch, steps = Scratch(spark, "similar"), [Scratch(spark, f"similar-{x}") for x in ("copies", "small", "crowds")]
    rows = scratch.write(docs.select(row_of(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = scratch.write(sketches(rows.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")), words), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    nodes = scratch.write(found.groupBy("node").agg(F.min(order).alias("first"), *[F.min(c).alias(c) for c in ("n", "sketch", "keys")]), "nodes")
    scratch.drop("sketches")
    met = scratch.write(meetings(nodes.select("node", "keys")), "met")
    texts = nodes.select("node", F.col("first.row").alias("row")).join(rows.select("row", F.col("doc.text").cast("string").alias("text")), "row")
    tidy(spark)
    close, reach = fingerprint_pairs(spark, scratch, nodes)

    def checked(some: DataFrame, name: str) -> DataFrame:
        some = scratch.write(some, f"{name}-pairs")
        ends = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        out = scratch.write(exact(some, texts.join(ends, "node", "left_semi"), words, similarity), name)
        scratch.drop(f"{name}-pairs")
        return out

    def grown(links: DataFrame, step: int) -> DataFrame:
        """Components once these links are added."""
        known = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links) if step else links
        out = scratch.write(components(spark, known, steps[step]), f"groups{step}")
        steps[step].drop()
        tidy(spark)
        return out

    # links of fingerprints, and one likely link of each node, to the least that it meets, collapse most groups
    likely = estimated(met.filter("node <> first").select(*ordered(F.col("first"), F.col("node"))).distinct(), nodes).filter(F.col("estimate") >= similarity)
    earlier = F.struct(F.xxhash64("a"), "a") < F.struct(F.xxhash64("b"), "b")
    least, later = F.when(earlier, F.col("a")).otherwise(F.col("b")), F.when(earlier, F.col("b")).otherwise(F.col("a"))
    firsts = likely.select(least.alias("least"), later.alias("later")).groupBy("later").agg(F.min(F.struct(F.xxhash64("least"), "least")).alias("f"))
    firsts = firsts.select(*ordered(F.col("f.least"), F.col("later"))).unionByName(close)
    groups = grown(checked(firsts.distinct(), "copies"), 0)
    near = F.col("estimate") >= similarity - BELOW - 1 / F.greatest("n", F.lit(1))
    side = lambda x: groups.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = reach.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    small = estimated(in_small_buckets(scratch.write(rooted(met, groups), "apart0")), nodes).filter(near).select("a", "b")
    groups = grown(checked(small.unionByName(apart).distinct(), "small"), 1)
    apart = scratch.write(rooted(met.filter(F.col("size") > CROWD), groups), "apart1")
    if not apart.isEmpty():
        groups = grown(in_crowds(scratch, apart, texts, words, similarity), 2)
    kept = nodes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = scratch.write(kept.select(F.col("first.row").alias("row")), "kept")
    scratch.keep("rows", "kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")
