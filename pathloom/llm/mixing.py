"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, index permutations.

The words of a source, its documents in a pseudorandom order, are cut into blocks of ``block_words``. Output shards
hold ``slots``; a hash-uniform draw gives each slot a source, which makes multinomial counts per shard. The k-th slot
of a source takes block ``perm(k)``, a pseudorandom permutation of the source's block numbers for each pass, of which
there are ``cap`` at most; the draws that exceed a source's share of blocks go on to sources that lack some, so totals
hold to within a block. Permutations are keyed swap-or-not networks, which are exact over any range of numbers.
Everything is a DataFrame expression, sources included, of which there may be any number: the driver sees sums alone.

Defined cases: a null text has no words, size 0 and nothing taken; a null source is a source of its own, in the last
place; sources take the weights 5, 2, 1 repeating in code-point order; repeated rows are documents of their own; a text
of any length is counted whole and cut at its blocks (its words lie in memory, once, where its pieces are written out);
an empty table gives no rows; other columns are ignored. Runs over the same rows agree, however they are partitioned.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, row_of

#: Rounds of the permutation.
ROUNDS = 16
#: Sources for each partition of their table, at the least, and buckets of numbers that draws meet sources in.
LEAST_BUCKETS = 64


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 to n - 1: in each round x and k - x (modulo n) trade places if a hash of the larger of the two says so."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit(1)), n) - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, other)) < 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, turn)


def before(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of the column over all rows of smaller place; rows of a part follow those of smaller parts."""
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = df.groupBy("part").agg(F.sum(value).alias("s")).select("part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    return df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, "part").withColumn(name, (F.col(name) + F.col("base")).cast("long")).drop("base")


def located(points: DataFrame, at: str, spans: DataFrame, lo: str, length: str, total: int, n_spans: int) -> DataFrame:
    """Each point with the span [lo, lo + length) of 0 to total that it lies in; both meet in buckets of numbers, of which a long span has many."""
    width = F.lit(-(-total // max(LEAST_BUCKETS, min(n_spans, 1 << 20))) or 1)
    bucket = lambda c: F.floor(c / width).cast("long")
    cut = spans.filter(F.col(length) > 0).withColumn("bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(lo) + F.col(length) - 1))))
    return points.withColumn("bucket", bucket(F.col(at))).join(cut, "bucket").filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(lo) + F.col(length))).drop("bucket")


def measured(docs: DataFrame, keep: list) -> DataFrame:
    """Rows with a number of their own (once written), their source and size in words."""
    return docs.select(*keep, F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.monotonically_increasing_id().alias("uid"))


def water_level(sources: DataFrame, share: Fraction, cap: int) -> Fraction | None:
    """What a weight of 1 gets, so that targets of weight * level, held to cap * size, add up to share * all sizes; None if all are held. Rounds of two sums: sources above their limit leave their excess to the others, until none is above."""
    wide = lambda c: c.cast("decimal(38,0)")
    total, weights = sources.agg(F.sum(wide(F.col("size"))), F.sum("weight")).first()
    if not weights:
        return None
    level = share * int(total or 0) / int(weights)
    while True:
        over = wide(F.col("weight")) * F.lit(str(level.numerator)).cast("decimal(38,0)") > wide(F.col("size")) * F.lit(str(cap * level.denominator)).cast("decimal(38,0)")
        held, open_ = sources.agg(F.sum(F.when(over, wide(F.col("size")))), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_:
            return None
        new = (share * int(total) - cap * int(held or 0)) / int(open_)
        if new == level:
            return level
        level = new


def plan_sources(rows: DataFrame, scratch: Scratch, weights, share, cap, block_words) -> DataFrame:
    """One row for each source, in the order of their places: part, place, source, source_size, target, blocks, slots, and lo, the sum of slots before."""
    order = F.col("source").asc_nulls_last()
    ranged = rows.groupBy("source").agg(F.sum("size").alias("size")).repartitionByRange(order).sortWithinPartitions(order)
    ranged = scratch.write(ranged.select("source", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "source_sizes")
    ranks = before(ranged.withColumn("one", F.lit(1).cast("long")), "one", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = scratch.write(ranks.select("part", F.col("rank").alias("place"), "source", "size", weight.cast("long").alias("weight")), "source_weights")
    level = water_level(sources, share, cap)
    most = (F.col("size") * cap).cast("double")
    target = most if level is None else F.least(F.col("weight") * F.lit(level.numerator / level.denominator), most)
    blocks = F.ceil(F.col("size") / block_words).cast("long")
    planned = sources.withColumn("target", target).withColumn("blocks", blocks)
    slots = F.when(F.col("size") > 0, F.least(cap * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    planned = before(planned.withColumn("slots", slots), "slots", "lo")
    return scratch.write(planned.select("part", "place", "source", F.col("size").alias("source_size"), "target", "blocks", "slots", "lo"), "sources")


def placed(rows: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """Adds the first word's number in the source's sequence of words, by sums within buckets and over buckets."""
    buckets = 1024
    while n_rows / buckets > 50_000:
        buckets *= 2
    rows = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop("source")
    rows = rows.withColumn("mix", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("bucket", F.pmod("mix", F.lit(buckets)))
    inside = Window.partitionBy("place", "bucket").orderBy("mix", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("in_bucket")).select("place", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("base"))
    return rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(sums, ["place", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("mix", "bucket", "base")


def drawn_blocks(spark: SparkSession, sources: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """How often each block is taken: place, block, times."""
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    per_shard = min(65_536, max(512, total // 16_384))
    drawn = spark.range(total).withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))))
    drawn = located(drawn, "u", sources.select("place", "lo", "slots"), "lo", "slots", total, n_sources)
    slots = drawn.select("id", F.floor(F.col("id") / per_shard).alias("shard"), "place")
    counts = scratch.write(slots.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n")), "shard_counts")
    inside = Window.partitionBy("shard", "place").orderBy("id")
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    slots = slots.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "place"]).select("place", (F.col("rank") + F.col("base")).alias("k"))
    # a draw beyond its source's slots takes, in order, the slots that other sources lack
    of = sources.join(counts.groupBy("place").agg(F.sum("n").alias("n")), "place", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = of.withColumn("over", F.greatest(F.col("n") - F.col("slots"), F.lit(0))).withColumn("lack", F.greatest(F.col("slots") - F.col("n"), F.lit(0)))
    of = scratch.write(before(before(of, "over", "over_lo"), "lack", "lack_lo").select("place", "blocks", "slots", "n", "over_lo", "lack", "lack_lo"), "balance")
    moved = of.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]
    slots = slots.join(of.select("place", "blocks", "slots", "over_lo"), "place")
    own = slots.filter("k < slots").select("place", "blocks", "k")
    extra = slots.filter("k >= slots").select((F.col("over_lo") + F.col("k") - F.col("slots")).alias("e"))
    extra = located(extra, "e", of.select("place", "blocks", "n", "lack", "lack_lo"), "lack_lo", "lack", moved, n_sources)
    slots = own.unionByName(extra.select("place", "blocks", (F.col("n") + F.col("e") - F.col("lack_lo")).alias("k")))
    turn = F.floor(F.col("k") / F.col("blocks"))
    at = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("place"), turn)
    return slots.select("place", at.alias("block")).groupBy("place", "block").agg(F.count(F.lit(1)).alias("times"))


def mixed(spark: SparkSession, rows: DataFrame, scratch: Scratch, *, weights=(5, 2, 1), share=Fraction(3, 2), cap: int = 2, block_words: int = 128, seed: int = 1) -> DataFrame:
    """Pieces of documents that the mix takes, from written rows of measured(): doc_id, uid, size, source_size, target, lo and hi (words in the document), times (0 and above); a document without words has one row with nulls."""
    sources = plan_sources(rows, scratch, weights, share, cap, block_words)
    docs = placed(rows.select("doc_id", "source", "size", "uid"), sources.select("source", "place", "source_size", "target"), rows.count())
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    pieces = pieces.withColumn("lo", F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))).withColumn("hi", F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size")))
    taken = drawn_blocks(spark, sources, seed, scratch)
    return pieces.join(taken, ["place", "block"], "left").select("doc_id", "uid", "size", "source_size", "target", "lo", "hi", F.when(F.col("lo").isNotNull(), F.coalesce("times", F.lit(0))).alias("times"))


def mix_counts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken."""
    scratch = Scratch(spark, "mix")
    rows = scratch.write(measured(docs, ["doc_id"]), "rows")
    pieces = mixed(spark, rows, scratch, **options)
    words = F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("times")), F.lit(0))
    return pieces.groupBy("uid", "doc_id", "size", "source_size", "target").agg(words.cast("long").alias("taken")).drop("uid")


def mix_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass over a document, its taken words in order; all of them are the text as it was. n_chars follows the text."""
    scratch = Scratch(spark, "mix")
    rows = scratch.write(measured(docs, ["doc_id", row_of(docs).alias("doc")]), "rows")
    pieces = mixed(spark, rows, scratch, **options).filter("times > 0")
    spans = pieces.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("spans"))
    out = rows.join(spans, "uid").withColumn("pass", F.explode(F.sequence(F.lit(1), F.array_max(F.col("spans.times")).cast("int"))))
    taken = F.filter("spans", lambda s: s["times"] >= F.col("pass"))
    out = out.withColumn("taken", taken).withColumn("n_taken", F.aggregate("taken", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]))
    pieced = F.expr(rf"transform(array(regexp_extract_all(coalesce(doc.text, ''), '{WORD.replace(chr(92), chr(92) * 2)}', 0)), w -> array_join(flatten(transform(taken, s -> slice(w, cast(s.lo + 1 as int), cast(s.hi - s.lo as int)))), ' '))[0]")
    out = out.withColumn("words", F.when(F.col("n_taken") == F.col("size"), F.col("doc.text")).otherwise(pieced))
    changed = {"text": F.col("words"), "n_chars": F.length("words")}
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])
