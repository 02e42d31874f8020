"""Quality rules: an ordered decision list of threshold conjunctions, learned from labelled statistics.

Statistics of a text are DataFrame expressions. A list is learned by sequential covering: each rule grows by the
condition with the largest information gain on two thirds of the labelled rows, is pruned from its end on the other
third, and takes the rows it covers away; it ends when no rule is better than the default. The list becomes one
ordered CASE expression.

The labelled rows are a bounded sample (``max_labelled``, those with the smallest hash of their id); everything else
covers all rows. Defined cases: a null text has no words; nulls among the labels, and labels of unknown documents,
are ignored; a document labelled more than once counts with its smallest quality; without labels, or with one class
only, the list is empty and the base rules alone decide; repeated rows are judged alike; a text of any length is measured
whole (its words and their windows lie in memory, some 100 bytes a word); other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, row_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LABELLED = 20_000


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur twice or more in the array, first occurrences included."""

    def covered(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
            hit = F.filter(F.transform(pairs, lambda p, k: F.when(((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)), p["i"])), lambda x: x.isNotNull())
            return F.array_sort(hit)

        count = F.aggregate(
            let(order, starts),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(count)

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - window)
        return let(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(window)])), covered)

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) >= window, let(hashed, windows)).otherwise(F.lit(0))


def statistics(docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_letters of whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

    def of_words(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(joined) - F.length(F.translate(joined, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    # a generator of one row: no later filter is pushed below it, which would compute all this once more
    measured = F.explode(F.array(F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"))))
    out = docs.select(F.struct(*keep).alias("k"), measured.alias("m"))
    return out.select("k.*", "m.w.n_words", "m.w.word_chars", "m.w.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines")


def features() -> dict[str, Column]:
    """What rules may ask of a row of statistics()."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


class Bits:
    """Sets of rows as whole numbers: intersections and counts of thousands of rows in microseconds."""

    @staticmethod
    def of(flags) -> int:
        return int("".join("1" if f else "0" for f in flags)[::-1] or "0", 2)


def literals(rows: list[dict[str, float]], names: list[str], cuts: int) -> list[tuple[tuple[str, str, float], int]]:
    """Conditions feature <= cut and feature > cut, each with the set of rows it holds for; cuts lie half way between a quantile and the next larger value."""
    out = []
    for name in names:
        values = sorted(r[name] for r in rows)
        below = sorted({values[(len(values) - 1) * k // cuts] for k in range(cuts + 1)})
        for cut in [(v + values[at]) / 2 for v in below if (at := bisect_right(values, v)) < len(values)]:
            below = Bits.of(r[name] <= cut for r in rows)
            out += [((name, "<=", cut), below), ((name, ">", cut), ~below & ((1 << len(rows)) - 1))]
    return out


def precision(p: int, n: int) -> float:
    return (p + 1) / (p + n + 2)


def learn_rules(rows: list[dict[str, float]], bad: list[bool], *, cuts: int = 64, max_rules: int = 16, max_conditions: int = 4, min_cover: int = 5, min_precision: float = 0.8) -> list[list[tuple[str, str, float]]]:
    """Sequential covering for the class ``bad``; rows and bad in an order that is as good as random."""
    if not rows or all(bad) or not any(bad):
        return []
    every = literals(rows, list(rows[0]), cuts)
    full = (1 << len(rows)) - 1
    positive = Bits.of(bad)
    prune = Bits.of(i % 3 == 2 for i in range(len(rows)))
    left, rules = full, []
    while len(rules) < max_rules:
        grow_p, grow_n = left & ~prune & positive, left & ~prune & ~positive & full
        cover, rule = full, []
        while len(rule) < max_conditions and grow_n & cover:
            p0, n0 = (grow_p & cover).bit_count(), (grow_n & cover).bit_count()
            if not p0:
                break
            now, best, gain = log2(p0 / (p0 + n0)), None, 1e-9
            for literal, holds in every:
                p = (grow_p & cover & holds).bit_count()
                if p >= min_cover:
                    n = (grow_n & cover & holds).bit_count()
                    if (g := p * (log2(p / (p + n)) - now)) > gain:
                        best, gain = (literal, holds), g
            if best is None:
                break
            rule.append(best)
            cover &= best[1]
        kept, value = [], -1.0
        for k in range(len(rule), 0, -1):
            cover = left
            for _, holds in rule[:k]:
                cover &= holds
            p, n = (cover & prune & positive).bit_count(), (cover & prune & ~positive).bit_count()
            if (v := precision(p, n)) >= value:
                kept, value = rule[:k], v
        cover = left
        for _, holds in kept:
            cover &= holds
        p, n = (cover & positive).bit_count(), (cover & ~positive).bit_count()
        if not kept or p < min_cover or min(precision(p, n), value) < min_precision:
            break
        rules.append([literal for literal, _ in kept])
        left &= ~cover
    return rules


def rejected(rules: list[list[tuple[str, str, float]]], columns: dict[str, Column]) -> Column:
    """The list as an ordered CASE: the first rule that holds rejects, the default keeps."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, sign, cut in rule:
            holds &= (columns[name] <= F.lit(cut)) if sign == "<=" else (columns[name] > F.lit(cut))
        out = F.when(holds, True) if out is None else out.when(holds, True)
    return F.lit(False) if out is None else out.otherwise(False)


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[list[dict[str, float]], list[bool]]:
    """Features and classes of the labelled documents that pass the base rules, those with the smallest hashes of their ids, in the order of the hashes.

    Only about as many documents as are wanted are measured: those whose hash lies below a bound, which is doubled
    until enough of them pass or all labelled documents have been looked at."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, share, columns = rows.select("doc_id").join(known, "doc_id").count(), 2 * max_labelled, features()
    while True:
        below = F.xxhash64("doc_id", F.lit(11)) <= F.lit(min((1 << 63) - 1, -(1 << 63) + (1 << 64) * share // max(n, 1)))
        few = rows.filter(below).join(known.filter(below), "doc_id")
        passed = statistics(few, [F.col("doc_id"), F.col("quality")]).filter(~base_failed())
        found = passed.select(*[c.alias(k) for k, c in columns.items()], "quality", F.xxhash64("doc_id", F.lit(11)).alias("h"), "doc_id").orderBy("h", "doc_id", *columns).limit(max_labelled).collect()
        if len(found) == max_labelled or share >= n:
            return [{k: r[k] for k in columns} for r in found], [r.quality == 0 for r in found]
        share *= 2


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list | None = None, *, max_labelled: int = MAX_LABELLED, **options) -> DataFrame:
    """Statistics of every document with base_failed and kept, from rules learned on the labelled ones; the one pass over the texts is the caller's."""
    rules = learn_rules(*labelled_sample(spark, docs, labels, max_labelled), **options)
    stats = statistics(docs, [F.col("doc_id").cast("long").alias("doc_id"), *(keep or [])])
    failed = base_failed()
    return stats.withColumn("base_failed", failed).withColumn("kept", F.when(failed, False).otherwise(~rejected(rules, features())))


def kept_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    return judged(spark, docs, labels, [row_of(docs).alias("doc")], **options).filter("kept").select("doc.*")
