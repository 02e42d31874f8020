import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pathloom.llm import mixing, queries
from pyspark.sql import functions as F

from .fixtures import TEXTS, documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, Fraction(3 * sum(sizes.values()), 2)
    while True:
        free = [s for s in names if s not in fixed]
        give = {s: (left - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if give[s] > 2 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (fixed | give).items()}
        fixed |= {s: Fraction(2 * sizes[s]) for s in over}


def check(docs, got, slack):
    sizes, taken = Counter(), defaultdict(int)
    for d in docs:
        sizes[d.source] += len(WORD.findall(d.text or ""))
    targets, source = brute_targets(sizes), {d.doc_id: d.source for d in docs}
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    assert sorted(map(str, (d.doc_id for d in docs))) == sorted(str(r.doc_id) for r in got)
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= slack, (s, taken[s], t)


def test_query(spark, sf_dir):
    got = queries.op10_mixing(spark, sf_dir)
    check(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), got.collect(), 256)
    assert rows_of(got) == rows_of(queries.op10_mixing(spark, sf_dir))


def test_awkward_rows(spark):
    docs = documents(spark)
    got = mixing.mix_counts(spark, docs)
    check(docs.collect(), got.collect(), 256)
    assert len(got.collect()) == len(TEXTS)
    assert rows_of(got) == rows_of(mixing.mix_counts(spark, docs.repartition(7)))
    assert mixing.mix_counts(spark, documents(spark, [])).count() == 0
    assert mixing.mix_counts(spark, documents(spark, [(1, None, "a"), (2, "", None)])).count() == 2


def test_documents_of_the_mix(spark):
    docs = documents(spark)
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns
    counts = {(r.doc_id, r["size"]): 0 for r in mixing.mix_counts(spark, docs).collect()}
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    assert words == sum(r.taken for r in mixing.mix_counts(spark, docs).collect()) and counts
    texts = {t for _, t, _ in TEXTS}
    assert any(r.text in texts for r in out.collect())
    assert mixing.mix_documents(spark, documents(spark, [])).count() == 0


def test_many_sources_and_targets(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 700) AS source", "repeat('w ', cast(1 + (id * 37) % 90 AS int)) AS text")
    got = mixing.mix_counts(spark, docs, block_words=4)
    check(docs.collect(), got.collect(), 8)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_one_of_all_numbers(spark, n):
    at = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(2))
    got = [r.at for r in spark.range(n).select(at.alias("at")).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or sum(abs(a - i) for i, a in enumerate(got)) > n * n / 5)


def test_permutation_of_huge_ranges(spark):
    n = (1 << 62) - 57
    at = mixing.permuted(F.lit(n) - 1 - F.col("id"), F.lit(n), F.lit(5))
    got = [r.at for r in spark.range(500).select(at.alias("at")).collect()]
    assert len(set(got)) == 500 and all(0 <= x < n for x in got)
