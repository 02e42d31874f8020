import re
from collections import Counter

from pathloom.llm import queries, quality

from .fixtures import TEXTS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + d for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for d in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    got = quality.statistics(documents(spark), ["doc_id", "text"]).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for d in docs:
        r, want = got[d.doc_id], brute(d.text)
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept in ((False,) if r.base_failed else (True, False))
    right = sum(got[i].kept == bool(q) for i, q in labels.items() if not got[i].base_failed)
    assert right >= 0.8 * sum(not got[i].base_failed for i in labels)


def test_learning_finds_a_planted_rule():
    rows = [{"a": float(i % 10), "b": float(i * 7 % 11)} for i in range(600)]
    bad = [r["a"] > 6 and r["b"] <= 4 for r in rows]
    rules = quality.learn_rules(rows, bad)
    hit = lambda r: any(all(r[n] <= c if s == "<=" else r[n] > c for n, s, c in rule) for rule in rules)
    assert [hit(r) for r in rows] == bad


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judged(spark, documents(spark), labels).collect()
    assert len(got) == len(TEXTS) and all(r.kept != r.base_failed for r in got)
    assert quality.judged(spark, documents(spark, []), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (3, None, 0), (99, 0, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept_documents(spark, documents(spark), nulls).columns == documents(spark).columns


def test_sample_is_full_where_most_labels_have_no_row(spark):
    prose = " ".join(f"w{i}" for i in range(25))
    docs = documents(spark, [(i, prose if i % 3 else "too short", "s") for i in range(60)])
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    rows, bad = quality.labelled_sample(spark, docs, labels, 25)
    assert len(rows) == len(bad) == 25
    want = spark.range(60).filter("id % 3 > 0").selectExpr("id", "xxhash64(id, 11) AS h").orderBy("h").limit(25).collect()
    assert bad == [r.id % 2 == 0 for r in want]


def test_statistics_are_computed_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = quality.kept_documents(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
