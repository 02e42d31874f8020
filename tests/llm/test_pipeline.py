from collections import defaultdict

import corpus_pipeline
from pathloom.llm import mixing, quality
from pyspark.sql import functions as F

from . import test_quality, test_suffixes
from .fixtures import TEXTS, documents


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, made = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        made[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{i}"))
        if name != "packed_sequences":
            assert docs.columns == columns
    before, after = made["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, *_, repeated = test_quality.brute(r.text)
        assert r.doc_id not in kept or (n >= 20 and 100 * repeated <= 30 * n)
    assert 0 < len(kept) < before.count()
    before, after = made["near_duplicates"]
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    texts = [r.text for r in after.collect()]
    assert len(texts) == len(set(texts)) and {r.text for r in before.collect()} >= set(texts)
    before, after = made["repeated_passages"]
    removed = {r[0]: r for r in test_suffixes.brute([(r.doc_id, r.text) for r in before.collect()], 400)}
    text = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert (r.text == text[r.doc_id]) == (removed[r.doc_id][2] == 0) and r.n_chars == len(r.text)
    assert {r.doc_id for r in after.collect()} == {i for i, r in removed.items() if r[2] < r[1]}
    before, after = made["mixed_sources"]
    passes = defaultdict(int)
    for r in after.collect():
        passes[r.doc_id] += 1
    assert max(passes.values()) <= 2
    words = sum(len(r.text.encode().split()) for r in after.collect())
    assert words == sum(r.taken for r in mixing.mix_counts(spark, before).collect())
    before, after = made["packed_sequences"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_runs_do_not_touch_each_other(spark, sf_dir):
    first = corpus_pipeline.run(spark, sf_dir)
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50), dict(corpus_pipeline.STAGES)
    passages = stages["repeated_passages"](spark, docs, sf_dir)
    mix = stages["mixed_sources"](spark, docs, sf_dir)
    assert first.count() > 0 and passages.count() > 0 and mix.count() > 0
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(first.columns)


def test_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clean = (77, " ".join(f"word{i * i % 1009}" for i in range(300)), None)
    for rows in ([*TEXTS, clean], []):
        docs = documents(spark, rows).withColumns({"a.b": F.lit(1), "kept": F.lit("k"), "n_bytes": F.lit(None).cast("int")})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(out := f"{tmp_path}/{len(rows)}-{name}")
            docs = spark.read.parquet(out)
            assert name == "packed_sequences" or docs.columns == columns
        assert (docs.count() > 0) == bool(rows)
    assert quality.features()
