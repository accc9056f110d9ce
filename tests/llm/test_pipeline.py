import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_every_stage_does_its_part(spark, tmp_path):
    from framewell.llm import bpe, decontamination, labelled, nearcopies, quality
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), docs
        kept[name] = (before, docs)
    before, after = kept["quality"]
    model = quality.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"), labelled.fold(F.col("doc_id"), 3) != 1)
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in quality.score(before, model).where("score >= 0.5").select("doc_id").collect()}
    before, after = kept["line_dedup"]
    assert before.count() == after.count() and after.where("n_chars <> length(text)").count() == 0
    before, after = kept["minhash"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in nearcopies.classes(before).select("class_id").collect()}
    before, after = kept["decontamination"]
    leaky = decontamination.leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("size(leaks) > 0").select("doc_id")
    assert after.count() == before.count() - leaky.count() and after.join(leaky, "doc_id").count() == 0
    before, after = kept["bpe"]
    assert after.count() == before.count() and after.where("decoded <> text").count() == 0
    assert after.select("token_ids").first()["token_ids"] == bpe.encode(before, corpus_pipeline.tokenizer_path()).select("token_ids").first()["token_ids"]


def test_cases(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", None, None, None, "x"), (None, "a text without an id", "en", "s", 20, "x"), (3, "word " * 30000, "en", "s", 150000, "x"), (4, "twice twice", "en", "s", 11, "x"), (4, "twice twice", "en", "s", 11, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaks string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.where("false")):
        given.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert len(found) == (5 if given is docs else 0)
