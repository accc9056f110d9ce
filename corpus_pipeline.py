"""Clean a document table: each stage reads what the one before kept.

Nulls: a null text counts as empty; a null doc_id stays through all stages.
Repeated rows are dropped by the near-duplicate stage, but for texts without
words. Empty tables pass. Columns beyond those of documents pass unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import bpe, decontamination, labelled, linededup, nearcopies, quality
from framewell.llm.queries import table, tokenizer_path
from framewell.session import checkpoint_dir, reach, remove


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it no column's."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the folds 0 and 2 of 3, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 3) != 1)
    name = unused(docs, "quality")
    return quality.score(docs, model, out=name).where(F.col(name) >= 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier document holds; n_chars follows."""
    kept = linededup.dedup(docs, n_lines=unused(docs, "n_lines"), n_dropped=unused(docs, "n_dropped")).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return nearcopies.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept text, their count, and their decoding."""
    return bpe.encode(docs, tokenizer_path(), decoded="decoded")


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("minhash", drop_copies), ("decontamination", drop_leaks), ("bpe", encode)]
#: No SQL for the classifier, the near-duplicate classes and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder, read again, and deleted when the next one stands."""
    reach(spark)
    docs, root = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
