"""One query for each operation, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import bpe, decontamination, labelled, langid, linededup, lmscore, nearcopies, neighbours, personal, quality, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary of the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.encode(docs, tokenizer_path(), decoded="decoded")
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(r"""
WITH l AS (
  SELECT r, doc_id, p, lines[p] AS line,
         translate(trim(lines[p], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS p
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT drop), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(doc_id > first, false) AS drop FROM l LEFT JOIN f USING (k)) GROUP BY r""")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Drop every line that an earlier document holds; counts, and a digest of the kept text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = linededup.dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def quality_scores(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with the quality score that is learned from the folds 0 and 2 of 3."""
    model = quality.fit(docs, table(spark, folder, "labels"), labelled.fold(F.col("doc_id"), 3) != 1)
    return quality.score(docs, model)


@query()
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every text."""
    scored = quality_scores(spark, table(spark, folder, "documents").select("doc_id", "text"), folder)
    held_out = F.coalesce(labelled.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the folds 1 to 4 of 5."""
    docs, fold = table(spark, folder, "documents"), labelled.fold(F.col("doc_id"), 5)
    model = langid.fit(docs.where(fold != 0))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score and toxic spans of every text, learned from the folds 1 to 4 of 5."""
    docs, fold = table(spark, folder, "documents").select("doc_id", "text"), labelled.fold(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, folder, "labels"), fold != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query()
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document, and the number of compared texts that its text is linked to."""
    return nearcopies.classes(table(spark, folder, "documents").select("doc_id", "text"))


@query()
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that a document holds, with its place and distance."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query()
def op8_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth vector."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.where(F.col("vec_id") % 50 == 0), 5)


@query()
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every text: counts and a digest of the rules' spans, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = personal.find(docs, personal.fit(docs))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query()
def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Pseudo-log-likelihood of every text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lmscore.fit_score(docs, keep_text=False)
