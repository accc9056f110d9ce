"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most about; a hash of the document picks them.
MOST = 8_000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the document's id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = MOST) -> DataFrame:
    """(doc_id, text, label) of about ``most`` labelled documents where ``keep`` (on doc_id) holds.

    A document with several labels gets the largest. The chosen ids, bounded by
    ``most``, are broadcast, so the texts aren't shuffled.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(keep & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


def part(doc_id: str, n: int) -> Column:
    """A split of a sample that is independent of its folds."""
    return F.pmod(F.xxhash64(F.lit("part"), doc_id), F.lit(n))
