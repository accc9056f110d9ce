"""Drop lines that an earlier document already holds, with DataFrame functions only.

Every line becomes its key's 128-bit hash with document and position. Hashes
are dealt out by range, sorted by document and position within, and streamed:
whatever follows a key's first document is dropped. As hashes are uniform, the
ranges' bounds are computed and no data are sampled for them. A key may hold a
third of all rows, so this runs twice: first for each key and salt (of the document),
where a hot key is spread over as many groups as there are partitions, then for
each key's first documents of all salts. Dropped positions return as a compressed
bitmap for each document: the lengths of the runs of kept lines, one before each
dropped line. Texts are only touched again to apply it.

Cases: null or empty text is one empty line, which is kept; a null doc_id holds
no key and loses no line; rows that repeat a doc_id count as one document, so
they never drop each other's lines; an empty table gives an empty result; other
columns pass unchanged, of any name but those added. Keys shorter than
``SHORTEST`` code points are always kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.session import cut_lineage, partitions

#: Least length of a key in code points, and groups that a key is spread over at least.
SHORTEST, SALTS = 10, 16
#: Fixed value: what is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """A line stripped and with A-Z in lower case; only lines with other letters need the slow way."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, pos, h1, h2) of each line with a key; body tells rows apart that repeat a doc_id."""
    return (
        docs.where(F.col(doc_id).isNotNull() & (F.length(text) >= SHORTEST))
        .select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(F.transform(lines(F.col(text)), key)).alias("pos", "key"))
        .where(F.length("key") >= SHORTEST)
        .select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def dealt(rows: DataFrame, n: int, mixed: Column) -> DataFrame:
    """Rows in n ranges of a hash; ``lot`` is the range."""
    lot = F.least(F.floor((mixed / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")
    return rows.withColumn("lot", lot).repartitionById(n, F.col("lot"))


def late(group: list[str]) -> Column:
    """Whether a line's document comes after the first one that its group holds, in a stream sorted by document and position."""
    return F.col("doc") > F.first("doc").over(Window.partitionBy("lot", *group).orderBy("doc", "body", "pos"))


def dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, pos) of each line to drop."""
    n = partitions(docs.sparkSession)
    salted = occurrences(docs, doc_id, text).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(max(SALTS, n))).cast("int"))
    streamed = cut_lineage(dealt(salted, n, F.xxhash64("h1", "h2", "salt")).withColumn("late", late(["h1", "h2", "salt"])).drop("salt", "lot"))
    firsts = dealt(streamed.where(~F.col("late")), n, F.col("h1")).withColumn("late", late(["h1", "h2"])).drop("lot")
    return streamed.where("late").unionByName(firsts.where("late")).select("doc", "body", "pos")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, keep_runs) of each document that loses lines: lengths of the runs of kept lines, one before each dropped line."""
    ordered = dropped(docs, doc_id, text).groupBy("doc", "body").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    before = F.transform("at", lambda p, i: p - F.when(i == 0, -1).otherwise(F.get("at", i - 1)) - 1)
    return ordered.select("doc", "body", before.alias("keep_runs"))


def flags(runs: Column, n: Column) -> Column:
    """The bitmap of n lines that run lengths stand for, as an array of '1' and '0'."""
    bits = F.array_join(F.transform(runs, lambda k: F.concat(F.repeat(F.lit("1"), k), F.lit("0"))), "")
    return F.split(F.concat(bits, F.repeat(F.lit("1"), (n - F.length(bits)).cast("int"))), "")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """Documents with ``text`` less its dropped lines, and both counts added."""
    marks = keep_bitmaps(docs, doc_id, text).select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), "keep_runs")
    passed = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    wide = docs.select(*passed).select(F.struct(*passed).alias("_row"))
    own = (F.col(f"_row.{doc_id}"), F.col(f"_row.{text}"))
    met = wide.join(marks, (own[0] == F.col("_doc")) & (F.xxhash64(own[1]) == F.col("_body")), "left")
    met = met.withColumn("_lines", lines(own[1]))
    size = F.size("_lines")
    met = met.withColumn("_flags", F.when(F.col("keep_runs").isNotNull(), flags(F.col("keep_runs"), size)))
    kept = F.when(F.col("_flags").isNull(), own[1]).otherwise(F.array_join(F.filter("_lines", lambda x, i: F.get("_flags", i) == "1"), "\n"))
    columns = [(kept if c == text else F.col("_row").getField(c)).alias(c) for c in passed]
    return met.select(*columns, size.cast("long").alias(n_lines), F.coalesce(F.size("keep_runs"), F.lit(0)).cast("long").alias(n_dropped))
