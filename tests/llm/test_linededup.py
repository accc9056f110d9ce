import hashlib
import re

from framewell.llm import linededup, queries

COPY = "Licensed under the Apache License."
DOCS = [
    (5, f"first\n{COPY}\nown line of five"),
    (2, f"  {COPY.upper()}\t\nx"),
    (9, f"{COPY}\n{COPY}\n\nshort\nshort"),
    (9, f"{COPY}\n{COPY}\n\nshort\nshort"),
    (9, "another text of nine\nown line of five"),
    (3, "short\nÉtait-ce une ligne ?"),
    (4, "short\nétait-ce une ligne ?"),
    (6, "Était-ce une ligne ?\x0b\x0c\r\n"),
    (7, None),
    (8, ""),
    (None, f"{COPY}\nnull id"),
    (10, COPY),
    (11, "\n".join(f"line number {k}" for k in range(3000))),
    (12, "\n".join(f"line number {k}" for k in range(0, 3000, 2))),
]


def brute(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first: dict[str, int] = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < 10 or first[key(x)] >= i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(repr(tuple(r)) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()) == brute(DOCS)


def test_bitmaps_are_runs_of_kept_lines(spark):
    docs = spark.createDataFrame([(1, "a line to drop"), (2, "one\ntwo\na line to drop\nthree\na line to drop")], "doc_id long, text string")
    rows = linededup.keep_bitmaps(docs).collect()
    assert [(r["doc"], r["keep_runs"]) for r in rows] == [(2, [2, 1])]


def test_other_columns_pass_and_clash(spark):
    docs = spark.createDataFrame([(1, "some text here", "x", "y", 7, 8)], "doc_id long, text string, doc string, keep_runs string, n_lines int, pos int")
    row = linededup.dedup(docs).first()
    assert (row["doc"], row["keep_runs"], row["n_lines"], row["pos"], row["text"]) == ("x", "y", 1, 8, "some text here")
    assert linededup.dedup(docs.where("false")).count() == 0
