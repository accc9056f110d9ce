import random

import pyarrow as pa

from framewell.llm import decontamination, queries, words

R = random.Random(3)
VOCABULARY = [f"w{k}" for k in range(3000)]
ITEMS = [(k, " ".join(R.choice(VOCABULARY) for _ in range(R.randrange(8, 50)))) for k in range(60)] + [(60, "short item"), (61, ""), (62, None), (63, "!!")]


def edited(text, n):
    own = text.split()
    for _ in range(n):
        kind, at = R.choice("sid"), R.randrange(len(own))
        if kind == "s":
            own[at] = R.choice(VOCABULARY)
        elif kind == "i":
            own.insert(at, R.choice(VOCABULARY))
        elif len(own) > 1:
            own.pop(at)
    return " ".join(own)


def around(text):
    return " ".join([R.choice(VOCABULARY) for _ in range(70)] + [text] + [R.choice(VOCABULARY) for _ in range(40)])


def brute(item, text):
    """Least edit distance of item to a stretch of text."""
    cost = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        row = [k]
        for j, x in enumerate(text):
            row.append(min(cost[j] + (w != x), cost[j + 1] + 1, row[j] + 1))
        cost = row
    return min(cost)


def test_recall_and_precision_against_brute_force():
    index = decontamination.index([(i, t or "") for i, t in ITEMS])
    texts, truth = [], []
    for i, t in ITEMS[:60] * 4:
        texts.append(around(edited(t, R.randrange(0, int(0.2 * len(t.split())) + 2))))
        truth.append(i)
    found = index.find(words.normal(words.split(pa.array(texts))))
    met = missed = 0
    for text, i, rows in zip(texts, truth, found, strict=True):
        item = ITEMS[i][1].split()
        d = brute(item, text.split())
        got = [r for r in rows if index.ids[r[0]] == i]
        if d <= int(0.2 * len(item)):
            met += bool(got)
            missed += not got
        else:
            assert not got
        for k, a, b, distance in rows:
            own = ITEMS[index.ids[k]][1].split()
            assert distance == brute(own, text.split()[a:b]) <= int(0.2 * len(own))
    assert met / (met + missed) > 0.97


def test_query_offsets_and_cases(spark, tmp_path):
    item = ITEMS[5][1]
    docs = [(1, f"Before. {item.upper()}! after"), (2, None), (3, ""), (4, "a Short, item."), (5, f"{item} {item}"), (6, "clean text"), (6, "clean text"), (None, item)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = sorted(((r["doc_id"] or 0, r["item_id"], r["start"], r["end"], r["distance"]) for r in queries.op7_decontamination(spark, str(tmp_path)).collect()))
    n = len(item)
    assert rows == [(0, 5, 0, n, 0), (1, 5, 8, 9 + n, 0), (4, 60, 2, 14, 0), (5, 5, 0, n, 0), (5, 5, n + 1, 2 * n + 1, 0)]


def test_clean_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, around(t) if k % 2 else "nothing here", "x") for k, (_, t) in enumerate(ITEMS[:20])], "doc_id long, text string, leaks string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 20, 2))
    one = decontamination.leaks(docs, items, out="found").orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "BLOCK", 2000)
    several = decontamination.leaks(docs, items, out="found").orderBy("doc_id").collect()
    assert [sorted(r["found"]) for r in one] == [sorted(r["found"]) for r in several]
    assert decontamination.leaks(docs, items.where("false")).count() == 20 and decontamination.clean(docs.where("false"), items).count() == 0


def cut(own, n, r):
    """The words with n of them deleted or changed, one at least deleted."""
    own = list(own)
    own.pop(r.randrange(len(own)))
    for _ in range(n - 1):
        at = r.randrange(len(own))
        if r.random() < 0.5:
            own.pop(at)
        else:
            own[at] = r.choice(VOCABULARY)
    return own


def test_shortened_items_alone_and_at_a_texts_end():
    r = random.Random(8)
    items = [[r.choice(VOCABULARY) for _ in range(r.randrange(15, 40))] for _ in range(80)]
    index = decontamination.index([(k, " ".join(w)) for k, w in enumerate(items)])
    assert index.find(words.normal(words.split(pa.array([" ".join(items[0][:-1])]))))[0] == [(0, 0, len(items[0]) - 1, 1)]
    for before in (0, 70):
        texts = [" ".join([r.choice(VOCABULARY) for _ in range(before)] + cut(w, int(0.2 * len(w)), r)) for w in items]
        found = index.find(words.normal(words.split(pa.array(texts))))
        assert sum(any(row[0] == k for row in rows) for k, rows in enumerate(found)) >= 0.95 * len(items)
        for text, rows in zip(texts, found, strict=True):
            for k, a, b, distance in rows:
                assert distance == brute(items[k], text.split()[a:b]) <= int(0.2 * len(items[k]))


def test_recall_does_not_fall_with_an_items_length():
    r = random.Random(9)
    for size, n in ((40, 60), (160, 20), (320, 15)):
        items = [[r.choice(VOCABULARY) for _ in range(size)] for _ in range(n)]
        index = decontamination.index([(k, " ".join(w)) for k, w in enumerate(items)])
        texts = []
        for k, w in enumerate(items):
            own = cut(w, int(0.2 * size), r) if k % 2 else list(w)
            if k % 2 == 0:
                for at in r.sample(range(size), int(0.2 * size)):
                    own[at] = f"x{at}"
            texts.append(around(" ".join(own)))
        found = index.find(words.normal(words.split(pa.array(texts))))
        assert sum(any(row[0] == k for row in rows) for k, rows in enumerate(found)) >= 0.95 * n
        for text, rows in zip(texts, found, strict=True):
            for k, a, b, distance in rows:
                assert distance == brute(items[k], text.split()[a:b]) <= int(0.2 * size)


def test_occurrences_that_follow_each_other_are_found_each():
    r = random.Random(10)
    item = [r.choice(VOCABULARY) for _ in range(45)]
    index = decontamination.index([(0, " ".join(item))])
    near = [*item[:5], "xx", *item[6:]]
    for parts in ([item, item, item], [near, item, near], [near] * 6):
        rows = index.find(words.normal(words.split(pa.array([" ".join(w for p in parts for w in p)]))))[0]
        assert [(row[1], row[2]) for row in rows] == [(45 * k, 45 * k + 45) for k in range(len(parts))]
