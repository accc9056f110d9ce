import random
from collections import Counter

import numpy as np
import pyarrow as pa

from framewell.llm import nearcopies, words


def bag(text):
    w = [x for x in map(words.bare, (text or "").split()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs):
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [bag(t) for _, t in docs]
    for a in range(len(docs)):
        for b in range(a):
            both = (bags[a] & bags[b]).total()
            if both and both >= 0.8 * (bags[a] | bags[b]).total():
                root[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min((x for x in (i, least.get(find(k))) if x is not None), default=None)
    return sorted((i is None, i, least[find(k)]) for k, (i, _) in enumerate(docs))


def made(seed=1, families=12, copies=25):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, number = [], 0
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 200))]
        for _ in range(r.randrange(1, copies)):
            own = list(base)
            for _ in range(r.randrange(0, 8)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            docs.append((number, " ".join(own)))
            number += 1
    docs += [(number + k, t) for k, t in enumerate(["", None, "one two", "One, two!", "same same " * 40, "same same " * 41, "same same " * 80, "!!! ???"])]
    docs += [docs[3], (None, docs[5][1]), (docs[5][0], "a text of its own that repeats an id of another")]
    r.shuffle(docs)
    return docs


def test_classes_equal_brute_force(spark):
    docs = made()
    found = nearcopies.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["class_id"]) for r in found) == brute(docs)


def test_large_buckets_lose_no_link(spark):
    docs = made(seed=7, families=2, copies=160)
    found = nearcopies.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["class_id"]) for r in found) == brute(docs)


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    a = r.integers(1, 12, 80)
    b = np.where(r.random(80) < 0.7, a, r.integers(1, 12, 80))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for t in range(60):
        h = words.hashes([f"{t} {k}" for k in range(80)]) >> np.uint64(20)
        s = nearcopies.signatures(np.repeat([0, 1], 80), np.concatenate([h, h]), np.concatenate([a, b]), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - true) < 0.02


def test_dedup_keeps_one_of_each_class_and_all_without_words(spark):
    docs = made()
    kept = [r["doc_id"] for r in nearcopies.dedup(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, bucket string")).collect()]
    rows = brute(docs)
    wordless = [i for i, t in docs if not bag(t)]
    assert sorted(kept) == sorted({c for _, i, c in rows if i not in wordless} | set(wordless))
    assert nearcopies.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slices_of_a_few_words_in_all():
    for text, n in (("", 0), ("one", 1), ("one two", 1), ("one two three", 1), ("one two three four", 1), ("one two three four five", 1), ("one two three four five six", 2)):
        alone = nearcopies.shingles(words.normal(words.split(pa.array([text]))))
        among = nearcopies.shingles(words.normal(words.split(pa.array([text, "and many other words that follow in the slice"]))))
        own = among[0] == 0
        assert len(alone[1]) == n and alone[1].tolist() == among[1][own].tolist() and alone[2].tolist() == among[2][own].tolist()


def test_a_table_of_one_short_text(spark):
    for text in ("two words", "now three words"):
        rows = nearcopies.classes(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
        assert [(r["doc_id"], r["class_id"]) for r in rows] == [(7, 7)]
