"""Held-out accuracy on the given tables, and cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.llm import labelled, langid, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def held(spark, found, label):
    rows = found.where("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select("predicted", label).collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), len(rows)


def test_quality_on_held_out_documents(spark):
    right, n = held(spark, queries.op5_quality(spark, FOLDER), "quality")
    assert n > 80 and right > 0.95


def test_toxicity_on_held_out_documents(spark):
    right, n = held(spark, queries.op9_toxicity(spark, FOLDER), "toxic")
    assert n > 50 and right > 0.9


def test_language_on_held_out_documents(spark):
    rows = queries.op2_language(spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").select("lang_pred", "lang", "score").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !! 3", "x"), (None, "one text", "x"), (5, "word " * 30000, "x"), (5, "word", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, x string")


def labels(spark, quality_of=lambda k: k % 2, n=60):
    return spark.createDataFrame([(k, quality_of(k), k % 2) for k in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def training(spark, n=60):
    return spark.createDataFrame([(k, ("good plain words of a text " if k % 2 == 0 else "BAD!! $$ vile %% ") * 5) for k in range(n)], "doc_id long, text string")


def test_quality_cases(spark, odd):
    every = F.lit(True)
    model = quality.fit(training(spark), labels(spark), every)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows) and {r["x"] for r in rows} == {"x", "y"}
    assert quality.fit(training(spark), labels(spark, lambda k: 1), every) == 1.0
    nothing = quality.fit(training(spark), labels(spark).where("false"), every)
    assert nothing == 0.5 and quality.score(odd, nothing).where("score = 0.5").count() == 6
    assert quality.score(odd.where("false"), model).count() == 0


def test_isotonic_scores_rise():
    r = np.random.default_rng(1)
    x = r.normal(size=500)
    at, value = quality.isotonic(x, (x + r.normal(size=500) > 0).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and value[0] < 0.2 < 0.8 < value[-1]


def test_slopes_of_the_field_equal_differences():
    r = np.random.default_rng(3)
    distinct = [f"w{k}" for k in range(6)]
    x, ids, y = toxicity.features(distinct), r.integers(0, 6, 12), r.integers(0, 2, 12)
    starts, sizes = np.array([0, 5, 6]), np.array([5, 1, 6])
    field = toxicity.Field(np.zeros(1 << toxicity.BITS), 0.3, r.normal(size=(2, 2)), r.normal(size=2))
    field.weights[x.ravel()] = r.normal(size=x.size)

    def likelihood():
        e = (field.weights[x].sum(axis=1) + field.bias)[ids]
        _, _, z = field.passes(e, starts, sizes)
        gold = sum(e[k] for k in np.flatnonzero(y)) + field.start[y[starts]].sum()
        gold += sum(field.moves[y[t - 1], y[t]] for s, n in zip(starts, sizes, strict=True) for t in range(s + 1, s + n))
        return gold - z[starts].sum()

    weights, bias, moves, start = toxicity.slopes(field, x, ids, starts, sizes, y)
    for own, g, at in [(field.weights, weights, x[0, 0]), (field.weights, weights, x[3, 2]), (field.moves, moves, (0, 1)), (field.moves, moves, (1, 1)), (field.start, start, 1)]:
        kept = own[at]
        own[at] = kept + 1e-5
        up = likelihood()
        own[at] = kept - 1e-5
        down = likelihood()
        own[at] = kept
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4
    field.bias += 1e-5
    up = likelihood()
    field.bias -= 2e-5
    assert abs((up - likelihood()) / 2e-5 - bias[0]) < 1e-4


def test_the_field_learns_from_every_sentence_of_its_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda *a: seen.append(a))
    docs = spark.createDataFrame([(k, f"one vile{k % 2} word. Two good words! three", float(k % 2)) for k in range(40)], "doc_id long, text string, label double")
    for n in (1, 5):
        toxicity.tagger(docs.repartition(n))
    (distinct, ids, starts, sizes, _), (again, ids2, *_) = seen
    assert len(starts) == 120 and sizes.sum() == 280 == len(ids) and distinct == again and (ids == ids2).all()
    assert 5 <= toxicity.chosen(docs, 20).where("label > 0").count() <= 15


def test_normal_equations_of_partitions_equal_the_whole(spark):
    docs = training(spark)
    one, many = (quality.fit(docs.repartition(n), labels(spark), F.lit(True)) for n in (1, 7))
    texts = spark.createDataFrame([(1, "good plain words"), (2, "BAD!! vile %%"), (3, "")], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(texts, m).collect()} for m in (one, many))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_columns_that_clash_are_replaced(spark):
    docs = spark.createDataFrame([(1, "good plain words", "s", "p", "r", "l")], "doc_id long, text string, score string, spans string, rejected string, lang_pred string")
    assert quality.score(docs, quality.fit(training(spark), labels(spark), F.lit(True))).first()["score"] >= 0
    row = toxicity.score(docs, toxicity.fit(training(spark), labels(spark), F.lit(True))).first()
    assert 0 <= row["score"] <= 1 and row["spans"] == [] and row["rejected"] == "r"
    found = langid.predict(docs, langid.fit(spark.createDataFrame([(k, "good plain words", "en") for k in range(20)], "doc_id long, text string, lang string"))).first()
    assert found["lang_pred"] == "en" and found["rejected"] in (True, False) and found["spans"] == "p"


def test_toxicity_cases_and_spans(spark, odd):
    model = toxicity.fit(training(spark), labels(spark), F.lit(True))
    assert toxicity.score(odd, model).count() == 6
    row = toxicity.score(spark.createDataFrame([(1, "good plain  vile words")], "doc_id long, text string"), model).first()
    assert [("good plain  vile words"[s["start"] : s["end"]]) for s in row["spans"]] == ["vile"]
    assert toxicity.fit(training(spark), labels(spark).where("false"), F.lit(True)) == 0.0
    assert toxicity.score(odd.where("false"), model).count() == 0


def test_field_equals_enumeration():
    r = np.random.default_rng(2)
    field = toxicity.Field(np.zeros(1 << toxicity.BITS), 0.0, r.normal(size=(2, 2)), r.normal(size=2))
    e = r.normal(size=7)
    starts, sizes = np.array([0, 4, 5]), np.array([4, 1, 2])
    p = field.toxic(e, starts, sizes)
    for s, n in zip(starts, sizes, strict=True):
        weight = np.zeros(n)
        total = 0.0
        for k in range(2**n):
            y = [(k >> t) & 1 for t in range(n)]
            w = np.exp(field.start[y[0]] + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(e[s + t] for t in range(n) if y[t]))
            total += w
            weight += w * np.array(y)
        assert np.allclose(p[s : s + n], weight / total)


def test_language_cases(spark, odd):
    docs = spark.createDataFrame([(k, ("der die das und nicht " if k % 2 else "the and of to was ") * 3, "de" if k % 2 else "en") for k in range(80)] + [(900, None, "fr"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = {(r["doc_id"], r["x"]): r for r in langid.predict(odd, model).collect()}
    assert all(found[k, "x"]["lang_pred"] == "und" and found[k, "x"]["score"] == 0 for k in (1, 2, 3))
    assert langid.predict(odd, None).where("lang_pred = 'und'").count() == 6 and langid.fit(docs.where("false")) is None
    assert langid.predict(odd.where("false"), model).count() == 0


def test_kneser_ney_sums_to_one():
    texts = ["banana", "bandana", "ananas", "nab"]
    grams, _ = langid.ngrams(texts)
    _, one, n = np.unique(langid.hashed(grams, 0), return_index=True, return_counts=True)
    model = langid.estimate(["x"], np.zeros(len(one), int), grams[one], n)
    letters = np.unique(grams[:, -1])
    for history in grams[::3, :-1]:
        asked = np.column_stack([np.repeat(history[None], len(letters), 0), letters]).astype(np.uint32)
        assert 0.9 < np.exp(model.log_probabilities(asked)).sum() <= 1.0001


def test_folds(spark):
    import zlib

    for r in spark.range(50).select("id", labelled.fold(F.col("id"), 5).alias("f")).collect():
        assert r["f"] == zlib.crc32(str(r["id"]).encode()) % 5


def test_every_language_is_sampled():
    assert langid.taken({}, 10) == {} and langid.taken({"a": 4, "b": 6}, 10) == {"a": 1.0, "b": 1.0}
    assert langid.taken({"a": 10**9, "b": 2, "c": 100}, 22) == {"a": 10 / 10**9, "b": 1.0, "c": 0.1}


def test_kneser_ney_equals_its_definition():
    """Interpolated estimates of every order by counting, on a few characters."""
    text = "abracadabra abracad"
    order = langid.ORDER
    padded = "\0" * (order - 1) + text
    grams = [padded[k : k + order] for k in range(len(text))]
    table = {}
    for g in grams:
        table[g] = table.get(g, 0) + 1
    codes = np.frombuffer("".join(table).encode("utf-32-le"), np.uint32).reshape(-1, order)
    model = langid.estimate(["x"], np.zeros(len(table), np.int64), codes, np.array(list(table.values())))
    counts = [dict(table)]  # by order, the highest first
    for _ in range(order - 1):
        lower: dict[str, int] = {}
        for g in counts[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        counts.append(lower)
    discounts = []
    for c in counts:
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discounts.append(min(0.9, max(0.1, once / max(once + 2 * twice, 1))))

    def p(k, gram):  # of the gram's last character after the others, by the k-th order from the top
        if k == order:
            return 1 / (len(counts[-1]) + 1)
        total = sum(n for g, n in counts[k].items() if g[:-1] == gram[:-1])
        if not total:
            return p(k + 1, gram[1:])
        kinds = sum(g[:-1] == gram[:-1] for g in counts[k])
        return max(counts[k].get(gram, 0) - discounts[k], 0) / total + discounts[k] * kinds / total * p(k + 1, gram[1:])

    for g in ["\0\0\0\0a", "abrac", "bracz", "zzzzz", "zzzab", "cadab"]:
        codes = np.frombuffer(g.encode("utf-32-le"), np.uint32).reshape(1, order)
        assert abs(np.exp(model.log_probabilities(codes))[0, 0] - p(0, g)) < 1e-9
