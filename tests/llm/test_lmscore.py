import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framewell.llm import lmscore, words


def corpus(n=400, seed=1):
    r = random.Random(seed)
    chains = {"a": "b", "b": "c", "c": "d", "d": "a"}
    out = []
    for _ in range(n):
        w, text = r.choice("abcd"), []
        for _ in range(60):
            text.append(w)
            w = chains[w] if r.random() < 0.95 else r.choice("abcd")
        out.append(" ".join(text))
    return out


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def small(n=300, seed=0):
    """A vocabulary of n known words and the shared leaves, and a network with weights."""
    r = np.random.default_rng(seed)
    known = np.sort(r.integers(0, 2**63, n).astype(np.uint64))
    counts = np.concatenate([r.integers(1, 1000, n), r.integers(0, 3, 1 << lmscore.BITS)]).astype(float)
    vocabulary = lmscore.Vocabulary.of(counts, known)
    network = lmscore.Network.new(vocabulary)
    network.out += r.normal(0, 0.3, network.out.shape).astype(np.float32)
    network.top += r.normal(0, 0.3, network.top.shape).astype(np.float32)
    return counts, vocabulary, network


def brute(network, vocabulary, context, leaf):
    """The logarithm of a leaf's probability, one decision after the other."""
    h = np.tanh(sum(network.embed[c + k * (lmscore.INPUTS + 1)].astype(float) for k, c in enumerate(context)))
    h[-1] = 1
    x = network.top @ h
    total = x[vocabulary.tree.classes[leaf]] - np.log(np.exp(x).sum())
    for k in range(vocabulary.tree.starts[leaf], vocabulary.tree.starts[leaf + 1]):
        total -= np.log1p(np.exp(-vocabulary.tree.turns[k] * (network.out[vocabulary.tree.nodes[k]] @ h)))
    return total


def test_learns_order_and_prefers_it(spark):
    model = lmscore.fit(table(spark, corpus()))
    good, bad = corpus(20, 9), [" ".join(random.Random(k).choice("abcd") for _ in range(60)) for k in range(20)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lmscore.score(table(spark, good + bad), model).collect()}
    a, b = (np.array([got[k] for k in x]) for x in (range(20), range(20, 40)))
    assert a.min() > b.max() and a.mean() > np.log(0.25) + 0.3


def test_probabilities_are_normalised_and_start_as_shares():
    counts, vocabulary, network = small()
    r = np.random.default_rng(1)
    every = np.arange(len(counts))
    for context in r.integers(0, lmscore.INPUTS + 1, (3, 4)):
        p = network.log_probabilities(np.tile(context, (len(every), 1)), every, vocabulary.tree)
        assert abs(np.exp(p).sum() - 1) < 1e-4
        assert all(abs(p[k] - brute(network, vocabulary, context, k)) < 1e-4 for k in r.integers(0, len(every), 50))
    plain = lmscore.Network.new(vocabulary).log_probabilities(np.zeros((len(every), 4), int), every, vocabulary.tree)
    assert np.allclose(np.exp(plain), (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)


def test_gradient_equals_differences():
    counts, vocabulary, network = small()
    r = np.random.default_rng(2)
    leaf, context = r.integers(0, len(counts), 40), r.integers(0, 8, (40, 4))
    leaf = leaf[np.argsort(-vocabulary.tree.sizes(leaf), kind="stable")]

    def loss():
        return -sum(brute(network, vocabulary, c, k) for c, k in zip(context, leaf, strict=True))

    for weights, (used, g, times) in zip((network.embed, network.out, network.top), network.gradient(context, leaf, vocabulary.tree), strict=True):
        assert len(used) == len(set(used)) == len(times)
        for k in r.integers(0, len(used), 6):
            unit = r.integers(0, lmscore.HIDDEN - 1)
            at, step = (used[k], unit), np.float32(1e-2)
            before = weights[at]
            weights[at] = before + step
            up = loss()
            weights[at] = before - step
            down = loss()
            weights[at] = before
            assert abs((up - down) / (2 * float(step)) - g[k, unit]) < 2e-2 * max(1, abs(g[k, unit]))


def test_contexts_stay_within_documents():
    got = lmscore.contexts(np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4]))
    edge = lmscore.INPUTS
    assert got.tolist() == [[edge, edge, 6, 7], [edge, 5, 7, edge], [5, 6, edge, edge], [edge] * 4]


def test_rows_of_keys_are_summed_and_replaced():
    r = np.random.default_rng(5)
    for n, times in ((0, 1), (8, 4), (5000, 4), (1 << 16, 1), (70_000, 1), (80_000, 4)):
        keys, rows = r.integers(0, 300, n).astype(np.uint16) * np.uint16(211), r.normal(0, 1, (n // times, lmscore.HIDDEN)).astype(np.float32)
        used, total, often = lmscore.summed(keys, rows, times)
        want = np.zeros((1 << 16, lmscore.HIDDEN))
        np.add.at(want, keys, np.repeat(rows, times, axis=0))
        assert used.tolist() == np.unique(keys).tolist() and often.tolist() == np.unique(keys, return_counts=True)[1].tolist()
        assert np.allclose(total, want[used], atol=1e-3)
        table = r.normal(0, 1, want.shape).astype(np.float32)
        kept = table.copy()
        lmscore.put(table, used, total)
        kept[used] = total
        assert (table == kept).all()


def test_large_weights_of_classes_are_held_back():
    _, _, network = small()
    network.top[:] = 1000 * np.sign(network.top)
    p, total = network.classes(network.state(np.zeros((3, 4), int)))
    assert np.isfinite(p).all() and np.isfinite(total).all()


def test_place_among_rows_hardly_changes_a_score():
    counts, vocabulary, network = small()
    r = np.random.default_rng(6)
    leaf, context = r.integers(0, len(counts), 1000), r.integers(0, lmscore.INPUTS + 1, (1000, 4))
    p = network.log_probabilities(context, leaf, vocabulary.tree)
    for some in (np.arange(7), r.permutation(1000), r.permutation(1000)[:333]):
        assert np.allclose(network.log_probabilities(context[some], leaf[some], vocabulary.tree), p[some], rtol=0, atol=5e-6)


def test_cases(spark):
    schema = "doc_id long, text string, n_words int, row string, at map<string,int>, leaves int"
    docs = spark.createDataFrame([(1, None, 5, "r", {}, 0), (2, "", 5, None, None, 0), (3, "!!", 5, "r", {"a": 1}, 0), (4, "a b c", 5, "r", {}, 0), (4, "a b c", 5, "r", {}, 0), (None, "zz " * 200_000, 5, "r", {}, 0)], schema)
    rows = lmscore.fit_score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["mean_log_likelihood"] is None) for r in rows) == [(0, 200_000, False), (1, 0, True), (2, 0, True), (3, 0, True), (4, 3, False), (4, 3, False)]
    assert {r["log_likelihood"] for r in rows if r["n_words"] == 0} == {0.0} and len({r["log_likelihood"] for r in rows if r["doc_id"] == 4}) == 1
    assert set(rows[0].asDict()) == {*docs.columns, "log_likelihood", "mean_log_likelihood"}
    assert lmscore.fit_score(docs.where("false")).count() == 0


def mixed(n=600):
    r = random.Random(4)
    return [" ".join(f"{'xy'[k % 2]}{int(r.paretovariate(0.7)) % 4000}" for _ in range(r.randint(5, 120))) for k in range(n)]


def test_layout_changes_no_score(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD", 4000)
    docs = table(spark, mixed())
    one, many = ({r["doc_id"]: r["log_likelihood"] for r in lmscore.fit_score(docs.repartition(n, F.rand(n))).collect()} for n in (1, 7))
    assert max(abs(one[k] - many[k]) / max(1, abs(one[k])) for k in one) < 1e-6


def test_context_gains_on_the_words_shares(spark):
    docs = table(spark, mixed(2000))
    vocabulary, counts = lmscore.count(docs)
    encoded = lmscore.encode(docs, vocabulary)
    model = lmscore.trained(encoded, vocabulary, counts)
    plain = lmscore.Model(vocabulary, lmscore.Network.new(vocabulary), counts)
    mean = [lmscore.scored(encoded, m).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0] for m in (model, plain)]
    assert mean[0] > mean[1] + 0.3  # nearly the bit that tells x from y words
    assert model.trained == counts.agg(F.sum("n")).first()[0]


def test_every_word_counts_by_itself(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD", 0)
    n, own = 8000, lmscore.INPUTS
    texts = [f"w{k}" for k in range(n) for _ in range(1 + k % 3)]
    docs = table(spark, texts)
    model = lmscore.fit(docs)
    assert model.trained == len(texts) and len(model.vocabulary.known) == own
    got = {r["text"]: r["log_likelihood"] for r in lmscore.score(docs, model).collect()}
    by: dict[int, list[int]] = {}
    for k in range(n):
        leaf, _ = model.vocabulary.leaves(words.normal(words.split(pa.array([f"w{k}"]))))
        by.setdefault(int(leaf[0]), []).append(k)
    shared = [m for leaf, m in by.items() if leaf >= own and len(m) > 1]
    assert shared
    for a, *rest in shared:
        for b in rest:
            assert abs(got[f"w{a}"] - got[f"w{b}"] - np.log((1.5 + a % 3) / (1.5 + b % 3))) < 1e-4


def test_repeated_documents_score_higher(spark):
    r = random.Random(3)
    alone = [" ".join(f"u{r.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    got = {x["doc_id"]: x["mean_log_likelihood"] for x in lmscore.fit_score(table(spark, alone + alone[:50])).collect()}
    assert min(got[k] for k in range(50)) > max(got[k] for k in range(50, 300))
