"""Toxic spans and scores by a linear-chain conditional random field over words.

Labels are given for documents only, so tokens are labelled first: a word, or
the beginning of words, is evidence if labelled toxic documents hold it
significantly more often than others do, and its occurrences in toxic documents are toxic tokens. On
all sentences of a bounded sample of documents with these labels a field with two states is trained by numpy: a word
has hashed features (itself, its beginnings and end, its shape), states have transitions.
Forward and backward passes give each token's probability to be toxic; likely
tokens make spans, and a logistic regression on the largest and the summed
probability makes the document's score.

A sequence is a sentence: tokens up to one that ends in ``.``, ``!`` or ``?``.

Cases: null counts as empty; texts without words get the score of no toxic
token; repeated rows get the same result; without labels of both kinds every
score is that kind's (0 without any); an empty table gives an empty result;
other columns pass unchanged, of any name but those added. Texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import labelled, words
from framewell.session import cut_lineage

#: Bits of a feature's hash, rounds of training, and documents that the field is trained on at most about, half of them of each label.
BITS, ROUNDS, FIELD = 16, 80, 2_000
#: For a word to be evidence: toxic documents that hold it, in number and as a share (a few copies of one text are no evidence), the log likelihood ratio (G) against chance, and the log odds ratio.
HOLD, SHARE, SURE, ODDS = 3, 0.02, 16.0, 1.5
#: Lengths of word beginnings that are features and may be evidence.
BEGINS = (3, 4, 5, 6, 7)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def begin(word: str, k: int) -> str:
    """The first k characters of a longer word, marked as such; a shorter word whole, so marked."""
    return f"<{word[:k]}" if len(word) > k else f"<{word}>"


def features(distinct: list[str]) -> np.ndarray:
    """Hashed features of words."""
    plain = [words.bare(w) for w in distinct]
    kinds = ["U" if w.isupper() else "T" if w[:1].isupper() else "d" if not w.isalpha() else "l" for w in distinct]
    columns = [plain, *([begin(w, k) for w in plain] for k in BEGINS), [w[-3:] + ">" for w in plain], ["#" + k for k in kinds]]
    return np.column_stack([words.hashes(c) & np.uint64((1 << BITS) - 1) for c in columns]).astype(np.int64) if distinct else np.zeros((0, len(columns)), np.int64)


def sentences(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each sentence among the words."""
    ends = np.fromiter((w[-1] in ".!?" for w in found.distinct), bool, len(found.distinct))
    last = np.zeros(len(found.ids) + 1, bool)
    last[1:] = ends[found.ids] if len(found.ids) else False
    last[found.starts] = True
    starts = np.flatnonzero(last[:-1]) if len(found.ids) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(found.ids)))


@dataclass
class Field:
    """Weights of features for the toxic state against the other, transitions, and start."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, distinct: list[str]) -> np.ndarray:
        return self.weights[features(distinct)].sum(axis=1) + self.bias

    def passes(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward values (tokens x 2), and each token's log partition function."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
        a, b = np.zeros((len(e), 2)), np.zeros((len(e), 2))
        m = self.moves
        for t, k in enumerate(alive):
            at = starts[:k] + t
            if t:
                x, y = a[at - 1, 0], a[at - 1, 1]
                a[at, 0] = np.logaddexp(x + m[0, 0], y + m[1, 0])
                a[at, 1] = np.logaddexp(x + m[0, 1], y + m[1, 1]) + e[at]
            else:
                a[at, 0] = self.start[0]
                a[at, 1] = self.start[1] + e[at]
        ends = starts + sizes - 1
        for t in range(1, len(alive)):
            k = alive[t]
            at = ends[:k] - t
            x, y = b[at + 1, 0], b[at + 1, 1] + e[at + 1]
            b[at, 0] = np.logaddexp(m[0, 0] + x, m[0, 1] + y)
            b[at, 1] = np.logaddexp(m[1, 0] + x, m[1, 1] + y)
        return a, b, np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])

    def toxic(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Marginal probability of the toxic state for each token."""
        a, b, z = self.passes(e, starts, sizes)
        return np.exp(a[:, 1] + b[:, 1] - z)


def slopes(field: Field, x: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The gradient of the log-likelihood of states y: by weights, bias, moves and start. x: features of the distinct words."""
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    e = (field.weights[x].sum(axis=1) + field.bias)[ids]
    a, b, z = field.passes(e, starts, sizes)
    p = np.exp(a[:, 1] + b[:, 1] - z)
    wrong = y - p
    by_word = np.bincount(ids, weights=wrong, minlength=len(x))
    found = [np.bincount(x.ravel(), weights=np.repeat(by_word, x.shape[1]), minlength=1 << BITS), np.array([wrong.sum()]), np.zeros((2, 2)), np.zeros(2)]
    for i in range(2):
        found[3][i] = ((y[starts] == i) - (p[starts] if i else 1 - p[starts])).sum()
        for j in range(2):
            expected = np.exp(a[to - 1, i] + field.moves[i, j] + (e[to] if j else 0) + b[to, j] - z[to])
            found[2][i, j] = ((y[to - 1] == i) & (y[to] == j)).sum() - expected.sum()
    return found


def train(distinct: list[str], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> Field:
    """Maximise the penalised likelihood of labelled tokens with Adam."""
    x, y = features(distinct), truth.astype(np.int64)
    field = Field(np.zeros(1 << BITS), -2.0, np.zeros((2, 2)), np.zeros(2))
    theta = [field.weights, np.array([field.bias]), field.moves, field.start]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, ROUNDS + 1):
        for k, (p, g) in enumerate(zip(theta, slopes(field, x, ids, starts, sizes, y), strict=True)):
            g = g - 0.5 * p
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += 0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        field.bias = float(theta[1][0])
    return field


@dataclass
class Model:
    """The field and the weights of a document's summary."""

    field: Field
    weights: np.ndarray

    def measure(self, column: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray]:
        """Words, each token's probability, and the summary of each text: constant, largest probability, logarithm of their sum, share."""
        found = words.split(column)
        starts, sizes = sentences(found)
        p = self.field.toxic(self.field.emissions(found.distinct)[found.ids], starts, sizes) if len(found.ids) else np.zeros(0)
        most = np.zeros(len(column))
        np.maximum.at(most, found.docs(), p)
        total = np.maximum(words.per_document(p, found.starts), 0)
        return found, p, np.column_stack([np.ones(len(column)), most, np.log1p(total), np.sqrt(total / np.maximum(found.counts, 1))])

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.weights, -30, 30)))


def spans(text: str, tokens: list[str], p: np.ndarray) -> list[dict]:
    """Code point offsets of the runs of likely toxic tokens."""
    found: list[dict] = []
    before, at = False, 0
    for token, likely in zip(tokens, p >= 0.5, strict=True):
        at = text.index(token, at)
        if likely and before:
            found[-1]["end"] = at + len(token)
        elif likely:
            found.append({"start": at, "end": at + len(token)})
        before, at = likely, at + len(token)
    return found


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
    return w


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch, words and beginnings of words with the number of toxic and of other documents that hold them."""
    for batch in batches:
        for some in words.slices(batch, "text"):
            label = some.column(some.schema.get_field_index("label")).to_numpy(zero_copy_only=False) > 0
            found = words.normalised(words.texts(some, "text"))
            for k in (0, *BEGINS):
                index: dict[str, int] = {}
                to = np.fromiter((index.setdefault(begin(w, k) if k else w, len(index)) for w in found.distinct), np.int64, len(found.distinct))
                n = max(1, len(index))
                once = np.unique(found.docs() * n + to[found.ids]) if len(found.ids) else np.zeros(0, np.int64)
                kind = label[once // n]
                toxic, other = (np.bincount(once[x] % n, minlength=n)[: len(index)] for x in (kind, ~kind))
                keep = [u if not u.endswith(">") else None for u in index]
                yield pa.RecordBatch.from_pydict({"word": pa.array(keep, pa.string()), "toxic": pa.array(toxic, pa.int64()), "other": pa.array(other, pa.int64())})


def evidence(sample: DataFrame) -> set[str]:
    """Words and beginnings that toxic documents of the sample hold significantly more often; few, as ``SHARE`` decides in Spark."""
    n = {r["label"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    held = sample.select("text", "label").mapInArrow(_holders, "word string, toxic long, other long").where("word is not null").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    t, o, n_t, n_o = F.col("toxic"), F.col("other"), F.lit(float(n.get(True, 0))), F.lit(float(n.get(False, 0)))
    odds = F.log((t + 0.5) / (n_t - t + 0.5)) - F.log((o + 0.5) / (n_o - o + 0.5))

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * (n_t + n_o) / (row * column))).otherwise(0.0)

    g = 2 * (part(t, t + o, n_t) + part(o, t + o, n_o) + part(n_t - t, n_t + n_o - t - o, n_t) + part(n_o - o, n_t + n_o - t - o, n_o))
    return {r["word"] for r in held.where((t >= max(HOLD, SHARE * n.get(True, 0))) & (g > SURE) & (odds > ODDS)).select("word").collect()}


def _examples(lexicon: set[str]):
    """All sentences of documents: their tokens, joined by blanks, and a byte for each token, 1 if it is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text"):
                label = some.column(some.schema.get_field_index("label")).to_numpy(zero_copy_only=False) > 0
                found = words.split(words.texts(some, "text"))
                if not len(found.ids):
                    continue
                plain = [words.bare(w) for w in found.distinct]
                known = np.fromiter((w in lexicon or any(begin(w, k) in lexicon for k in BEGINS) for w in plain), bool, len(plain))
                owner = found.docs()
                truth = known[found.ids] & label[owner]
                starts, sizes = sentences(found)
                ends = pa.array(np.append(starts, len(found.ids)).astype(np.int32))
                tokens = pa.DictionaryArray.from_arrays(pa.array(found.ids, pa.int32()), pa.array(found.distinct, pa.string())).cast(pa.string())
                toxic = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(truth.astype(np.uint8))])
                lists = [pc.binary_join(pa.ListArray.from_arrays(ends, tokens), " "), toxic]
                own = some.column(some.schema.get_field_index("doc_id")).take(pa.array(owner[starts]))
                yield pa.RecordBatch.from_arrays([own, pa.array(starts - found.starts[owner[starts]]), *lists], names=["doc_id", "at", "tokens", "truth"])

    return run


def chosen(sample: DataFrame, most: int = FIELD) -> DataFrame:
    """About half of ``most`` documents of each label (all where there are fewer), picked by a hash of the document."""
    toxic = F.col("label") > 0
    sizes = {r["k"]: r["n"] for r in sample.groupBy(toxic.alias("k")).agg(F.count("*").alias("n")).collect()}
    share = F.when(toxic, F.lit(most / 2 / max(1, sizes.get(True, 0)))).otherwise(F.lit(most / 2 / max(1, sizes.get(False, 0))))
    return sample.where(F.pmod(F.xxhash64(F.lit("field"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)


def tagger(labelled_docs: DataFrame) -> Field:
    """The field trained on the evidence of labelled documents and on all sentences of the chosen ones, in the order of documents."""
    lexicon = evidence(labelled_docs)
    kind = labelled_docs.schema["doc_id"].dataType.simpleString()
    rows = chosen(labelled_docs).select("doc_id", "text", "label").mapInArrow(_examples(lexicon), f"doc_id {kind}, at long, tokens string, truth binary").collect()
    if not rows:
        return Field(np.zeros(1 << BITS), -10.0, np.zeros((2, 2)), np.zeros(2))
    rows.sort(key=lambda r: (r["doc_id"], r["at"], r["tokens"]))
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for r in rows for w in r["tokens"].split(" ")), np.int64)
    sizes = np.array([len(r["truth"]) for r in rows], np.int64)
    truth = np.frombuffer(b"".join(bytes(r["truth"]) for r in rows), np.uint8).astype(bool)
    del rows
    return train(list(index), ids, np.cumsum(sizes) - sizes, sizes, truth)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, most: int = labelled.MOST) -> Model | float:
    """Fit on about ``most`` labelled documents.

    A field of two thirds of them judges the rest, which gives the weights of a document's
    score; the field that is kept is trained on all. Examples reach the driver, and ``most`` bounds them.
    """
    sample = labelled.sample(docs, labels, "toxic", keep, most)
    sample = cut_lineage(sample.withColumn("part", labelled.part("doc_id", 3)).repartition(16))
    kinds = {r["label"] for r in sample.select((F.col("label") > 0).cast("double").alias("label")).distinct().collect()}
    if len(kinds) < 2:
        return float(next(iter(kinds), 0.0))
    model = Model(tagger(sample.where("part > 0")), np.zeros(4))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text"):
                _, _, x = model.measure(words.texts(some, "text"))
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "label": some.column(some.schema.get_field_index("label"))})

    judged = sample.where("part = 0")
    judged = judged if judged.select((F.col("label") > 0).alias("k")).distinct().count() == 2 else sample
    found = judged.select("text", "label").mapInArrow(summarise, "x array<double>, label double").collect()
    weights = logistic(np.array([r["x"] for r in found]), np.array([float(r["label"] > 0) for r in found]))
    return Model(tagger(sample), weights)


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score", offsets: str = "spans") -> DataFrame:
    """Documents with their score and the (start, end) offsets of toxic spans added."""
    new = {out: T.DoubleType(), offsets: SPAN}
    rest = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in rest]
    if not isinstance(model, Model):
        return docs.select(*names, F.lit(model).alias(out), F.array().cast(SPAN).alias(offsets))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for some in words.slices(batch, text):
                column = words.texts(some, text)
                found, p, x = model.measure(column)
                marked = np.zeros(len(column), bool)
                marked[found.docs()[p >= 0.5]] = True
                where: list[list[dict]] = [[] for _ in marked]
                for k in np.flatnonzero(marked):
                    own = slice(found.starts[k], found.starts[k + 1])
                    where[k] = spans(column[int(k)].as_py(), [found.distinct[i] for i in found.ids[own]], p[own])
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), pa.array(model.score(x)), pa.array(where, kind)], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*rest, *(T.StructField(k, v) for k, v in new.items())]))
