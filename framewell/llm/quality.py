"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to ``FEATURES`` random
cosines, which approximate a Gaussian kernel. Each partition of the sample sums
its part of the normal equations; the sums are solved for ridge weights.
Another part of the sample calibrates ridge scores by isotonic regression.

Cases: null counts as empty; empty texts get the score of their statistics
(all 0); repeated rows get the same score; without any labels every score is
0.5, with labels of one kind only every score is that label's share; an empty
table gives an empty result; other columns pass unchanged, of any name but
those added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import labelled, words
from framewell.session import cut_lineage

FEATURES, WIDTH, RIDGE, SEED, TASKS = 256, 3.0, 1e-3, 5, 16
PLAIN = ".,;:!?'\"-()"


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, newline, plain punctuation, other ASCII, beyond ASCII."""
    kind = np.full(256, 6, np.int32)
    kind[128:] = 7
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", PLAIN)):
        kind[[ord(c) for c in chars]] = k
    return kind


KINDS = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    n_docs, size = len(column), np.maximum(np.diff(ends), 1)
    place = np.repeat(np.arange(0, 8 * n_docs, 8, dtype=np.int32), np.diff(ends))
    place += KINDS[data[ends[0] : ends[-1]]]
    kinds = np.bincount(place, minlength=8 * n_docs).reshape(n_docs, 8) / size[:, None]
    del place
    found = words.split(column)
    n = np.maximum(found.counts, 1)
    about = np.array([(len(w), w.isupper(), w[0].isupper(), not any(map(str.isalpha, w)), w[-1] in ".!?", not w[-1].isalnum(), len(words.bare(w)) <= 3) for w in found.distinct], np.float64).reshape(-1, 7)
    sums = words.per_document(np.column_stack([about, about[:, 0] ** 2])[found.ids], found.starts) if len(found.ids) else np.zeros((n_docs, 8))
    mean = sums[:, 0] / n
    spread = np.sqrt(np.maximum(sums[:, 7] / n - mean**2, 0))
    pairs, times = np.unique(found.docs() * max(1, len(found.distinct)) + found.ids, return_counts=True)
    owner = pairs // max(1, len(found.distinct))
    most = np.zeros(n_docs)
    np.maximum.at(most, owner, times)
    different = np.bincount(owner, minlength=n_docs)
    next_to = np.zeros(len(found.ids))
    if len(found.ids) > 1:
        next_to[1:] = found.ids[1:] == found.ids[:-1]
    again = words.per_document(next_to, found.starts)
    lines = kinds[:, 4] * size + 1
    return np.column_stack([kinds, np.log1p(found.counts), np.log1p(mean), np.log1p(spread), sums[:, 1:7] / n[:, None], different / n, np.log(n) * different / n, most / n, again / n, np.log1p(found.counts / lines)])


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / FEATURES), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (mean raw score, mean label) of the pooled blocks of adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, y in zip(raw[order], label[order], strict=True):
        blocks.append([1, x, y])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][0] >= blocks[-1][2] / blocks[-1][0]:
            n, x, y = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + x, blocks[-1][2] + y]
    n, x, y = np.array(blocks).T
    y = (y + 0.5 * label.mean()) / (n + 0.5)
    return x / n, np.maximum.accumulate(y)


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the statistics of ``text`` as an array."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text"):
                x = statistics(words.texts(some, "text"))
                columns = [some.column(some.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch))
                a += z.T @ z
                b += z.T @ batch.column(batch.schema.get_field_index("label")).to_numpy()
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, keep: Column, most: int = labelled.MOST) -> Model | float:
    """Fit on about ``most`` labelled documents; a number if there is no choice to learn."""
    sample = labelled.sample(docs, labels, "quality", keep, most)
    held = cut_lineage(described(sample, ["doc_id", "label"]).withColumn("calibrates", labelled.part("doc_id", 4) == 0).repartition(TASKS))
    kinds = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return float(next(iter(kinds), 0.5))
    width = len(held.select("x").first()["x"])
    sums = held.select([f(F.get("x", F.lit(k))).alias(f"{name}{k}") for k in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = (np.array([sums[f"{name}{k}"] for k in range(width)]) for name in "ms")
    random = np.random.default_rng(SEED)
    turn, shift = random.normal(size=(width, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES)
    model = Model(mean, np.where(scale > 1e-9, scale, 1), turn, shift, np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])))
    parts = held.where(~F.col("calibrates")).mapInArrow(_sums(model), "a binary, b binary").collect()
    a = sum(np.frombuffer(p["a"]).reshape(FEATURES + 1, -1) for p in parts)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model.weights = np.linalg.solve(a + RIDGE * max(a[-1, -1], 1) * np.eye(FEATURES + 1) / 10, b)
    rows = held.where("calibrates").select("x", "label").collect()
    if rows:
        model.knots = isotonic(model.raw(np.array([r["x"] for r in rows])), np.array([r["label"] for r in rows]))
    return model


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """Documents with their score from 0 to 1 added."""
    rest = [f for f in docs.schema.fields if f.name != out]
    if not isinstance(model, Model):
        return docs.drop(out).withColumn(out, F.lit(model))
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, text):
                found = model.score(statistics(words.texts(some, text)))
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), pa.array(found, pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.DoubleType())]))
