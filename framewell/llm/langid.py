"""Language identification by character language models with interpolated Kneser-Ney smoothing.

One model of order ``ORDER`` for each language; a word is predicted character
by character from the ones before it, up to its end. Model values of all
languages stand in one row for each n-gram, rows in the order of the n-grams'
64-bit hashes, so a lookup is a binary search in a sorted array. A text gets
the language of lowest cross-entropy per character over all its words. Its
score is the calibrated probability of that language; texts that
fit their language worse than nearly all of its own do are marked ``rejected``.

Cases: null text, or text without a letter, is ``und`` with score 0; without
anything to learn from every text is ``und``; repeated rows get the same
result; ties go to the language first in order; an empty table gives an
empty result; other columns pass unchanged, of any name but those added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import labelled, words
from framewell.session import cut_lineage

#: Characters in an n-gram, documents to learn from at most about, and the share of a language's own texts that is rejected.
ORDER, MOST, REJECTED = 5, 8_000, 0.002
UNKNOWN = "und"
START, END = 0, 1


def letters(found: words.Words) -> words.Words:
    """Words in lower case with letters only; words without any go."""
    seen: dict[str, int] = {}
    to = np.fromiter((seen.setdefault("".join(filter(str.isalpha, w.lower())), len(seen)) for w in found.distinct), np.int64, len(found.distinct))
    merged = words.Words(list(seen), to[found.ids] if len(found.ids) else found.ids.astype(np.int64), found.starts)
    return words.only(merged, np.fromiter(map(bool, seen), bool, len(seen)))


def ngrams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the n-gram that ends at each character and at the end of each word, and how many each word has."""
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
    codes = np.frombuffer("".join(w + chr(END) for w in distinct).encode("utf-32-le"), np.uint32)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(codes))
    grams = np.zeros((len(codes), ORDER), np.uint32)
    for back in range(ORDER):
        inside = at - back >= begins
        grams[inside, ORDER - 1 - back] = codes[at[inside] - back]
    return grams, sizes


def hashed(grams: np.ndarray, first: int, last: int = ORDER) -> np.ndarray:
    """Hashes of columns first to last."""
    h = np.full(len(grams), 0x9E3779B97F4A7C15 + last - first, np.uint64)
    for k in range(first, last):
        h = words.mix(h ^ (grams[:, k].astype(np.uint64) + np.uint64(0x51ED27)))
    return h


@dataclass
class Table:
    """Rows of values by sorted hash."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, hashes: np.ndarray, missing: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes)[:, None], self.values[at], missing)


@dataclass
class Model:
    """For each order the discounted probabilities of n-grams and the weight that each history leaves to lower orders."""

    languages: list[str]
    seen: list[Table]
    left: list[Table]
    floor: float
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last character after the others, by language."""
        none = np.zeros(len(self.languages))
        p = np.full((len(grams), len(self.languages)), self.floor)
        for k in range(ORDER):
            first = ORDER - 1 - k
            p = self.seen[k].find(hashed(grams, first), none) + self.left[k].find(hashed(grams, first, ORDER - 1), none + 1) * p
        return np.log(p)

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and its number of characters."""
        found = letters(words.split(column))
        if not len(found.ids):
            return np.zeros((len(column), len(self.languages))), np.zeros(len(column))
        grams, sizes = ngrams(found.distinct)
        _, one, which = np.unique(hashed(grams, 0), return_index=True, return_inverse=True)
        ends = np.cumsum(sizes)
        each = words.per_document(self.log_probabilities(grams[one])[which], np.concatenate([[0], ends]))
        n = words.per_document(sizes[found.ids].astype(float), found.starts)
        return -words.per_document(each[found.ids], found.starts) / np.maximum(n, 1)[:, None], n

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: none), probability, cross-entropy and rejection of each text."""
        h, n = self.entropies(column)
        best = h.argmin(axis=1)
        lowest = h.min(axis=1)
        p = 1 / np.exp(-self.sharpness * np.minimum(np.sqrt(n), 60)[:, None] * (h - lowest[:, None])).sum(axis=1)
        rejected = lowest > (self.limits[best] if self.limits is not None else np.inf) * (1 + 1 / np.sqrt(np.maximum(n, 1)))
        return np.where(n > 0, best, -1), np.where(n > 0, p, 0.0), np.where(n > 0, lowest, 0.0), rejected & (n > 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each batch by language."""
    for batch in batches:
        for some in words.slices(batch, "text"):
            langs = np.array(some.column(some.schema.get_field_index("lang")).to_pylist())
            found = letters(words.split(words.texts(some, "text")))
            if not len(found.ids):
                continue
            grams, sizes = ngrams(found.distinct)
            for lang in np.unique(langs):
                times = np.bincount(found.ids[(langs == lang)[found.docs()]], minlength=len(found.distinct))
                uses = np.repeat(times, sizes)
                _, one, which = np.unique(hashed(grams, 0), return_index=True, return_inverse=True)
                n = np.bincount(which, weights=uses).astype(np.int64)
                one, n = one[n > 0], n[n > 0]
                texts = ["".join(map(chr, g)) for g in grams[one]]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(texts), "gram": texts, "n": n})


def estimate(languages: list[str], lang: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Model:
    """Interpolated Kneser-Ney estimates from counts of n-grams of the full order.

    Below the full order an n-gram counts once for each character that stands
    before it. Discounts follow from the numbers of n-grams seen once and twice.
    """
    seen: list[Table] = []
    left: list[Table] = []
    size = len(languages)
    for k in range(ORDER - 1, -1, -1):
        first = ORDER - 1 - k
        own, history = hashed(grams, first), hashed(grams, first, ORDER - 1)
        keys, at = np.unique(own, return_inverse=True)
        histories, of = np.unique(history, return_inverse=True)
        total, kinds, values = np.zeros((len(histories), size)), np.zeros((len(histories), size)), np.zeros((len(keys), size))
        np.add.at(total, (of, lang), n)
        np.add.at(kinds, (of, lang), 1)
        once, twice = (np.bincount(lang[n == c], minlength=size) for c in (1, 2))
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        values[at, lang] = (n - discount[lang]) / total[of, lang]
        seen.append(Table(keys, values))
        left.append(Table(histories, np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)))
        if k:
            _, index, n = np.unique(np.column_stack([lang.astype(np.uint64), hashed(grams, first + 1)]), axis=0, return_index=True, return_counts=True)
            lang, grams = lang[index], grams[index]
    return Model(languages, seen[::-1], left[::-1], 1 / (len(np.unique(grams[:, -1])) + 1))


def taken(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's documents to take: all of small ones and the same number of others, ``most`` together."""
    left, each, rest = most, 0.0, len(sizes)
    for n in sorted(sizes.values()):
        each = left / rest
        if n > each:
            break
        left, rest, each = left - n, rest - 1, float("inf")
    return {lang: min(1.0, each / n) for lang, n in sizes.items()}


def fit(docs: DataFrame, most: int = MOST) -> Model | None:
    """Learn from ``lang`` of about ``most`` documents; a fifth of them calibrates. None if no text has a language and a letter.

    Of each language up to the same number of documents is taken, so a rare one is learned at
    every size; of more than ``most`` languages the most frequent ones are learned.
    The driver gets the counts of the sample's n-grams, which ``most`` bounds.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    shares = taken(sizes, most)
    if shares:
        share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("lang"))
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < F.coalesce(share, F.lit(0.0)) * (1 << 40))
    known = cut_lineage(known)
    calibrates = labelled.part("doc_id", 5) == 0
    counted = known.where(~calibrates).mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        counted = known.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        if not len(counted):
            return None
    languages = sorted(counted.lang.unique())
    grams = np.frombuffer("".join(counted.gram).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    model = estimate(languages, np.searchsorted(languages, counted.lang.to_numpy(str)), grams, counted.n.to_numpy())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text"):
                h, size = model.entropies(words.texts(some, "text"))
                yield pa.RecordBatch.from_pydict({"lang": some.column(some.schema.get_field_index("lang")), "h": pa.array(list(h), pa.list_(pa.float64())), "size": size})

    rows = [r for r in known.where(calibrates).mapInArrow(measure, "lang string, h array<double>, size double").collect() if r["size"] and r["lang"] in languages]
    if rows:
        calibrate(model, np.array([r["h"] for r in rows]), np.array([r["size"] for r in rows]), np.array([languages.index(r["lang"]) for r in rows]))
    return model


def calibrate(model: Model, h: np.ndarray, size: np.ndarray, truth: np.ndarray) -> None:
    """Choose the sharpness of probabilities by likelihood, and each language's limit of rejection."""
    gap = np.minimum(np.sqrt(size), 60)[:, None] * (h - h.min(axis=1, keepdims=True))
    at = np.arange(len(h))

    def loss(sharp: float) -> float:
        x = -sharp * gap
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[at, truth]))

    model.sharpness = min(np.geomspace(0.05, 20, 60), key=loss)
    own = h[at, truth] / (1 + 1 / np.sqrt(size))
    model.limits = np.array([np.quantile(own[truth == k], 1 - REJECTED) if (truth == k).any() else np.inf for k in range(len(model.languages))])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Documents with ``lang_pred``, ``score``, ``cross_entropy`` (nats a character) and ``rejected`` added."""
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cross_entropy": T.DoubleType(), "rejected": T.BooleanType()}
    rest = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in rest]
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        called = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for some in words.slices(batch, text):
                best, p, h, rejected = model.predict(words.texts(some, text))
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), pa.array(called[best], pa.string()), pa.array(p), pa.array(h), pa.array(rejected)], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*rest, *(T.StructField(k, v) for k, v in new.items())]))
