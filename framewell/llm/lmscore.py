"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Each word is predicted from the ``SIDE`` words on either side of it, itself
masked: inputs are embedded by place, summed, and passed through tanh; from this
state a softmax tells ``CLASSES`` classes of words apart, and within each
class the state decides at every inner node of a Huffman tree which way leads to
the word, so all words' probabilities add up to 1. The sum of the logarithms
over all words of a text is its pseudo-log-likelihood.

Counts cover every word of every document, by the word (a 64-bit hash), in a
distributed table. The about ``HEAD`` most frequent words are leaves of their own;
all others share 2 ** ``BITS`` leaves by their hash, within which a word has
its share of the occurrences: these words' own counts are joined when texts are scored.

Texts become rows of leaves, which are dealt to shards by a hash of the row and
sorted by it, so that what is learned depends on the rows and not on how they are
stored. Every word is trained on once, where its shard is: shards first learn from
one in ``FIRST`` texts, beginning with the words' shares of all occurrences, then from the others,
beginning with the mean of the shards, for each weight by how often it was used.
There are fewer shards than in proportion to the words (a power of ``GROW``), so
their weights become a smaller part of the input as it grows, and they are summed
in a tree.

Cases: null and empty texts, and texts without words, have no words, a
pseudo-log-likelihood of 0 and a null mean; repeated rows get the same result
(rows that are alike in all columns lie in one shard); an empty table gives an empty
result; other columns pass unchanged, of any name but those added.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import words
from framewell.session import cut_lineage

#: Bits of a rarer word's leaf, words on either side, width of the state, whose last unit is always 1, and classes.
BITS, SIDE, HIDDEN, CLASSES = 12, 2, 8, 64
#: Words that are leaves themselves, at most (but INPUTS at least); leaves are numbered with 16 bits.
HEAD = (1 << 16) - (1 << BITS)
#: Inputs that are embedded: the most frequent words have their own, the rest share the last ones.
INPUTS, SHARED_INPUTS = 4096, 256
RATE, BATCH, SEED = 0.15, 4096, 13
#: Words that are shuffled with each other within a shard, and that are scored at once.
CHUNK, STEP = 1 << 17, 8192
#: Shards: words / SHARD to the power of GROW; one in FIRST texts makes the first round; weights that a task sums.
SHARD, GROW, FIRST, FAN = 1_000_000, 0.75, 8, 8
#: Columns that are added.
ADDED = ("n_words", "log_likelihood", "mean_log_likelihood")
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


@dataclass
class Tree:
    """For each leaf its class, and the inner nodes from the class to it with the turn (1 or -1) at each, as one list with the leaves' starts in it."""

    classes: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray

    @staticmethod
    def of(weight: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
        """Huffman's trees of leaf weights, and the log odds at each inner node and logarithms of the classes' shares that make a leaf's probability its share."""
        n = len(weight)
        order = np.argsort(-weight, kind="stable")
        heap = [(float(weight[k]), -place, int(k)) for place, k in enumerate(order)]
        heapq.heapify(heap)
        inners = max(0, n - CLASSES)
        above, side, odds = np.full(n + inners, -1), np.zeros(n + inners, np.int8), np.zeros(inners, np.float32)
        for inner in range(inners):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            above[a[2]], above[b[2]], side[a[2]], side[b[2]] = n + inner, n + inner, 1, -1
            odds[inner] = np.log(a[0]) - np.log(b[0])
            heapq.heappush(heap, (a[0] + b[0], 1 + inner, n + inner))
        shares = np.array([w for w, _, _ in heap])
        root, depth = np.full(n + inners, -1), np.zeros(n + inners, np.int64)
        root[[k for _, _, k in heap]] = np.arange(len(heap))
        for k in range(n + inners - 1, -1, -1):
            if above[k] >= 0:
                root[k], depth[k] = root[above[k]], depth[above[k]] + 1
        starts = np.concatenate([[0], np.cumsum(depth[:n])])
        nodes, turns = np.zeros(starts[-1], np.uint16), np.zeros(starts[-1], np.int8)
        at, own = np.arange(n), np.arange(n)
        for step in range(1, depth.max() + 1):
            own = own[depth[own] >= step]
            put = starts[own] + depth[own] - step
            nodes[put], turns[put] = above[at[own]] - n, side[at[own]]
            at[own] = above[at[own]]
        return Tree(root[:n], starts, nodes, turns), odds, np.log(shares / shares.sum())

    def sizes(self, leaf: np.ndarray) -> np.ndarray:
        return self.starts[leaf + 1] - self.starts[leaf]

    def longest(self, leaf: np.ndarray) -> np.ndarray:
        """The order of leaves by their paths' sizes, the longest first."""
        sizes = self.sizes(leaf)
        return np.argsort((sizes.max(initial=0) - sizes).astype(np.uint16), kind="stable")

    def steps(self, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Node and turn of each step of the paths to leaves that are sorted by their paths' sizes, the longest first; each step is one of the first leaves."""
        at = self.starts[leaf]
        left = np.bincount(self.starts[leaf + 1] - at)
        for n in (len(leaf) - np.cumsum(left))[:-1].tolist():
            yield np.take(self.nodes, at[:n]), np.take(self.turns, at[:n])
            at += 1


@dataclass
class Vocabulary:
    """Sorted hashes of the known words; for these and then each shared leaf the input, and the logarithm of the weight; the tree over them and what it begins with."""

    known: np.ndarray
    inputs: np.ndarray
    weight: np.ndarray
    tree: Tree
    odds: np.ndarray
    shares: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, known: np.ndarray) -> Vocabulary:
        """From the counts of the known words and then of the shared leaves; known words rank before these."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((-counts, np.arange(len(counts)) >= len(known)))] = np.arange(len(counts))
        own = INPUTS - SHARED_INPUTS
        inputs = np.where(rank < own, rank, own + rank % SHARED_INPUTS)
        return Vocabulary(known, inputs, np.log(counts + 0.5), *Tree.of(counts + 0.5))

    def leaves(self, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each word, and the hash of each distinct word."""
        keys = words.hashes(found.distinct)
        return self.leaf(words.Keyed(keys, found.ids, found.starts)), keys

    def leaf(self, found: words.Keyed) -> np.ndarray:
        """The leaf of each word."""
        keys = found.keys
        leaf = (keys >> np.uint64(64 - BITS)).astype(np.int64) + len(self.known)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            leaf = np.where(self.known[at] == keys, at, leaf)
        return np.take(leaf, found.ids) if len(found.ids) else np.zeros(0, np.int64)


def contexts(inputs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The inputs around each word; beyond a document's ends they are INPUTS."""
    at = np.arange(len(inputs)) + np.repeat(SIDE * np.arange(1, len(starts)), np.diff(starts))
    padded = np.full(len(inputs) + SIDE * len(starts), INPUTS)  # edges before, between and after the documents
    padded[at] = inputs
    out = np.empty((len(inputs), len(PLACES)), np.int64)
    for k, step in enumerate(PLACES):
        out[:, k] = np.take(padded, at + step)
    return out


def summed(keys: np.ndarray, rows: np.ndarray, times: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different one of 16-bit keys, the sum of its rows, and how often it occurs; each row has so many consecutive keys."""
    if not len(keys):
        return np.zeros(0, np.int64), rows, np.zeros(0, np.int64)
    kind, low = (np.uint32, 16) if len(keys) <= 1 << 16 else (np.uint64, 48)
    sort = keys.astype(kind)
    sort <<= kind(low)
    sort |= np.arange(len(keys), dtype=kind)
    sort.sort()  # by key, then by place: numbers are sorted faster than places by them
    order = (sort & kind((1 << low) - 1)).astype(np.int64)
    sort >>= kind(low)
    first = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]]))
    pairs = np.take(rows, order // times if times > 1 else order, axis=0).view(np.complex64)  # two numbers are added at once
    return sort[first].astype(np.int64), np.add.reduceat(pairs, first, axis=0).view(np.float32), np.diff(np.append(first, len(keys)))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows, added in an order that depends on no row's place."""
    pairs = (a * b).view(np.complex64)
    out = pairs[:, 0] + pairs[:, 1]
    for k in range(2, HIDDEN // 2):
        out += pairs[:, k]
    return out.real + out.imag


def spread(x: np.ndarray) -> np.ndarray:
    """Each number as a row of it: whole arrays are multiplied faster than rows by numbers."""
    return np.repeat(x, HIDDEN).reshape(-1, HIDDEN)


def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Replace whole rows."""
    kind = f"V{HIDDEN * rows.itemsize}"
    np.put(rows.view(kind), at, values.view(kind))


@dataclass
class Network:
    """Embeddings (places x inputs and edge, hidden), weights of the inner nodes and of the classes (hidden; the last one is the bias)."""

    embed: np.ndarray
    out: np.ndarray
    top: np.ndarray

    @staticmethod
    def new(vocabulary: Vocabulary) -> Network:
        """Random embeddings; no weights but the words' shares."""
        embed = np.random.default_rng(SEED).normal(0, 0.1, (len(PLACES) * (INPUTS + 1), HIDDEN)).astype(np.float32)
        out, top = (np.zeros((len(x), HIDDEN), np.float32) for x in (vocabulary.odds, vocabulary.shares))
        out[:, -1], top[:, -1] = vocabulary.odds, vocabulary.shares
        return Network(embed, out, top)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed, self.out, self.top])

    @staticmethod
    def shaped(flat: np.ndarray, like: Network) -> Network:
        return Network(*(x.astype(np.float32) for x in np.split(flat, np.cumsum([len(like.embed), len(like.out)]))))

    def state(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.embed, context[:, 0], axis=0)
        for k in range(1, len(PLACES)):
            h += np.take(self.embed, context[:, k] + k * (INPUTS + 1), axis=0)
        np.tanh(h, out=h)
        h[:, -1] = 1
        return h

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the probabilities of classes are in proportion to, and its sum; in whole blocks of rows, so that a row's place in them changes next to nothing."""
        n = len(h)
        x = (np.concatenate([h, np.zeros((-n % 64, HIDDEN), np.float32)]) if n % 64 else h) @ self.top.T
        if not np.abs(self.top).sum(axis=1).max() < 80:  # a state's units are within -1 and 1
            np.minimum(x, 80, out=x)
        np.exp(x, out=x)
        return x[:n], x.sum(axis=1)[:n]

    def log_probabilities(self, context: np.ndarray, leaf: np.ndarray, tree: Tree) -> np.ndarray:
        """The logarithm of each leaf's probability, given the inputs around it."""
        out = np.empty(len(leaf))
        order = tree.longest(leaf)
        for k in range(0, len(leaf), STEP):
            at = order[k : k + STEP]
            own, h = leaf[at], self.state(np.take(context, at, axis=0))
            x, total = self.classes(h)
            found = np.log(x[np.arange(len(at)), tree.classes[own]].astype(np.float64)) - np.log(total.astype(np.float64))
            for nodes, turns in tree.steps(own):
                found[: len(nodes)] -= np.log(1 + np.exp(-turns * dots(np.take(self.out, nodes, axis=0), h[: len(nodes)])))
            out[at] = found
        return out

    def gradient(self, context: np.ndarray, leaf: np.ndarray, tree: Tree) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the negative log-likelihood of leaves, the longest paths first: for embeddings, nodes and classes the rows used, their gradients and how often they are used."""
        h = self.state(context)
        p, total = self.classes(h)
        p *= (1 / total)[:, None]
        p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + tree.classes[leaf]] -= 1
        dh, size, at = p @ self.top, int(tree.sizes(leaf).sum()), 0
        seen, into = np.empty(size, np.uint16), np.empty((size, HIDDEN), np.float32)
        for nodes, turns in tree.steps(leaf):
            w, own, end = np.take(self.out, nodes, axis=0), h[: len(nodes)], at + len(nodes)
            g = spread(-turns / (1 + np.exp(turns * dots(w, own))))
            np.multiply(own, g, out=into[at:end])
            w *= g
            dh[: len(nodes)] += w
            seen[at:end], at = nodes, end
        dh *= 1 - h * h  # none for the constant
        places = (context + np.arange(len(PLACES)) * (INPUTS + 1)).astype(np.uint16).ravel()
        return [summed(places, dh, len(PLACES)), summed(seen, into), (np.arange(len(p.T)), p.T @ h, np.full(len(p.T), len(leaf)))]


class Learner:
    """A network that learns, with the squares of each row's gradients and how often it was used."""

    def __init__(self, network: Network, vocabulary: Vocabulary):
        self.network, self.vocabulary = Network(network.embed.copy(), network.out.copy(), network.top.copy()), vocabulary
        self.weights = (self.network.embed, self.network.out, self.network.top)
        self.squares = [np.full(len(x), 0.1, np.float32) for x in self.weights]
        self.times = [np.zeros(len(x), np.int64) for x in self.weights]
        self.seen = 0

    def learn(self, leaf: np.ndarray, starts: np.ndarray) -> None:
        """One pass of Adagrad (a rate for each row) over the shuffled words of documents."""
        context = contexts(self.vocabulary.inputs[leaf], starts)
        order = np.random.default_rng(SEED).permutation(len(leaf))
        for k in range(0, len(leaf), BATCH):
            at = order[k : k + BATCH]
            at = at[self.vocabulary.tree.longest(leaf[at])]
            for own, squares, times, (used, g, n) in zip(self.weights, self.squares, self.times, self.network.gradient(np.take(context, at, axis=0), leaf[at], self.vocabulary.tree), strict=True):
                square = np.take(squares, used) + dots(g, g) / HIDDEN
                squares[used] = square
                g *= spread(RATE / np.sqrt(square))
                put(own, used, np.take(own, used, axis=0) - g)
                times[used] += n
        self.seen += len(leaf)

    def change(self, start: Network) -> tuple[bytes, bytes]:
        """How often each row was used, and the rows' changes times that."""
        times = np.concatenate(self.times)
        return times.tobytes(), ((Network(*self.weights).flat() - start.flat()) * times[:, None].astype(np.float32)).tobytes()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of all words, for each slice of a partition."""
    for batch in batches:
        for some in words.slices(batch, "text"):
            found = words.keyed(words.texts(some, "text"))
            n = np.bincount(found.ids, minlength=len(found.keys)) if len(found.ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(found.keys.view(np.int64)), "n": pa.array(n, pa.int64())})


def frequent(counts: DataFrame) -> dict[int, int]:
    """Counts of the INPUTS most frequent words, and of all whose count reaches the least level that at most HEAD words do."""
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    reach = np.flatnonzero(np.cumsum([n for _, n in sizes]) <= HEAD)
    rows = counts.orderBy(F.desc("n"), "word").limit(INPUTS).collect()
    if len(reach):
        rows += counts.where(level >= sizes[reach[-1]][0]).collect()
    return {r["word"]: r["n"] for r in rows}


def count(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts (word, n) of all words."""
    table = cut_lineage(docs.select(F.col(text).alias("text")).mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    head = frequent(table)
    known, n = np.array(list(head), np.int64).view(np.uint64), np.array(list(head.values()), np.float64)
    order = np.argsort(known)
    known, n = known[order], n[order]
    shared = np.zeros(1 << BITS)
    leaf = F.shiftrightunsigned("word", 64 - BITS).cast("int")
    for r in table.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        shared[r["leaf"]] = r["n"] + (r["words"] - 1) / 2
    np.add.at(shared, (known >> np.uint64(64 - BITS)).astype(np.int64), -n - 0.5)  # what known words have of the leaves' sums
    return Vocabulary.of(np.concatenate([n, np.maximum(shared, 0)]), known), table


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep_text: bool = True) -> DataFrame:
    """(row, n, leaves, others, lot): each document's columns, number of words, leaves of its words, words that are no leaves with their number, and a hash of all that."""
    rest = [f for f in docs.schema.fields if f.name not in ADDED and (keep_text or f.name != text)]
    names = [f.name for f in rest]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pair = pa.struct([("word", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for some in words.slices(batch, text):
                found = words.keyed(words.texts(some, text))
                leaf, keys = vocabulary.leaf(found), found.keys
                counts = np.diff(found.starts)
                given = pa.StructArray.from_arrays([some.column(some.schema.get_field_index(c)) for c in names], names=names) if names else pa.nulls(some.num_rows, pa.struct([]))
                leaves = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer((2 * found.starts).astype(np.int32)), pa.py_buffer(leaf.astype(np.uint16))])
                other = np.flatnonzero(leaf >= len(vocabulary.known))
                own, times = np.unique(np.repeat(np.arange(some.num_rows), counts)[other] * max(1, len(keys)) + found.ids[other], return_counts=True) if len(leaf) else (other, other)
                ends = np.searchsorted(own, np.arange(some.num_rows + 1) * max(1, len(keys)))
                listed = pa.StructArray.from_arrays([pa.array(keys[own % max(1, len(keys))].view(np.int64)), pa.array(times, pa.int64())], fields=list(pair))
                yield pa.RecordBatch.from_arrays([given, pa.array(counts, pa.int64()), leaves, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)], names=["row", "n", "leaves", "others"])

    others = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("times", T.LongType())]))
    kind = T.StructType([T.StructField("row", T.StructType(rest)), T.StructField("n", T.LongType()), T.StructField("leaves", T.BinaryType()), T.StructField("others", others)])
    row = F.to_json("row") if "map<" in kind["row"].dataType.simpleString() else F.col("row")
    return cut_lineage(docs.mapInArrow(run, kind).withColumn("lot", F.xxhash64(row, "leaves")))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves, and where each document starts and the last ends, of consecutive documents of CHUNK words together or more."""
    held: list[np.ndarray] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(held).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in held])])

    for batch in batches:
        for leaves in batch.column(batch.schema.get_field_index("leaves")):
            held.append(np.frombuffer(leaves.as_buffer(), np.uint16).copy())
            size += len(held[-1])
            if size >= CHUNK:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


@dataclass
class Model:
    """Vocabulary and network; the counts (word, n) of all words, and how many words the network was trained on."""

    vocabulary: Vocabulary
    network: Network
    counts: DataFrame | None = None
    trained: int = 0


def train(encoded: DataFrame, vocabulary: Vocabulary, total: int) -> tuple[Network, int]:
    """The network trained on every word of encoded documents, and how many these were."""
    network, trained = Network.new(vocabulary), 0
    for first in (True, False):
        n = max(1, math.ceil((total * (1 / FIRST if first else 1 - 1 / FIRST) / SHARD) ** GROW))
        turn = F.pmod("lot", F.lit(FIRST))
        own = encoded.where((F.col("n") > 0) & ((turn == 0) if first else (turn != 0))).select(F.pmod(F.shiftright("lot", 8), F.lit(n)).cast("int").alias("shard"), "lot", "leaves")
        shared = encoded.sparkSession.sparkContext.broadcast((vocabulary, network))
        rows = len(network.flat())

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, start = shared.value
            learner = Learner(start, vocabulary)
            for leaf, starts in chunks(batches):
                learner.learn(leaf, starts)
            if learner.seen:
                times, change = learner.change(start)
                yield pa.RecordBatch.from_pydict({"seen": [learner.seen], "times": [times], "change": [change]})
            words.release()

        def add(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            seen, times, change = 0, np.zeros(rows, np.int64), np.zeros(rows * HIDDEN)
            for batch in batches:
                for n, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    more = b.as_buffer()
                    seen, times = seen + n, times + np.frombuffer(a.as_buffer(), np.int64)
                    change += np.frombuffer(more, np.float64 if len(more) == 8 * len(change) else np.float32)
            if seen:
                yield pa.RecordBatch.from_pydict({"seen": [seen], "times": [times.tobytes()], "change": [change.tobytes()]})
            words.release()

        kind = "seen long, times binary, change binary"
        parts = own.repartitionById(n, F.col("shard")).sortWithinPartitions("lot", "leaves").select("leaves").mapInArrow(learn, kind)
        while n > 1:
            n = math.ceil(n / FAN)
            parts = parts.withColumn("to", F.floor(F.spark_partition_id() / FAN).cast("int")).repartitionById(n, F.col("to")).drop("to").mapInArrow(add, kind)
        for p in parts.collect():
            times = np.frombuffer(p["times"], np.int64)
            change = np.frombuffer(p["change"], np.float64 if len(p["change"]) == 8 * rows * HIDDEN else np.float32).reshape(rows, HIDDEN)
            network, trained = Network.shaped(network.flat() + change / np.maximum(times, 1)[:, None], network), trained + p["seen"]
    return network, trained


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count and train over all documents."""
    vocabulary, counts = count(docs, text)
    return trained(encode(docs, vocabulary, text, keep_text=False), vocabulary, counts)


def trained(encoded: DataFrame, vocabulary: Vocabulary, counts: DataFrame) -> Model:
    """The model of encoded documents."""
    network, n = train(encoded, vocabulary, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return Model(vocabulary, network, counts, n)


def fit_score(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """What ``score`` gives with the model that ``fit`` gives; texts are encoded once for both."""
    vocabulary, counts = count(docs, text)
    encoded = encode(docs, vocabulary, text, keep_text)
    return scored(encoded, trained(encoded, vocabulary, counts))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Documents with ``n_words``, ``log_likelihood`` and its ``mean_log_likelihood`` per word added; without the text if it isn't to be kept."""
    return scored(encode(docs, model.vocabulary, text, keep_text), model)


def scored(encoded: DataFrame, model: Model) -> DataFrame:
    """The rows of encoded documents with their scores."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model(model.vocabulary, model.network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = []
            for leaf, starts in chunks(iter([batch])):
                each = model.network.log_probabilities(contexts(model.vocabulary.inputs[leaf], starts), leaf, model.vocabulary.tree)
                each -= np.where(leaf >= len(model.vocabulary.known), model.vocabulary.weight[leaf], 0)
                parts.append(np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), weights=each, minlength=len(starts) - 1).astype(float))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["at", "row", "n", "part"])
            words.release()

    numbered = encoded.withColumn("at", F.monotonically_increasing_id())
    given = numbered.select("at", "row", "n", "leaves")
    held = given.mapInArrow(run, T.StructType([*given.schema.fields[:3], T.StructField("part", T.DoubleType())]))
    lone = numbered.select("at", F.explode("others").alias("o")).select("at", "o.word", "o.times")
    lone = lone.join(model.counts.select("word", F.col("n").alias("own")), "word", "left") if model.counts is not None else lone.withColumn("own", F.lit(0))
    terms = F.array_sort(F.collect_list(F.col("times") * F.log(F.coalesce("own", F.lit(0)) + 0.5)))  # in order, so that equal texts get equal sums
    more = lone.groupBy("at").agg(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("more"))
    whole = F.col("part") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n") > 0, whole / F.col("n"))
    names = encoded.schema["row"].dataType.names
    return held.join(more, "at", "left").select(*(F.col("row").getField(c).alias(c) for c in names), F.col("n").alias("n_words"), whole.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
