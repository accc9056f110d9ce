"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap.

A text is the multiset of its shingles of ``SHINGLE`` words. For each shingle
and each dyadic level of weight, (0, 1], (1, 2], (2, 4], (4, 8] and so on,
points of a Poisson process are drawn from its hash in order of time; each
belongs to a random slot and to a height within the level, and counts if the
shingle's multiplicity reaches that height. A slot's value is its earliest
counted point, so two texts agree in a slot with their weighted Jaccard
similarity as probability. A process stops once it is later than all slots.

Texts of the same words are one node. Nodes that agree in all slots of a band
share its bucket. Nodes of a bucket are ranked by the sum of their buckets'
sizes (what is closest to all others comes first), and each is compared
with the bucket's first ``CENTRES``; so buckets of one node more are compared in
full. The overlap of shingle multisets is counted exactly; pairs with a
similarity of at least the threshold are links, and connected components of
links are the classes. What is left in larger buckets, nodes outside the
most frequent component, is compared with all of the bucket's other components,
in blocks.

Cases: null and empty texts have no words and are classes by themselves
each; shorter texts than a shingle are one shingle; copies share a class; a row
with a null doc_id belongs to the class of its text, which is named by the
least doc_id (null if there is none); an empty table gives an empty result.
Documents join their text's class by its node, which copies share; nodes and classes
that hold many rows are joined by themselves.
Words are compared in lower case without surrounding punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import words
from framewell.operators import components
from framewell.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
#: 24 bands of 4 slots miss a pair of similarity 0.8 with a probability of 0.000003.
BANDS, WIDE, CENTRES = 24, 4, 8
SLOTS = BANDS * WIDE
#: Shingles that a block of a large bucket's leftovers, and of its members, has on average at most.
LEFT, MEMBERS = 100_000, 400_000
#: Bits of a shingle's hash within a document.
KEEP = 44
#: Keys that are joined by themselves at most: those that hold more than one in so many rows.
HOT = 2000


def shingles(found: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash (KEEP bits) and multiplicity of each document's distinct shingles, in that order."""
    n, starts = found.counts, found.starts
    own = words.hashes(found.distinct)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    docs = found.docs()
    size = len(own)
    left = starts[1:][docs] - np.arange(size)  # words from here to the document's end
    whole = np.minimum(n[docs], SHINGLE)
    heads = left >= whole
    h = np.zeros(size, np.uint64)
    for k in range(SHINGLE):
        to = max(size - k, 0)
        h[:to] += np.where(left[:to] > k, own[k:] * np.uint64(2 * k + 1), np.uint64(0))
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    h = words.mix(h)[heads]
    key = (docs[heads].astype(np.uint64) << np.uint64(KEEP)) | (h >> np.uint64(64 - KEEP))
    key, times = np.unique(key, return_counts=True)
    return (key >> np.uint64(KEEP)).astype(np.int64), key & np.uint64((1 << KEEP) - 1), times


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, n_docs: int) -> np.ndarray:
    """The time of the earliest counted point of each document and slot."""
    best = np.full(n_docs * SLOTS, np.inf)
    owner, seed, weight, low, width = doc, words.mix(shingle), times, np.zeros(len(doc)), np.ones(len(doc))
    at: list[tuple[np.ndarray, ...]] = []
    while len(owner):  # one entry for each level that a multiplicity reaches
        at.append((owner, words.mix(seed ^ low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), weight, low, width))
        more = weight > low + width
        owner, seed, weight, low, width = owner[more], seed[more], weight[more], (low + width)[more], width[more]
        width = np.where(low > 1, low, 1.0)
    if not at:
        return best.reshape(n_docs, SLOTS)
    owner, seed, weight, low, width = (np.concatenate(c) for c in zip(*at, strict=True))
    time, step = np.zeros(len(owner)), 0
    while len(owner):
        step += 1
        x = words.mix(seed + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        time = time - np.log(uniform(x)) / (SLOTS * width)
        y = words.mix(x)
        slot = (y >> np.uint64(40)).astype(np.int64) % SLOTS
        counts = low + width * uniform(y << np.uint64(24)) < weight
        np.minimum.at(best, (owner * SLOTS + slot)[counts], time[counts])
        goes = time < best.reshape(n_docs, SLOTS).max(axis=1)[owner]
        if not goes.all():
            owner, seed, weight, low, width, time = (c[goes] for c in (owner, seed, weight, low, width, time))
    return best.reshape(n_docs, SLOTS)


def buckets(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band's bucket."""
    bits = signature.view(np.uint64).reshape(-1, BANDS, WIDE)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2])
    for k in range(WIDE):
        h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) ^ bits[:, :, k])
    return h.view(np.int64)


def digests(found: words.Words) -> list[bytes | None]:
    """128 bits that name the sequence of words of each document; None without words."""
    own = words.hashes(found.distinct)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    place = np.arange(len(own)) - np.repeat(found.starts[:-1], found.counts)
    parts = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(own + words.mix(place.astype(np.uint64) + np.uint64(salt))), dtype=np.uint64)])
        parts.append(x[found.starts[1:]] - x[found.starts[:-1]])
    return [a.tobytes() + b.tobytes() if n else None for a, b, n in zip(*parts, found.counts, strict=True)]


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, node, n, bands): a hash of the text as it stands, the digest of its words (null without any), the number of shingles, and bucket names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text"):
                found = words.normalised(words.texts(some, "text"))
                doc, shingle, times = shingles(found)
                bands = buckets(signatures(doc, shingle, times, some.num_rows))
                n = np.bincount(doc, weights=times, minlength=some.num_rows).astype(np.int64)
                ends = pa.array(np.arange(0, BANDS * some.num_rows + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(digests(found), pa.binary()), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))], names=["doc_id", "body", "node", "n", "bands"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    new = [T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return given.mapInArrow(run, T.StructType([given.schema["doc_id"], given.schema["body"], *new]))


def _first(doc_id: str = "doc_id") -> Column:
    """The least (doc_id, body) of a group, ids that are null last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), "body"))


def bags(docs: DataFrame) -> DataFrame:
    """(node, bag) of texts: hashes of the shingles, each repetition with its number, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch, "text"):
                found = words.normalised(words.texts(some, "text"))
                doc, shingle, times = shingles(found)
                number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                hashes = words.mix(np.repeat(shingle, times) + (number.astype(np.uint64) << np.uint64(KEEP))) >> np.uint64(33)
                owner = np.repeat(doc, times)
                order = np.lexsort((hashes, owner))
                ends = pa.array(np.searchsorted(owner, np.arange(some.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(digests(found), pa.binary()), pa.ListArray.from_arrays(ends, pa.array(hashes[order].astype(np.int32)))], names=["node", "bag"])

    return docs.select("text").mapInArrow(run, "node binary, bag array<int>")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of rows with two bags."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            some = batch.slice(k, 1000)
            sides = []
            for name in ("bag_a", "bag_b"):
                lists = some.column(some.schema.get_field_index(name))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                sides.append(((np.repeat(np.arange(len(sizes)), sizes) << 32) | lists.flatten().to_numpy(zero_copy_only=False), sizes))
            (x, nx), (y, ny) = sides
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = both[1:][both[1:] == both[:-1]] >> 32
            shared = np.bincount(same, minlength=some.num_rows)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(shared / np.maximum(nx + ny - shared, 1))], names=["a", "b", "similarity"])
        words.release()


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, size, weight) of buckets with two nodes and more; weight is the sum of the sizes of a node's buckets."""
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut_lineage(members.join(sizes, "bucket"))
    return cut_lineage(shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node"))


def candidates(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a node and a centre of one of its buckets, of sizes that allow the threshold."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "node"))
    first = shared.withColumn("place", place).where(F.col("place") <= CENTRES).groupBy("bucket").agg(F.collect_list(F.struct("node", "n")).alias("centres"))
    met = shared.join(first, "bucket").groupBy("node", "n").agg(F.array_distinct(F.flatten(F.collect_list("centres"))).alias("centres"))
    pairs = met.select("node", "n", F.explode(F.filter("centres", lambda c: (c["node"] != F.col("node")) & (F.least(c["n"], F.col("n")) >= THRESHOLD * F.greatest(c["n"], F.col("n"))))).alias("c"))
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def bags_of(docs: DataFrame, nodes: DataFrame, met: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, bag) of the nodes that ``met`` lists; only their first documents' texts are shuffled."""
    rows = nodes.join(met, "node").select(F.col("first.doc_id").alias("_id"), F.col("first.body").alias("_body"))
    texts = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("text")).join(rows, F.col("_own").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_body")))
    return cut_lineage(bags(texts).where("node is not null").dropDuplicates(["node"]))


def verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    both = pairs.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    found = both.select("a", "b", "bag_a", "bag_b").mapInArrow(_overlap, "a binary, b binary, similarity double")
    return found.where(F.col("similarity") >= THRESHOLD).select("a", "b")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the leftovers and the members of a block that share a bucket and are in different components."""
    for batch in batches:
        for left, members in zip(batch.column(0), batch.column(1), strict=True):
            left, members = left.as_py(), members.as_py()
            x, y = (np.array([m["bands"] for m in side], np.int64).reshape(-1, BANDS) for side in (left, members))
            n = np.array([m["n"] for m in members])
            bag = [np.array(m["bag"], np.int32) for m in members]
            kin: dict[bytes, int] = {}
            comp = np.array([kin.setdefault(m["comp"], len(kin)) for m in members])
            names: list[tuple[bytes, bytes]] = []
            for k, own in enumerate(left):
                mine, there = np.array(own["bag"], np.int32), kin.get(own["comp"], -1)
                worth = (y == x[k]).any(axis=1) & (comp != there) & (np.minimum(n, own["n"]) >= THRESHOLD * np.maximum(n, own["n"]))
                for at in np.flatnonzero(worth):
                    shared = len(np.intersect1d(mine, bag[at], assume_unique=True))
                    if shared >= THRESHOLD * (len(mine) + len(bag[at]) - shared):
                        names.append((min(own["node"], members[at]["node"]), max(own["node"], members[at]["node"])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in names], pa.binary()), "b": pa.array([b for _, b in names], pa.binary())})
        words.release()


def remaining(large: DataFrame, roots: DataFrame, nodes: DataFrame, bag: DataFrame) -> DataFrame:
    """Links (a, b) that comparing with centres left out: in a large bucket, of nodes outside its most frequent component with all others.

    Buckets of one most frequent component are one family, so a node's bag moves once for it. A family's nodes are dealt to
    blocks by a hash; each block of leftovers meets each block of members in a row of its own, so no task holds a family.
    """
    members = large.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    kinds = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    facts = kinds.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("bucket", "main")
    family = cut_lineage(members.join(facts, "bucket").select("main", "node", "n", "comp").distinct())
    sums = family.groupBy("main").agg(F.sum("n").alias("every"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("n"))).alias("outside"))
    blocks = sums.select("main", F.ceil(F.col("outside") / LEFT).cast("int").alias("nl"), F.ceil(F.col("every") / MEMBERS).cast("int").alias("nm"))
    row = F.struct("node", "comp", "n", "bands", "bag").alias("row")
    full = cut_lineage(family.join(blocks, "main").join(bag, "node").join(nodes.select("node", "bands"), "node").select("main", "nl", "nm", (F.col("comp") != F.col("main")).alias("out"), F.xxhash64(F.lit("block"), "node").alias("lot"), row))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = full.where("out").select("main", F.pmod("lot", "nl").cast("int").alias("l"), steps("nm").alias("m"), "row").groupBy("main", "l", "m").agg(F.collect_list("row").alias("left"))
    right = full.select("main", steps("nl").alias("l"), F.pmod("lot", "nm").cast("int").alias("m"), "row").groupBy("main", "l", "m").agg(F.collect_list("row").alias("members"))
    return left.join(right, ["main", "l", "m"]).select("left", "members").mapInArrow(_across, "a binary, b binary").distinct()


def links(docs: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b), and (node, root) of the components that they make."""
    shared = shared_buckets(nodes)
    pairs = cut_lineage(candidates(shared))
    large = cut_lineage(shared.where(F.col("size") > CENTRES + 1).select("bucket", "node", "n"))
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    bag = bags_of(docs, nodes, met, doc_id, text)
    found = cut_lineage(verified(pairs, bag).distinct())
    roots = components.connected(found, "a", "b")
    if not large.isEmpty():
        more = cut_lineage(remaining(large, roots, nodes, bag))
        if not more.isEmpty():
            found = cut_lineage(found.unionByName(more).distinct())
            roots = components.connected(found, "a", "b")
    return found, roots


def spread(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows with what ``facts`` (one row a key) has for their key, null where it has nothing; no task gets all rows of a frequent key.

    Keys that hold one in HOT rows or more, which are HOT keys at most, meet their rows where these are; only the others are shuffled.
    """
    most = rows.count() / HOT
    none = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns if c != key))
    rows = rows.where(F.col(key).isNotNull())
    hot = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(most, 100)).select(key))
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = marked.where("_hot IS NULL").drop("_hot").join(facts, key, "left")
    many = marked.where("_hot").drop("_hot").join(F.broadcast(facts.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return few.unionByName(many).unionByName(none)


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, node) of each document (no node without words), and of each node (node, root, compared_links, first, class_first): its class, the number of compared texts that it is linked to, its and its class's first document."""
    sketched = cut_lineage(sketch(docs, doc_id, text))
    nodes = cut_lineage(sketched.where("node is not null").groupBy("node").agg(_first().alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    found, roots = links(docs, nodes, doc_id, text)
    degree = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("compared_links"))
    known = nodes.select("node", "first").join(roots.join(degree, "node"), "node", "left")
    known = cut_lineage(known.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("compared_links", F.lit(0)).cast("long").alias("compared_links"), "first"))
    firsts = known.groupBy("root").agg(F.min("first").alias("class_first"))
    return sketched.select("doc_id", "body", "node"), cut_lineage(spread(known, firsts, "root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, compared_links) of each document; class_id is the least doc_id of its class."""
    rows, nodes = classed(docs, doc_id, text)
    named = spread(rows, nodes.select("node", F.col("class_first.doc_id").alias("class_id"), "compared_links"), "node")
    return named.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("compared_links", F.lit(0)).cast("long").alias("compared_links"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents less all but the first of each class; every document without words stays, repeated rows once."""
    rows, nodes = classed(docs, doc_id, text)
    firsts = nodes.select("class_first").distinct().select(F.col("class_first.doc_id").alias("_id"), F.col("class_first.body").alias("_body"))
    wordless = rows.where("node is null").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct()
    stays = cut_lineage(firsts.unionByName(wordless))
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_own"), F.xxhash64(text).alias("_text"))
    kept = held.join(stays, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_body")), "left_semi")
    repeated = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left_semi").groupBy("doc_id", "body").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # only then are whole rows sorted
        kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("_own", "_text").orderBy("_row"))).where("_nth = 1")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
