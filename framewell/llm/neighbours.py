"""Approximate nearest neighbours by cosine: NN-descent builds a graph, greedy search walks it.

Equal vectors, and those that are a power of two times another, whose cosines
are the same to the last bit, are one node with many members, so no copies crowd
out other neighbours. Nodes are numbered in the order of their least vec_id,
which settles every tie; their directions are rounded to bytes with a scale each. The
graph begins with random neighbours. Each round joins it with itself: at every
node, its neighbours (and what it is a neighbour of) meet, and pairs of them
not compared before that are nearer than the farthest neighbour either has are
proposed; each node keeps its ``DEGREE`` nearest. Few changes end it.

A search holds for each query a beam of its ``BEAM`` nearest nodes so far,
beginning with its own neighbours. Each hop looks at the neighbours of all
nodes of the beam that were not looked at before, in either direction of the graph, and
ends where there are none. The best of the beam and the query's own node are measured again
in double precision, and the nearest ones' least members are the answer, which all
queries of a node share but for themselves.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers
take no part, as those with another dimension than most; of rows that repeat a
vec_id, or have none, the one with the least vector stands for the id, and none
for null; ties go to the smaller vec_id; with fewer candidates than asked for
all are returned; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.session import cut_lineage

#: Neighbours that a node keeps, reverse neighbours that take part, rounds at most, share of changed neighbours that ends them, nodes in a beam, and of these measured exactly.
DEGREE, REVERSE, ROUNDS, CHANGED, BEAM, EXACT, SEED = 20, 20, 8, 0.08, 256, 48, 11
#: Proposals for each member of a local join.
PROPOSE = 6
ROWS = 512


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Nodes (node, vector, scale, code), their members (node, vec_id), the graph (u, v, sim), and the number of nodes."""

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame
    count: int


def canonical(vector: Column) -> Column:
    """A vector over the power of two that is not above its largest component; exact, and the same for all that differ by a power of two."""
    top = F.array_max(F.transform(vector, F.abs))
    scale = F.pow(F.lit(2.0), F.floor(F.log2(top)))
    return F.transform(vector, lambda x: x / scale + F.lit(0.0))


def numbered(table: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """(node, vector) of the distinct vectors that take part, numbered from 0 by their least vec_id, their members (node, vec_id), and their number."""
    own = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    own = own.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("vector", canonical(F.col("vector")))
    held = cut_lineage(own.withColumn("name", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(5), "vector").alias("b"))))
    sizes = held.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if sizes:
        held = held.where(F.size("vector") == sizes[0]["size"])
    # the name is a 128-bit hash; of equal names the vector is the same
    ordered = held.groupBy("name").agg(F.min("vec_id").alias("least"), F.any_value("vector").alias("vector")).orderBy("least")
    placed = cut_lineage(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = {r["part"]: (r["first"], r["n"]) for r in placed.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for part, (first, n) in sorted(parts.items()):
        base[part] = total - first
        total += n
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("part")) if base else F.lit(0)
    nodes = placed.select((F.col("at") + shift).cast("long").alias("node"), "name", "vector")
    members = held.select("vec_id", "name").join(nodes.select("node", "name"), "name").select("node", "vec_id")
    return nodes.drop("name"), members, total


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add bytes and scale of each vector's direction."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            scale = np.abs(x).max(axis=1) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["node", "vector", "scale", "code"])


def _codes(column: pa.Array, scale: pa.Array) -> np.ndarray:
    """Directions from bytes."""
    n = len(column)
    data = np.frombuffer(column.buffers()[2], np.int8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return data[offsets[0] : offsets[-1]].reshape(n, -1).astype(np.float32) * scale.to_numpy(zero_copy_only=False)[:, None]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals (u, v, sim) from the members that met at each node."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            lists = batch.column(0).slice(k, ROWS)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            member, fresh, far = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = _codes(flat.field(4), flat.field(3))
            row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            shape = (len(sizes), sizes.max())
            ids, news, least, vectors = np.full(shape, -1, np.int64), np.zeros(shape, bool), np.full(shape, np.inf, np.float32), np.zeros((*shape, x.shape[1]), np.float32)
            ids[row, place], news[row, place], least[row, place], vectors[row, place] = member, fresh, far, x
            sim = vectors @ vectors.transpose(0, 2, 1)
            meet = (news[:, :, None] | news[:, None, :]) & (ids[:, :, None] != ids[:, None, :]) & (ids[:, None, :] >= 0) & (sim > least[:, :, None])
            sim = np.where(meet, sim, -9)
            if shape[1] > PROPOSE:
                sim = np.where(sim >= np.partition(sim, shape[1] - PROPOSE, axis=2)[:, :, shape[1] - PROPOSE, None], sim, -9)
            r, i, j = np.nonzero(sim > -9)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r, i]), pa.array(ids[r, j]), pa.array(sim[r, i, j])], names=["u", "v", "sim"])


def _nearest(edges: DataFrame, by: str, keep: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), F.col("v" if by == "u" else "u")))
    return edges.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def build(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> Index:
    """Number the vectors and build their graph."""
    plain, members, n = numbered(table, vec_id, vector)
    members = cut_lineage(members)
    nodes = cut_lineage(plain.mapInArrow(_code, "node long, vector array<double>, scale float, code binary")) if n else plain.withColumn("scale", F.lit(0.0)).withColumn("code", F.lit(b""))
    degree = min(DEGREE, max(n - 1, 0))
    random = np.random.default_rng(SEED)
    steps = sorted({int(x) for x in (random.choice(n - 1, degree, replace=False) + 1 if n - 1 < 1_000_000 else random.integers(1, n, degree))}) if degree else []
    graph = nodes.select(F.col("node").alias("u"), F.explode(F.array(*[F.lit(s).cast("long") for s in steps]) if steps else F.array().cast("array<long>")).alias("step"))
    graph = cut_lineage(graph.select("u", F.pmod(F.col("u") + F.col("step"), F.lit(max(n, 1))).alias("v"), F.lit(-2.0).cast("float").alias("sim"), F.lit(True).alias("new")))
    if n <= DEGREE + 1:
        return Index(nodes, members, graph.select("u", "v", "sim"), n)
    for _ in range(ROUNDS):
        far = graph.groupBy("u").agg(F.min("sim").alias("far"), F.count("*").alias("held"))
        known = nodes.select("node", "scale", "code").join(far, F.col("node") == F.col("u"), "left").select(F.col("node").alias("m"), F.when(F.col("held") >= DEGREE, F.col("far")).otherwise(F.lit(-3.0)).cast("float").alias("far"), "scale", "code")
        shuffled = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v")))
        back = graph.withColumn("_place", shuffled).where(F.col("_place") <= REVERSE)
        around = graph.select(F.col("u").alias("at"), F.col("v").alias("m"), "new").unionByName(back.select(F.col("v").alias("at"), F.col("u").alias("m"), "new"))
        met = around.join(known, "m").groupBy("at").agg(F.collect_list(F.struct("m", "new", "far", "scale", "code")).alias("members"))
        found = met.select("members").mapInArrow(_meet, "u long, v long, sim float")
        merged = graph.where("sim > -2").withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        graph = cut_lineage(_nearest(merged, "u", DEGREE))
        state = graph.agg(F.avg(F.col("new").cast("double"))).first()[0]
        if state < CHANGED:
            break
    return Index(nodes, members, graph.select("u", "v", "sim"), n)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, node, sim) of the neighbours of a looked-at node that may enter its query's beam."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            some = batch.slice(k, ROWS)
            query, own, least = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            q = _codes(some.column(4), some.column(3))
            lists = some.column(5)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            node, x, row = flat.field(0).to_numpy(zero_copy_only=False), _codes(flat.field(2), flat.field(1)), np.repeat(np.arange(len(sizes)), sizes)
            sim = np.einsum("ij,ij->i", x, q[row])
            enters = (sim >= least[row]) & (node != own[row])
            yield pa.RecordBatch.from_arrays([pa.array(query[row[enters]]), pa.array(node[enters]), pa.array(sim[enters])], names=["query", "node", "sim"])


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other vectors found for each vector whose vec_id ``queries`` lists."""
    ids = cut_lineage(queries.select("vec_id").distinct().join(index.members, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")))
    asked = cut_lineage(ids.select("query").distinct().join(index.nodes, F.col("query") == F.col("node")).select("query", F.col("scale").alias("q_scale"), F.col("code").alias("q_code"), F.col("vector").alias("asked")))
    graph = index.graph
    both = graph.select("u", "v").unionByName(_nearest(graph, "v", 2 * REVERSE).select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    coded = index.nodes.select(F.col("node").alias("v"), "scale", "code")
    around = cut_lineage(both.join(coded, "v").groupBy("u").agg(F.collect_list(F.struct("v", "scale", "code")).alias("near")))
    beam = cut_lineage(asked.select("query", F.col("query").alias("node"), F.lit(9.0).cast("float").alias("sim"), F.lit(False).alias("seen")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    while not beam.where("not seen").isEmpty():
        full = beam.where("sim < 9").groupBy("query").agg(F.min("sim").alias("low"), F.count("*").alias("held"))
        front = beam.where("not seen").join(asked.drop("asked"), "query").join(full, "query", "left")
        least = F.when(F.coalesce("held", F.lit(0)) >= BEAM, F.col("low")).otherwise(F.lit(-9.0)).cast("float")
        looked = front.join(around, F.col("node") == F.col("u")).select("query", F.col("query").alias("own"), least.alias("least"), "q_scale", "q_code", "near")
        found = looked.mapInArrow(_look, "query long, node long, sim float")
        held = beam.withColumn("seen", F.lit(True)).unionByName(found.withColumn("seen", F.lit(False)))
        held = held.groupBy("query", "node").agg(F.max("sim").alias("sim"), F.max("seen").alias("seen")).where("sim < 9")
        beam = cut_lineage(held.withColumn("_place", place).where(F.col("_place") <= BEAM).drop("_place"))
    best = beam.withColumn("_place", place).where(F.col("_place") <= EXACT + k).select("query", "node").unionByName(asked.select("query", F.col("query").alias("node")))
    measured = best.join(index.nodes.select("node", "vector"), "node").join(asked.select("query", "asked"), "query").select("query", "node", cosine(F.col("asked"), F.col("vector")).alias("score"))
    # one answer more than asked for, as a query may be among its own node's members
    nearer = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    near = cut_lineage(measured.withColumn("_place", nearer).where(F.col("_place") <= k + 1).drop("_place"))
    least = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    members = index.members.join(near.select("node").distinct(), "node").withColumn("_place", least).where(F.col("_place") <= k + 1).drop("_place")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    answers = near.join(members, "node").select("query", "vec_id", "score").withColumn("_place", first).where(F.col("_place") <= k + 1)
    listed = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_place", "vec_id", "score"))).alias("answers"))
    own = ids.join(listed, "query").select("query_id", F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k).alias("answers"))
    return own.select("query_id", F.posexplode("answers").alias("rank", "a")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; both are scaled by their largest component first, so nothing overflows."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    def scaled(x: Column) -> Column:
        return F.transform(x, lambda p: p / F.array_max(F.transform(x, F.abs)))

    plain = dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))
    safe = dot(scaled(a), scaled(b)) / F.sqrt(dot(scaled(a), scaled(a))) / F.sqrt(dot(scaled(b), scaled(b)))
    size = dot(a, a) * dot(b, b)
    return F.when((size > 1e-200) & (size < 1e200), plain).otherwise(safe)
