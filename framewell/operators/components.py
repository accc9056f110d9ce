"""Connected components: of one large edge list, and of many small structures at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.session import cut_lineage

KEYS = ["structure_id"]


def _least(edges: DataFrame) -> DataFrame:
    """For each u the least of its neighbours v and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root) of each node that an edge names; root is the least node of its component.

    For graphs of any size: alternates large stars (larger neighbours move to a
    node's least neighbour) and small stars (smaller ones do) until the edges
    are stars. Each round is written to the checkpoint folder; minima are
    aggregated before they are shuffled, and no task holds a component.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut_lineage(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smaller = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        met = smaller.join(_least(smaller), "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut_lineage(small)
        ends = now.select("u", F.lit(1).alias("n")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("n")))
        if ends.groupBy("u").agg(F.sum("n").alias("roots"), F.min("n").alias("root")).where("roots > 1 OR (roots = 1 AND root = 0)").isEmpty():
            break  # every node has one root, and no root has any: all are stars
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def lattice_basis(vectors: np.ndarray) -> list[tuple[int, int, int]]:
    """Row echelon basis of the lattice that integer vectors generate: positive pivots, entries above them reduced."""
    rows = [list(map(int, v)) for v in np.unique(np.asarray(vectors, np.int64).reshape(-1, 3), axis=0) if any(v)]
    basis: list[list[int]] = []
    for column in range(3):
        active = [r for r in rows if r[column]]
        rows = [r for r in rows if not r[column]]
        while len(active) > 1:
            active.sort(key=lambda r: abs(r[column]))
            least = active[0]
            rest = [[x - r[column] // least[column] * y for x, y in zip(r, least, strict=True)] for r in active[1:]]
            active = [least, *(r for r in rest if r[column])]
            rows += [r for r in rest if not r[column] and any(r)]
        if active:
            pivot = active[0] if active[0][column] > 0 else [-x for x in active[0]]
            for above in basis:
                times = above[column] // pivot[column]
                above[:] = [x - times * y for x, y in zip(above, pivot, strict=True)]
            basis.append(pivot)
    return [(r[0], r[1], r[2]) for r in basis]


def modulo(shift: tuple[int, int, int], basis: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The representative of a shift modulo a lattice."""
    s = list(shift)
    for row in basis:
        column = next(k for k in range(3) if row[k])
        times = s[column] // row[column]
        s = [x - times * y for x, y in zip(s, row, strict=True)]
    return s[0], s[1], s[2]


def walk(n: int, i: np.ndarray, j: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """Of a graph whose edges are listed both ways: component (numbered by least node), image of each node, lattice of each component.

    A node's image is the cell it has when its component is unwrapped from its least node, breadth first, along
    least neighbours and then least shifts; an edge that leads back with another image generates the lattice.
    """
    order = np.lexsort((shift[:, 2], shift[:, 1], shift[:, 0], j, i)) if len(i) else np.zeros(0, np.int64)
    i, j, shift = i[order], j[order], shift[order]
    first = np.searchsorted(i, np.arange(n + 1))
    comp, image, number = np.full(n, -1, np.int64), np.zeros((n, 3), np.int64), 0
    for root in range(n):
        if comp[root] >= 0:
            continue
        comp[root], queue = number, [root]
        for u in queue:
            for e in range(first[u], first[u + 1]):
                v = int(j[e])
                if comp[v] < 0:
                    comp[v], image[v] = number, image[u] + shift[e]
                    queue.append(v)
        number += 1
    drift = image[i] + shift - image[j] if len(i) else np.zeros((0, 3), np.int64)
    moved = drift.any(axis=1)
    lattices: list[list[tuple[int, int, int]]] = [[] for _ in range(number)]
    for c in np.unique(comp[i[moved]]) if moved.any() else []:
        lattices[c] = lattice_basis(drift[moved & (comp[i] == c)])
    return comp, image, lattices


VECTOR = T.StructType([T.StructField(x, T.IntegerType()) for x in "xyz"])


def unwrapped(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, atom_id, comp_id, ix, iy, iz, lattice) of each atom, each structure by itself in one task.

    bonds (i, j, sx, sy, sz) stand both ways. A structure is small; its atoms and bonds meet once, by structure_id.
    """
    listed = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_list("atom_id")).alias("atoms"))
    linked = bonds.groupBy("structure_id").agg(F.collect_list(F.struct("i", "j", "sx", "sy", "sz")).alias("bonds"))
    schema = T.StructType([T.StructField("structure_id", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("atom_id", "comp_id", "ix", "iy", "iz")), T.StructField("lattice", T.ArrayType(VECTOR))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema.fields}
            for name, own, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = {a: k for k, a in enumerate(own)}
                links = [b for b in links or [] if b["i"] in place and b["j"] in place]
                i, j = (np.array([place[b[x]] for b in links], np.int64) for x in "ij")
                comp, image, lattices = walk(len(own), i, j, np.array([[b["sx"], b["sy"], b["sz"]] for b in links], np.int64).reshape(-1, 3))
                least = {int(c): own[k] for k, c in reversed(list(enumerate(comp)))}
                rows["structure_id"] += [name] * len(own)
                rows["atom_id"] += own
                rows["comp_id"] += [least[int(c)] for c in comp]
                for k, x in enumerate(("ix", "iy", "iz")):
                    rows[x] += image[:, k].tolist()
                rows["lattice"] += [[dict(zip("xyz", v, strict=True)) for v in lattices[c]] for c in comp]
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("structure_id", pa.string()), *((c, pa.int32()) for c in ("atom_id", "comp_id", "ix", "iy", "iz")), ("lattice", pa.list_(pa.struct([(x, pa.int32()) for x in "xyz"])))]))

    return listed.join(linked, "structure_id", "left").select("structure_id", "atoms", "bonds").mapInArrow(run, schema)


def rings(atoms: DataFrame, bonds: DataFrame, largest: int = 10) -> DataFrame:
    """(structure_id, ring, atoms): the shortest ring through each bond, of at most ``largest`` atoms, that closes in the same cell; equal ones once."""
    linked = bonds.groupBy("structure_id").agg(F.collect_list(F.struct("i", "j", "sx", "sy", "sz")).alias("bonds"))
    known = linked.join(atoms.select("structure_id").distinct(), "structure_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"structure_id": [], "ring": [], "atoms": []}
            for name, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near: dict[int, list[tuple[int, int, int, int]]] = {}
                for b in links:
                    near.setdefault(b["i"], []).append((b["j"], b["sx"], b["sy"], b["sz"]))
                found = set()
                for u, ways in near.items():
                    for v, *s in ways:
                        if u <= v:
                            found |= {frozenset(r) for r in _ring(near, u, (v, *s), largest)}
                for k, ring in enumerate(sorted(map(sorted, found))):
                    rows["structure_id"].append(name)
                    rows["ring"].append(k)
                    rows["atoms"].append(ring)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("structure_id", pa.string()), ("ring", pa.int32()), ("atoms", pa.list_(pa.int32()))]))

    return known.select("structure_id", "bonds").mapInArrow(run, "structure_id string, ring int, atoms array<int>")


def _ring(near: dict[int, list[tuple[int, int, int, int]]], u: int, end: tuple[int, int, int, int], largest: int) -> list[list[int]]:
    """The atoms of a shortest way from u to the image ``end`` of its neighbour without their bond, if there is one."""
    start = (u, 0, 0, 0)
    back: dict[tuple[int, int, int, int], tuple[int, int, int, int] | None] = {start: None}
    front = [start]
    for _ in range(largest - 1):
        further = []
        for at in front:
            for v, *s in near.get(at[0], ()):
                to = (v, at[1] + s[0], at[2] + s[1], at[3] + s[2])
                if to in back or (at == start and to == end):
                    continue
                back[to] = at
                if to == end:
                    way = []
                    step: tuple[int, int, int, int] | None = to
                    while step:
                        way.append(step[0])
                        step = back[step]
                    return [way]
                further.append(to)
        front = further
    return []
