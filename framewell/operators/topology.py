"""Invariants of periodic nets: dimension, coordination sequences, TD10, a name from a small table, a hash.

A net's own invariants stand in for an archive of names: a name is given only
where dimension, degrees and sequences equal those of a known net, and
equal sequences don't prove equal nets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.text import is_net_text, record_key
from framewell.operators.nets import net_edges, net_text

SHELLS = 10
# Coordination sequences of known nets, from the closed forms 4k^2+2 and 10k^2+2, and as listed for the others.
KNOWN = {
    "pcu": [[4 * k * k + 2 for k in range(1, SHELLS + 1)]],
    "fcu": [[10 * k * k + 2 for k in range(1, SHELLS + 1)]],
    "dia": [[4, 12, 24, 42, 64, 92, 124, 162, 204, 252]],
    "bcu": [[8, 26, 56, 98, 152, 218, 296, 386, 488, 602]],
    "nbo": [[4, 12, 28, 50, 76, 110, 148, 194, 244, 302]],
    "sql": [[4 * k for k in range(1, SHELLS + 1)]],
    "hcb": [[3 * k for k in range(1, SHELLS + 1)]],
    "tbo": [[3, 9, 15, 33, 45, 82, 90, 153, 150, 241], [4, 8, 20, 30, 60, 68, 120, 126, 200, 180]],
    "bpq": [[4, 14, 30, 66, 90, 152, 178, 274, 294, 432], [6, 14, 38, 60, 104, 138, 202, 248, 332, 390]],
    "rna": [[3, 9, 18, 29, 57, 80, 99, 147, 180, 209], [6, 10, 18, 42, 54, 76, 120, 138, 174, 238]],
}


def name_of(dimension: int, sequences: list[list[int]]) -> str:
    """The known net of these sequences, or UNKNOWN."""
    own = sorted({tuple(s) for s in sequences})
    for name, known in KNOWN.items():
        if own == sorted(map(tuple, known)) and dimension == (2 if name in ("sql", "hcb") else 3):
            return name
    return "UNKNOWN"


def sequence(near: dict[int, list[tuple[int, int, int, int]]], node: int, shells: int = SHELLS) -> list[int]:
    """Numbers of nodes first reached in each shell around a node of a periodic graph."""
    seen, front, out = {(node, 0, 0, 0)}, [(node, 0, 0, 0)], []
    for _ in range(shells):
        further = []
        for u, x, y, z in front:
            for v, a, b, c in near.get(u, ()):
                at = (v, x + a, y + b, z + c)
                if at not in seen:
                    seen.add(at)
                    further.append(at)
        out.append(len(further))
        front = further
    return out


def rank(near: dict[int, list[tuple[int, int, int, int]]], root: int) -> tuple[int, set[int]]:
    """Rank of the lattice of the root's component, and its nodes."""
    import numpy as np

    from framewell.operators.components import lattice_basis

    image, queue, drift = {root: (0, 0, 0)}, [root], []
    for u in queue:
        for v, *s in near.get(u, ()):
            at = tuple(p + q for p, q in zip(image[u], s, strict=True))
            if v not in image:
                image[v] = at
                queue.append(v)
            elif image[v] != at:
                drift.append([p - q for p, q in zip(at, image[v], strict=True)])
    return len(lattice_basis(np.array(drift))) if drift else 0, set(image)


def _invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each component of each structure's net."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("structure_id", "component", "n_nodes", "n_edges", "dimension", "td10", "sequences", "name")}
        for name, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            near: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
            for e in found:
                near[e["u"]].append((e["v"], e["sx"], e["sy"], e["sz"]))
                near[e["v"]].append((e["u"], -e["sx"], -e["sy"], -e["sz"]))
            left, number = set(near), 0
            while left:
                dimension, nodes = rank(near, min(left))
                left -= nodes
                listed = sorted(sequence(near, u) for u in nodes)
                own = {"structure_id": name, "component": number, "n_nodes": len(nodes), "n_edges": sum(e["u"] in nodes for e in found), "dimension": dimension, "td10": round(sum(1 + sum(s) for s in listed) / len(listed), 4), "sequences": listed, "name": name_of(dimension, listed)}
                for k, v in own.items():
                    rows[k].append(v)
                number += 1
        types = [pa.string(), *[pa.int32()] * 4, pa.float64(), pa.list_(pa.list_(pa.int32())), pa.string()]
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(list(zip(rows, types, strict=True))))


def invariants(edges: DataFrame) -> DataFrame:
    """(structure_id, component, n_nodes, n_edges, dimension, td10, sequences, name) of each component of a net."""
    listed = edges.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "sx", "sy", "sz"))).alias("e"))
    return listed.mapInArrow(_invariants, "structure_id string, component int, n_nodes int, n_edges int, dimension int, td10 double, sequences array<array<int>>, name string")


def described(edges: DataFrame, method: str) -> DataFrame:
    """One row for each structure: the components' common name or MISMATCH, and the largest component's invariants."""
    own = invariants(edges)
    best = F.min(F.struct((-F.col("n_edges")).alias("e"), (-F.col("n_nodes")).alias("n"), "component", "dimension", "td10", "sequences"))
    rows = own.groupBy("structure_id").agg(F.when(F.count_distinct("name") == 1, F.min("name")).otherwise("MISMATCH").alias("topology"), best.alias("b"))
    key = F.to_json(F.struct(F.col("b.dimension").alias("dimension"), F.col("b.sequences").alias("sequences")))
    return rows.join(net_text(edges), "structure_id").select("structure_id", F.lit(method).alias("method"), "topology", F.col("b.dimension").alias("dimension"), F.col("b.td10").alias("td10"), F.col("b.sequences").alias("sequences"), F.sha2(key, 256).alias("topology_hash"), "cgd")


def identified(spark: SparkSession, folder: str, pattern: str = "*.cgd", recursive: bool = True) -> DataFrame:
    """One row for each net file of a folder: what ``described`` tells, or an ``error`` where it holds no net."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).format("text").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("source"), "value").select(record_key(F.col("source")).alias("structure_id"), "source", F.col("value").alias("text"))
    found = described(net_edges(named.where(is_net_text(F.col("text")))), "file")
    return named.select("structure_id", "source").join(found, "structure_id", "left").withColumn("error", F.when(F.col("topology").isNull(), "no net"))
