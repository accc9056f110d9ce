"""Underlying nets: which nodes a framework has and how they are linked across cells.

All methods return edges (structure_id, u, v, sx, sy, sz), canonical and once, and
nodes (structure_id, node, kind, atoms).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.operators import components, edges
from framewell.operators.components import lattice_basis, modulo
from framewell.session import cut_lineage

if TYPE_CHECKING:
    from framewell.plans.framework import Cut, Framework

SHIFT = ["sx", "sy", "sz"]


def _reduced(rows: DataFrame) -> DataFrame:
    """Rows with ``sx, sy, sz`` as their remainder modulo the lattice that ``lattice_u`` and ``lattice_v`` generate together."""
    names = rows.columns
    plain = [c for c in names if c not in ("lattice_u", "lattice_v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            shifts = []
            for x, y, z, a, b in zip(*(own[c].to_pylist() for c in (*SHIFT, "lattice_u", "lattice_v")), strict=True):
                vectors = [(v["x"], v["y"], v["z"]) for v in (a or []) + (b or [])]
                shifts.append(modulo((x, y, z), lattice_basis(np.array(vectors))) if vectors else (x, y, z))
            columns = [pa.array([s[SHIFT.index(c)] for s in shifts], pa.int32()) if c in SHIFT else own[c] for c in plain]
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in plain]))


def contact_cuts(cut: Cut, bonds: DataFrame) -> DataFrame:
    """The cut bonds that join a cluster (has a metal) to a ligand."""
    members = cut.members.select("structure_id", "atom_id", "comp_id").join(cut.regions.select("structure_id", "comp_id", F.col("has").alias("is_cluster")), ["structure_id", "comp_id"])
    return edges.contacts(cut.cuts, bonds, members)


def incidences(cut: Cut, bonds: DataFrame) -> DataFrame:
    """(structure_id, cluster, ligand, sx, sy, sz, denticity): contacts with their shift modulo both components' lattices, counted."""
    real = contact_cuts(cut, bonds)
    turned = real.select("structure_id", F.when(F.col("cluster_i"), F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("cluster_i"), F.col("j")).otherwise(F.col("i")).alias("j"))
    linked = turned.join(bonds.select("structure_id", "i", "j", *SHIFT), ["structure_id", "i", "j"])
    for end in "ij":
        side = cut.members.select("structure_id", F.col("atom_id").alias(end), F.col("comp_id").alias(f"comp_{end}"), *(F.col(f"i{x}").alias(f"{end}{x}") for x in "xyz"), F.col("lattice").alias(f"lattice_{'uv'['ij'.index(end)]}"))
        linked = linked.join(side, ["structure_id", end])
    shifts = [(F.col(f"i{x}") - F.col(f"j{x}") + F.col(f"s{x}")).cast("int").alias(f"s{x}") for x in "xyz"]
    rows = linked.select("structure_id", F.col("comp_i").alias("cluster"), F.col("comp_j").alias("ligand"), *shifts, "lattice_u", "lattice_v")
    return _reduced(rows).groupBy("structure_id", "cluster", "ligand", *SHIFT).agg(F.count("*").cast("int").alias("denticity"))


def self_edges(cut: Cut, nodes: DataFrame) -> DataFrame:
    """An edge of each periodic node to itself for every vector of its lattice; nodes: (structure_id, comp_id, node)."""
    own = cut.members.where("atom_id = comp_id").select("structure_id", "comp_id", F.explode("lattice").alias("l"))
    return own.join(nodes, ["structure_id", "comp_id"]).select("structure_id", F.col("node").alias("u"), F.col("node").alias("v"), F.col("l.x").alias("sx"), F.col("l.y").alias("sy"), F.col("l.z").alias("sz"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes numbered from 0 in each structure."""
    return nodes.withColumn("node", (F.row_number().over(Window.partitionBy("structure_id").orderBy(*order)) - 1).cast("int"))


def atoms_of(cut: Cut) -> DataFrame:
    return cut.members.groupBy("structure_id", "comp_id").agg(F.array_sort(F.collect_list("atom_id")).alias("atoms"))


def _links(cut: Cut, anchors: DataFrame, lattices: bool) -> DataFrame:
    """(structure_id, node, link, sx, sy, sz): where anchors' bonds reach components that are no nodes.

    anchors: (structure_id, atom_id, node, ox, oy, oz, lattice), the origin being the atom's image within its node.
    """
    near = anchors.select("structure_id", F.col("atom_id").alias("i"), "node", *(f"o{x}" for x in "xyz"), F.col("lattice").alias("lattice_u"))
    nodes = cut.regions.where("NOT is_metal").select("structure_id", "comp_id")
    far = cut.members.join(nodes, ["structure_id", "comp_id"]).select("structure_id", F.col("atom_id").alias("j"), F.col("comp_id").alias("link"), *(F.col(f"i{x}").alias(f"j{x}") for x in "xyz"), F.col("lattice").alias("lattice_v"))
    met = cut.cuts.select("structure_id", "i", "j", *SHIFT).distinct()
    met = edges.both_ways(met, "i", "j").distinct().join(near, ["structure_id", "i"]).join(far, ["structure_id", "j"])
    rows = met.select("structure_id", "node", "link", *((F.col(f"o{x}") + F.col(f"s{x}") - F.col(f"j{x}")).cast("int").alias(f"s{x}") for x in "xyz"), "lattice_u", "lattice_v")
    rows = _reduced(rows) if lattices else rows.drop("lattice_u", "lattice_v")
    return cut_lineage(rows.distinct())


def _whole(cut: Cut) -> DataFrame:
    """Anchors where each metal-bearing component is one node."""
    metal = cut.regions.where("is_metal").select("structure_id", "comp_id")
    return cut.members.join(metal, ["structure_id", "comp_id"]).select("structure_id", "atom_id", F.col("comp_id").alias("node"), *(F.col(f"i{x}").alias(f"o{x}") for x in "xyz"), "lattice")


def _finish(cut: Cut, contracted: DataFrame, more: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number metal nodes first, then links that stayed nodes; nodes: (structure_id, key, kind, atoms) with key < 0 for links."""
    found = cut_lineage(contracted.unionByName(more))
    used = found.select("structure_id", F.explode(F.array("u", "v")).alias("key")).distinct()
    own = nodes.join(used.where("key < 0"), ["structure_id", "key"], "left_semi").unionByName(nodes.where("key >= 0"))
    listed = cut_lineage(numbered(own.withColumn("late", F.col("key") < 0).withColumn("at", F.abs("key")), ["late", "at"]).drop("late", "at"))
    name = lambda end: listed.select("structure_id", F.col("key").alias(end), F.col("node").alias(f"n_{end}"))
    renamed = found.join(name("u"), ["structure_id", "u"]).join(name("v"), ["structure_id", "v"]).select("structure_id", F.col("n_u").alias("u"), F.col("n_v").alias("v"), *SHIFT)
    return cut_lineage(edges.canonical(renamed)), listed.select("structure_id", "node", "kind", "atoms")


def _nodes(cut: Cut) -> DataFrame:
    """Components as (structure_id, key, kind, atoms); a link's key is -1 - its component."""
    metal = cut.regions.select("structure_id", "comp_id", "is_metal")
    return atoms_of(cut).join(metal, ["structure_id", "comp_id"]).select("structure_id", F.when(F.col("is_metal"), F.col("comp_id")).otherwise(-1 - F.col("comp_id")).alias("key"), F.when(F.col("is_metal"), "metal").otherwise("organic").alias("kind"), "atoms")


def sbus(parent: Framework) -> tuple[DataFrame, DataFrame]:
    """Metal-bearing components are nodes; the others contract: to nothing, an edge, or a node of three links and more."""
    cut = parent.cut("sbu")
    links = _links(cut, _whole(cut), True)
    own = cut.regions.where("is_metal").select("structure_id", "comp_id", F.col("comp_id").alias("node"))
    return _finish(cut, edges.contracted(links).unionByName(_direct(cut, _whole(cut))), self_edges(cut, own), _nodes(cut))


def _direct(cut: Cut, anchors: DataFrame) -> DataFrame:
    """Edges of cut bonds between two different nodes."""
    side = lambda end: anchors.select("structure_id", F.col("atom_id").alias(end), F.col("node").alias(f"n_{end}"), *(F.col(f"o{x}").alias(f"{end}{x}") for x in "xyz"))
    met = cut.cuts.select("structure_id", "i", "j", *SHIFT).distinct().join(side("i"), ["structure_id", "i"]).join(side("j"), ["structure_id", "j"]).where("n_i <> n_j")
    return edges.canonical(met.select("structure_id", F.col("n_i").alias("u"), F.col("n_j").alias("v"), *((F.col(f"i{x}") + F.col(f"s{x}") - F.col(f"j{x}")).cast("int").alias(f"s{x}") for x in "xyz")))


def _all_node(parent: Framework) -> tuple[DataFrame, DataFrame]:
    """(edges by key, nodes): a finite cluster is a node; in a rod every metal is one, and every other atom that a cut names."""
    cut = parent.cut("sbu")
    metal = cut.regions.where("is_metal").select("structure_id", "comp_id", "rank")
    inside = cut.members.join(metal, ["structure_id", "comp_id"])
    cut_atoms = cut.cuts.select("structure_id", F.explode(F.array("i", "j")).alias("atom_id")).distinct().withColumn("is_cut", F.lit(True))
    rods = inside.where("rank > 0").join(cut_atoms, ["structure_id", "atom_id"], "left").withColumn("node", F.col("metal") | F.coalesce("is_cut", F.lit(False)))
    rod_nodes = rods.where("node").select("structure_id", "atom_id", (ROD + F.col("atom_id")).alias("node"), *(F.lit(0).alias(f"o{x}") for x in "xyz"), F.col("lattice"))
    anchors = inside.where("rank = 0").select("structure_id", "atom_id", F.col("comp_id").alias("node"), *(F.col(f"i{x}").alias(f"o{x}") for x in "xyz"), "lattice").unionByName(rod_nodes)
    rest = rods.where("NOT node").select("structure_id", F.col("atom_id").alias("i"))
    ends = cut.kept.select("structure_id", "i", "j", *SHIFT).join(rest, ["structure_id", "i"]).join(rod_nodes.select("structure_id", F.col("atom_id").alias("j"), "node"), ["structure_id", "j"])
    a = ends.groupBy("structure_id", "i").agg(F.array_sort(F.collect_set(F.struct("node", *SHIFT))).alias("e"))
    pairs = a.select("structure_id", "e", F.posexplode("e").alias("k", "x")).select("structure_id", "k", "x", F.posexplode("e").alias("m", "y")).where("k < m")
    inner = edges.canonical(pairs.select("structure_id", F.col("x.node").alias("u"), F.col("y.node").alias("v"), *((F.col(f"y.{s}") - F.col(f"x.{s}")).alias(s) for s in SHIFT)))
    linked = edges.contracted(_links(cut, anchors, False))
    whole = atoms_of(cut).join(metal.where("rank = 0"), ["structure_id", "comp_id"]).select("structure_id", F.col("comp_id").alias("key"), F.lit("metal").alias("kind"), "atoms")
    single = rods.where("node").select("structure_id", (ROD + F.col("atom_id")).alias("key"), F.when(F.col("metal"), "metal").otherwise("organic").alias("kind"), F.array("atom_id").alias("atoms"))
    links = _nodes(cut).where("key < 0")
    return _finish(cut, linked.unionByName(inner), _direct(cut, anchors), whole.unionByName(single).unionByName(links))


#: Keys of rod atoms come after all components'.
ROD = 1 << 29


def all_node(parent: Framework) -> tuple[DataFrame, DataFrame]:
    return _all_node(parent)


def single_node(parent: Framework) -> tuple[DataFrame, DataFrame]:
    """``all_node`` with organic nodes that are linked to each other merged, unless the merged group would close on itself in another cell."""
    found, nodes = _all_node(parent)
    kinds = nodes.select("structure_id", "node", "kind")
    side = lambda end: kinds.select("structure_id", F.col("node").alias(end), (F.col("kind") == "organic").alias(f"organic_{end}"))
    both = found.join(side("u"), ["structure_id", "u"]).join(side("v"), ["structure_id", "v"])
    inner = edges.both_ways(both.where("organic_u AND organic_v").select("structure_id", F.col("u").alias("i"), F.col("v").alias("j"), *SHIFT), "i", "j")
    organic = kinds.where("kind = 'organic'").select("structure_id", F.col("node").alias("atom_id"))
    merged = cut_lineage(components.unwrapped(organic, inner)).select("structure_id", F.col("atom_id").alias("node"), "comp_id", "ix", "iy", "iz", F.size("lattice").alias("rank"))
    place = kinds.join(merged, ["structure_id", "node"], "left").select(
        "structure_id", "node", "kind", F.when(F.col("rank") == 0, F.col("comp_id")).otherwise(F.col("node")).alias("group"), *(F.when(F.col("rank") == 0, F.col(f"i{x}")).otherwise(0).alias(f"i{x}") for x in "xyz")
    )
    place = cut_lineage(place)
    groups = numbered(place.select("structure_id", "kind", "group").distinct(), [F.col("kind") != "metal", "group"])
    place = place.join(groups.select("structure_id", "kind", "group", F.col("node").alias("number")), ["structure_id", "kind", "group"])
    end = lambda e: place.select("structure_id", F.col("node").alias(e), F.col("number").alias(f"g_{e}"), *(F.col(f"i{x}").alias(f"{e}{x}") for x in "xyz"))
    moved = found.join(end("u"), ["structure_id", "u"]).join(end("v"), ["structure_id", "v"])
    rows = moved.select("structure_id", F.col("g_u").alias("u"), F.col("g_v").alias("v"), *((F.col(f"s{x}") + F.col(f"u{x}") - F.col(f"v{x}")).cast("int").alias(f"s{x}") for x in "xyz"))
    listed = nodes.join(place.select("structure_id", "node", "number"), ["structure_id", "node"]).groupBy("structure_id", F.col("number").alias("node"), "kind").agg(F.array_sort(F.flatten(F.collect_list("atoms"))).alias("atoms"))
    return edges.canonical(rows), listed


def ligand_cluster(parent: Framework, collapse_ditopic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clusters and ligands are nodes, joined by their contacts; ligands of one contact go. Optionally ligands of two become edges."""
    cut, met = parent.cut("ligand_cluster"), parent.incidences
    many = met.groupBy("structure_id", "ligand").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    kept = met.join(many, ["structure_id", "ligand"], "left_semi")
    ends = kept.select("structure_id", F.explode(F.array(F.struct(F.lit(0).alias("late"), F.col("cluster").alias("comp_id")), F.struct(F.lit(1).alias("late"), F.col("ligand").alias("comp_id")))).alias("e")).select("structure_id", "e.*").distinct()
    listed = cut_lineage(numbered(ends, ["late", "comp_id"]))
    name = lambda c, end, late: listed.where(F.col("late") == late).select("structure_id", F.col("comp_id").alias(c), F.col("node").alias(end))
    rows = kept.join(name("cluster", "u", 0), ["structure_id", "cluster"]).join(name("ligand", "v", 1), ["structure_id", "ligand"]).select("structure_id", "u", "v", *SHIFT)
    found = cut_lineage(edges.canonical(rows.unionByName(self_edges(cut, listed.select("structure_id", "comp_id", "node")))))
    nodes = listed.join(atoms_of(cut), ["structure_id", "comp_id"]).select("structure_id", "node", F.when(F.col("late") == 0, "cluster").otherwise("ligand").alias("kind"), "atoms")
    if collapse_ditopic:
        found = edges.splice(found, nodes.where("kind = 'ligand'"))
        left = found.select("structure_id", F.explode(F.array("u", "v")).alias("node")).distinct()
        nodes = nodes.join(left, ["structure_id", "node"], "left_semi")
    return found, nodes


def regauged(found: DataFrame, centres: DataFrame) -> DataFrame:
    """Edges whose shifts fit the centres: walking the net from its least node, each further node is put into the cell
    that makes the edge to it shortest, and all shifts change with it."""
    end = lambda e: centres.select("structure_id", F.col("node").alias(e), *(F.col(f"f{x}").alias(f"{e}{x}") for x in "xyz"))
    met = found.join(end("u"), ["structure_id", "u"]).join(end("v"), ["structure_id", "v"])
    short = met.select("structure_id", F.col("u").alias("i"), F.col("v").alias("j"), *SHIFT, *((-F.rint(F.col(f"v{x}") - F.col(f"u{x}"))).cast("int").alias(f"n{x}") for x in "xyz"))
    offset = short.select("structure_id", "i", "j", *((F.col(f"n{x}") - F.col(f"s{x}")).alias(f"s{x}") for x in "xyz")).where("i <> j")
    nodes = centres.select("structure_id", F.col("node").alias("atom_id"))
    moved = components.unwrapped(nodes, edges.both_ways(offset, "i", "j").distinct())
    gauge = lambda e: moved.select("structure_id", F.col("atom_id").alias(e), *(F.col(f"i{x}").alias(f"g_{e}{x}") for x in "xyz"))
    rows = found.join(gauge("u"), ["structure_id", "u"]).join(gauge("v"), ["structure_id", "v"])
    return rows.select("structure_id", "u", "v", *((F.col(f"s{x}") + F.col(f"g_v{x}") - F.col(f"g_u{x}")).cast("int").alias(f"s{x}") for x in "xyz"))


def drawn(found: DataFrame, nodes: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node centres wrapped into the cell, and edges with their shifts in the gauge of these centres.

    A centre is the mean of the node's atoms, each by its nearest image to the first. The
    net's shifts are relative to its nodes' own images, so they equal the drawn ones up to
    one whole shift for each node; ``regauged`` brings them to the centres.
    """
    rows = nodes.select("structure_id", "node", "kind", F.explode("atoms").alias("atom_id"), F.col("atoms")[0].alias("first"))
    place = atoms.select("structure_id", "atom_id", "fx", "fy", "fz")
    own = rows.join(place, ["structure_id", "atom_id"]).join(place.select("structure_id", F.col("atom_id").alias("first"), *(F.col(f"f{x}").alias(f"o{x}") for x in "xyz")), ["structure_id", "first"])
    near = [F.avg(F.col(f"f{x}") - F.col(f"o{x}") - F.rint(F.col(f"f{x}") - F.col(f"o{x}"))).alias(f"d{x}") for x in "xyz"]
    centres = own.groupBy("structure_id", "node", "kind").agg(*near, *(F.min(f"o{x}").alias(f"o{x}") for x in "xyz"))
    wrapped = centres.select("structure_id", "node", "kind", *((F.col(f"o{x}") + F.col(f"d{x}") - F.floor(F.col(f"o{x}") + F.col(f"d{x}"))).alias(f"f{x}") for x in "xyz"))
    held = cut_lineage(wrapped)
    return held, regauged(found, held)


METHODS = {"sbus": sbus, "all_node": all_node, "single_node": single_node, "ligand_cluster": ligand_cluster}


def net_text(found: DataFrame) -> DataFrame:
    """(structure_id, cgd): nodes from 1, an edge on each line with its shift."""
    line = F.concat_ws(" ", F.col("u") + 1, F.col("v") + 1, *SHIFT)
    rows = found.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", *SHIFT, line.alias("line")))).alias("e"))
    return rows.select("structure_id", F.concat(F.lit("PERIODIC_GRAPH\n  ID "), "structure_id", F.lit("\n  EDGES\n    "), F.array_join(F.transform("e", lambda e: e["line"]), "\n    "), F.lit("\nEND\n")).alias("cgd"))


def net_edges(texts: DataFrame) -> DataFrame:
    """Edges of (structure_id, text) net files."""
    lines = texts.select("structure_id", F.explode(F.split("text", "\n")).alias("line")).select("structure_id", "line", F.regexp_extract_all("line", F.lit(r"(-?\d+)"), F.lit(1)).alias("p")).where((F.size("p") == 5) & F.col("line").rlike(r"^[\s\d-]+$"))
    return edges.canonical(lines.select("structure_id", (F.col("p")[0].cast("int") - 1).alias("u"), (F.col("p")[1].cast("int") - 1).alias("v"), *(F.col("p")[k + 2].cast("int").alias(s) for k, s in enumerate(SHIFT))))


def replicas(centres: DataFrame, found: DataFrame, cells: tuple[int, int, int] = (1, 1, 1)) -> tuple[DataFrame, DataFrame]:
    """Markers and line segments, in fractional coordinates, of a net drawn over so many cells: (structure_id, node, kind, fx, fy, fz) and both ends of each edge."""
    cell = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(f"c{x}") for n, x in zip(cells, "xyz", strict=True)]

    def spread(rows: DataFrame) -> DataFrame:
        for one in cell:
            rows = rows.select("*", one)
        return rows

    markers = spread(centres).select("structure_id", "node", "kind", *((F.col(f"f{x}") + F.col(f"c{x}")).alias(f"f{x}") for x in "xyz"))
    end = lambda e: centres.select("structure_id", F.col("node").alias(e), *(F.col(f"f{x}").alias(f"{e}{x}") for x in "xyz"))
    lines = spread(found.join(end("u"), ["structure_id", "u"]).join(end("v"), ["structure_id", "v"]))
    ends = [(F.col(f"u{x}") + F.col(f"c{x}")).alias(f"from_{x}") for x in "xyz"] + [(F.col(f"v{x}") + F.col(f"s{x}") + F.col(f"c{x}")).alias(f"to_{x}") for x in "xyz"]
    return markers, lines.select("structure_id", "u", "v", *ends)
