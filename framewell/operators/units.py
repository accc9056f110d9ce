"""Guests, building units and their types, open metal sites."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions import elements
from framewell.operators import edges, groups
from framewell.session import cut_lineage

if TYPE_CHECKING:
    from framewell.plans.framework import Cut

KEY = ["structure_id"]


def stays_linked(lattice: Column) -> Column:
    """Axes (0, 1, 2) along which a doubled cell leaves a component connected: some lattice vector is odd there."""
    odd = [F.exists(lattice, _odd(x)) for x in "xyz"]
    return F.array_compact(F.array(*(F.when(o, F.lit(k)) for k, o in enumerate(odd))))


def _odd(axis: str):
    return lambda v: F.abs(v[axis]) % 2 == 1


def framework_atoms(atoms: DataFrame, members: DataFrame) -> DataFrame:
    """(structure_id, atom_id) of what stays when guests go: the components that stay linked along some axis, else the heaviest one."""
    own = members.join(atoms.select("structure_id", "atom_id", F.coalesce(elements.mass(F.col("element")), F.lit(0.0)).alias("mass")), ["structure_id", "atom_id"])
    parts = own.groupBy("structure_id", "comp_id").agg(F.sum(F.round(F.col("mass") * 10000).cast("long")).alias("mass"), F.any_value(F.size(stays_linked(F.col("lattice"))) > 0).alias("linked"))
    heaviest = groups.largest(parts.select("structure_id", "comp_id", "mass"), F.col("mass"), "comp_id").select("structure_id", F.col("comp_id").alias("heaviest"))
    some = parts.groupBy("structure_id").agg(F.bool_or("linked").alias("any"))
    kept = parts.join(heaviest, "structure_id").join(some, "structure_id").where(F.when(F.col("any"), F.col("linked")).otherwise(F.col("comp_id") == F.col("heaviest")))
    return own.join(kept.select("structure_id", "comp_id"), ["structure_id", "comp_id"], "left_semi").select("structure_id", "atom_id")


def inner(members: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, comp_id, atom_id, element, metal, axes, and counts of neighbours) with neighbours within the component only.

    The joins are merges whatever sizes Spark supposes: it takes rows that come from lists to be as few as the lists, and would broadcast them.
    """
    kinds = members.select("structure_id", "atom_id", "comp_id", "element", elements.is_metal(F.col("element")).alias("metal"), F.size(stays_linked(F.col("lattice"))).alias("axes"))
    pairs = bonds.where("i <> j").select("structure_id", "i", "j").distinct()
    other = kinds.select("structure_id", F.col("atom_id").alias("j"), "comp_id", F.col("element").alias("e"), F.col("metal").alias("m"))
    met = pairs.join(other.hint("merge"), ["structure_id", "j"])
    near = met.groupBy("structure_id", "comp_id", F.col("i").alias("atom_id")).agg(F.count_if("m").alias("n_m"), F.count_if(F.col("e") == "O").alias("n_o"), F.count_if(F.col("e") == "C").alias("n_c"), F.count("*").alias("degree"))
    return kinds.join(near.hint("merge"), ["structure_id", "comp_id", "atom_id"], "left").fillna(0, ["n_m", "n_o", "n_c", "degree"])


def unit_types(members: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, comp_id, sbu_type): the first type whose pattern a component has."""
    own = inner(members, bonds)
    seen = own.groupBy("structure_id", "comp_id").agg(
        F.any_value("axes").alias("axes"),
        F.count_if("metal").alias("metals"),
        F.bool_or((F.col("n_m") == 1) & (F.col("n_o") == 4) & F.col("degree").isin(5, 6)).alias("wheel"),
        F.bool_or(F.col("metal") & (F.col("n_o") == 5)).alias("wet"),
        F.bool_or((F.col("n_m") == 4) & F.col("n_o").isin(6, 8) & F.col("degree").isin(10, 12)).alias("uio"),
        F.bool_or((F.col("element") == "O") & (F.col("degree") == 4) & (F.col("n_m") == 4)).alias("irmof"),
        F.bool_or(F.col("metal") & (F.col("n_o") == 8)).alias("eight"),
        F.bool_or((F.col("degree") >= 10) & (F.col("n_c") >= 10)).alias("sandwich"),
    )
    kind = (
        F.when(F.col("axes") == 1, "rodlike").when(F.col("wheel"), "paddlewheel").when(F.col("wet") & (F.col("metals") == 2), "paddlewheel_with_water").when(F.col("uio"), "UIO66_sbu")
        .when(F.col("eight") & (F.col("metals") == 1), "MOF32_sbu").when(F.col("irmof"), "IRMOF_sbu").when(F.col("sandwich"), "ferrocenelike").otherwise("still checking!")
    )
    return seen.select("structure_id", "comp_id", kind.alias("sbu_type"))


def fragment_hashes(members: DataFrame, bonds: DataFrame, rounds: int = 4) -> DataFrame:
    """(structure_id, comp_id, fragment_hash): a graph identifier from refined colours of a component's atoms. It is no chemical name."""
    colours = members.select("structure_id", "comp_id", "atom_id", F.sha2("element", 256).alias("colour"))
    pairs = bonds.where("i <> j").select("structure_id", "i", "j").distinct()
    inside = pairs.join(colours.select("structure_id", F.col("atom_id").alias("i"), "comp_id"), ["structure_id", "i"]).join(colours.select("structure_id", F.col("atom_id").alias("j"), F.col("comp_id").alias("other")), ["structure_id", "j"]).where("comp_id = other").select("structure_id", "i", "j")
    for _ in range(rounds):
        told = inside.join(colours.select("structure_id", F.col("atom_id").alias("j"), F.col("colour").alias("near")), ["structure_id", "j"]).groupBy("structure_id", F.col("i").alias("atom_id")).agg(F.array_join(F.array_sort(F.collect_list("near")), ",").alias("told"))
        colours = colours.join(told, ["structure_id", "atom_id"], "left").select("structure_id", "comp_id", "atom_id", F.sha2(F.concat_ws("|", "colour", F.coalesce("told", F.lit(""))), 256).alias("colour"))
        colours = cut_lineage(colours)
    return colours.groupBy("structure_id", "comp_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("colour")), ","), 256).alias("fragment_hash"))


def building_units(cut: Cut, marks: DataFrame, bonds: DataFrame) -> DataFrame:
    """A row for each region: its first component with kind, formula, type, points of extension, atoms, all member components.

    Points of extension count every time that a cut names an atom of the component, so an atom that is cut twice counts twice.
    """
    members, regions = cut.members, cut.regions
    first = regions.where("comp_id = region_id").select("structure_id", "comp_id", "is_metal", "rank")
    every = regions.groupBy("structure_id", "region_id").agg(F.array_sort(F.collect_list("comp_id")).alias("members")).withColumnRenamed("region_id", "comp_id")
    once = cut.cuts.select("structure_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    ends = once.select("structure_id", F.explode(F.array("i", "j")).alias("atom_id")).join(members.select("structure_id", "atom_id", "comp_id"), ["structure_id", "atom_id"])
    points = ends.groupBy("structure_id", "comp_id").agg(F.count("*").alias("n_points_of_extension"), F.array_sort(F.collect_list("atom_id")).alias("points_of_extension"))
    atoms = members.groupBy("structure_id", "comp_id").agg(F.array_sort(F.collect_list("atom_id")).alias("atom_ids"))
    named = groups.formula(members, ["structure_id", "comp_id"]).drop("element_counts")
    kinds, hashes = unit_types(members, cut.kept), cut_lineage(fragment_hashes(members, cut.kept))
    by = ["structure_id", "comp_id"]
    rows = first.join(every, by).join(atoms, by).join(named, by).join(kinds, by).join(hashes, by).join(points, by, "left")
    return rows.select(
        "structure_id", F.lit(cut.scheme).alias("scheme"), F.col("comp_id").alias("unit_id"), F.when(F.col("is_metal"), "metal").otherwise("organic").alias("kind"), "formula",
        F.when(F.col("is_metal"), F.array("sbu_type")).otherwise(F.array().cast("array<string>")).alias("sbu_type"), F.coalesce("n_points_of_extension", F.lit(0)).alias("n_points_of_extension"),
        F.coalesce("points_of_extension", F.array().cast("array<int>")).alias("points_of_extension"), "atom_ids", "members", "rank", "fragment_hash",
    )


def records(found: DataFrame) -> DataFrame:
    """One row for each structure: lists over its units in order, and counts by kind."""
    rows = found.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "kind", "formula", "sbu_type", "n_points_of_extension", "fragment_hash"))).alias("u"))
    out = [F.col("structure_id")]
    for kind, name in (("metal", "sbu"), ("organic", "linker")):
        own = F.filter("u", _kind(kind))
        out += [F.transform(own, lambda x: x["formula"]).alias(f"{name}_formula"), F.transform(own, lambda x: x["fragment_hash"]).alias(f"{name}_hash"), F.transform(own, lambda x: x["n_points_of_extension"]).alias(f"n_{name}_point_of_extension"), F.size(own).alias(f"n_{kind}_sbus")]
    out.append(F.flatten(F.transform("u", lambda x: x["sbu_type"])).alias("sbu_type"))
    return rows.select(*out)


def _kind(kind: str):
    return lambda x: x["kind"] == kind


#: A metal is open if some direction is at least so many degrees from all of its bonds.
OPEN_ANGLE = 80.0


def widest(bonds: np.ndarray) -> float:
    """The largest angle (degrees) to the nearest bond that a direction has; 180 without bonds. bonds: unit vectors.

    Directions tried: against the bonds' sum and each bond, and across each pair of bonds.
    """
    if not len(bonds):
        return 180.0
    tried = [-bonds.sum(axis=0), *(-bonds)]
    for i in range(len(bonds)):
        for j in range(i):
            across = np.cross(bonds[i], bonds[j])
            tried += [across, -across, -(bonds[i] + bonds[j])]
    ways = np.array([t / n for t in tried if (n := np.linalg.norm(t)) > 1e-6])
    return float(np.degrees(np.arccos(np.clip(ways @ bonds.T, -1, 1))).min(axis=1).max()) if len(ways) else 180.0


def sites(marks: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, atom_id, metal, linkers, is_open) of each metal atom."""
    metals = marks.where("metal").select("structure_id", "atom_id", F.col("element").alias("metal"), F.array_sort(F.transform(F.filter("near", lambda x: ~x["metal"]), lambda x: x["element"])).alias("linkers"))
    at = atoms.select("structure_id", "atom_id", "fx", "fy", "fz", "cell")
    far = atoms.select("structure_id", F.col("atom_id").alias("j"), *(F.col(f"f{x}").alias(f"h{x}") for x in "xyz"))
    own = metals.join(at, ["structure_id", "atom_id"]).join(bonds.withColumnRenamed("i", "atom_id"), ["structure_id", "atom_id"], "left").join(far, ["structure_id", "j"], "left")
    gap = [F.col(f"h{x}") + F.col(f"s{x}") - F.col(f"f{x}") for x in "xyz"]
    way = F.array(*(gap[0] * F.col("cell")[0][k] + gap[1] * F.col("cell")[1][k] + gap[2] * F.col("cell")[2][k] for k in range(3)))
    rows = own.groupBy("structure_id", "atom_id", "metal", "linkers").agg(F.collect_list(F.when(F.col("j").isNotNull(), way)).alias("ways"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = []
            for ways in batch.column(4).to_pylist():
                v = np.array(ways, float).reshape(-1, 3)
                opened.append(widest(v / np.linalg.norm(v, axis=1, keepdims=True)) >= OPEN_ANGLE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(opened, pa.bool_())], names=["structure_id", "atom_id", "metal", "linkers", "is_open"])

    return rows.mapInArrow(run, "structure_id string, atom_id int, metal string, linkers array<string>, is_open boolean")


def open_metals(marks: DataFrame, atoms: DataFrame, bonds: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Open metal sites of each structure with general facts; the criterion is this module's own, so results are marked approximate."""
    place = atoms.select("structure_id", "atom_id", "cell", "element")
    found = sites(marks, atoms, bonds)
    info = found.select("structure_id", F.struct("metal", F.size("linkers").alias("coordination_number"), "is_open", F.col("linkers").alias("environment")).alias("s")).distinct().groupBy("structure_id").agg(F.array_sort(F.collect_list("s")).alias("metal_info"))
    a, b, c = (F.col("cell")[k] for k in range(3))
    volume = F.abs(a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0]))
    facts = place.groupBy("structure_id").agg(F.any_value(volume).alias("uc_volume"), F.sum(elements.mass(F.col("element"))).alias("mass"))
    rows = facts.join(info, "structure_id", "left").join(overlaps, "structure_id", "left")
    opened = F.array_distinct(F.transform(F.filter("metal_info", lambda m: m["is_open"]), lambda m: m["metal"]))
    none = F.array().cast("array<string>")
    return rows.select(
        "structure_id", (~F.col("clear")).alias("has_overlapping_atoms"), F.coalesce(F.array_distinct(F.transform("metal_info", lambda m: m["metal"])), none).alias("metals"), F.coalesce(F.size(opened) > 0, F.lit(False)).alias("has_oms"),
        (F.col("mass") * 1.66053906660 / F.col("uc_volume")).alias("density"), "uc_volume", (~F.col("clear")).alias("error_in_systems"), "metal_info", F.coalesce(opened, none).alias("open_metals"), F.lit(True).alias("approximate"),
    )


def environment(marks: DataFrame, atoms_of: str = "first") -> DataFrame:
    """(structure_id, element, neighbours, degree) of the first (or last) metal atom of each element that is in no porphyrin."""
    own = marks.where(F.col("metal") & ~F.array_contains("owner", "porphyrin"))
    pick = F.min_by if atoms_of == "first" else F.max_by
    value = F.struct(F.transform("near", lambda x: x["element"]).alias("neighbours"), F.size("near").alias("degree"))
    return own.groupBy("structure_id", "element").agg(pick(value, F.col("atom_id")).alias("v")).select("structure_id", "element", "v.*")


def wrapped(atoms: DataFrame, members: DataFrame) -> DataFrame:
    """Atoms with the coordinates they have when each component is in one piece: its first atom within the cell, the rest by their images."""
    own = atoms.join(members.select("structure_id", "atom_id", "comp_id", "ix", "iy", "iz"), ["structure_id", "atom_id"])
    first = own.where("atom_id = comp_id").select("structure_id", "comp_id", *(F.floor(f"f{x}").alias(f"o{x}") for x in "xyz"))
    met = own.join(first, ["structure_id", "comp_id"])
    for x in "xyz":
        met = met.withColumn(f"f{x}", F.col(f"f{x}") + F.col(f"i{x}") - F.col(f"o{x}"))
    for k, x in enumerate("xyz"):
        met = met.withColumn(x, F.col("fx") * F.col("cell")[0][k] + F.col("fy") * F.col("cell")[1][k] + F.col("fz") * F.col("cell")[2][k])
    return met.drop("ix", "iy", "iz", "ox", "oy", "oz")


def separated(cut: Cut) -> DataFrame:
    """Edges between the components of a cut, each once."""
    return edges.between_components(cut.cuts, cut.members)


def dummies(cut: Cut, atoms: DataFrame) -> DataFrame:
    """(structure_id, comp_id, atom_id, x, y, z): for each point of extension of a component a dummy where the atom beyond the cut is."""
    images = cut.members.select("structure_id", "atom_id", "comp_id", *(f"i{x}" for x in "xyz"))
    once = cut.cuts.select("structure_id", "i", "j", *edges.SHIFT).distinct()
    both = edges.both_ways(once, "i", "j").distinct()
    own = both.join(images.withColumnRenamed("atom_id", "i"), ["structure_id", "i"])
    far = atoms.select("structure_id", F.col("atom_id").alias("j"), "fx", "fy", "fz", "cell")
    met = own.join(far, ["structure_id", "j"])
    place = [F.col(f"f{x}") + F.col(f"s{x}") + F.col(f"i{x}") for x in "xyz"]
    xyz = [place[0] * F.col("cell")[0][k] + place[1] * F.col("cell")[1][k] + place[2] * F.col("cell")[2][k] for k in range(3)]
    return met.select("structure_id", "comp_id", F.col("i").alias("atom_id"), *(p.alias(x) for p, x in zip(xyz, "xyz", strict=True)))


def coordination_sphere(spheres: Column, metal: Column, number: Column) -> Column:
    """The first of arrays of elements that holds the metal and so many more; null if none does."""
    return F.get(F.filter(spheres, lambda s: (F.size(s) == number + 1) & F.array_contains(s, metal)), F.lit(0))
