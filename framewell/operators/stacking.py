"""Offsets between stacked layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(members: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, i, j, dx, dy, dz): a row for each pair of components with the distances of their centres along each axis, to two decimals.

    Layers are numbered from 1 by their least atom. The pairs are all (i, j) with i before the last, j after the first, i not j;
    they are joined and never gathered, so a structure may have any number of layers.
    """
    own = members.join(atoms.select("structure_id", "atom_id", "x", "y", "z").hint("merge"), ["structure_id", "atom_id"])
    centres = own.groupBy("structure_id", "comp_id").agg(*(F.avg(c).alias(c) for c in "xyz"))
    whole = Window.partitionBy("structure_id")
    numbered = centres.select("structure_id", F.row_number().over(whole.orderBy("comp_id")).alias("k"), F.count("*").over(whole).alias("n"), *"xyz")
    a = numbered.where("k < n").select("structure_id", F.col("k").alias("i"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = numbered.where("k > 1").select("structure_id", F.col("k").alias("j"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    met = a.join(b.hint("merge"), "structure_id").where("i <> j")
    return met.select("structure_id", "i", "j", *(_hundredths(F.abs(F.col(f"a{c}") - F.col(f"b{c}"))).alias(f"d{c}") for c in "xyz"))


def _hundredths(x: Column) -> Column:
    """``bround(x, 2)``; away from halves and below 10^12 the nearest hundredth is the same number, without decimals being made."""
    near = F.rint(x * 100)
    return F.when((F.abs(x * 100 - near) < 0.499) & (x < 1e12), near / 100).otherwise(F.bround(x, 2))


def layers(members: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, layers, lateral_offsets, interlayer_heights): the ``pairs`` of each structure as lists. A structure of one layer has no row."""
    rows = pairs(members, atoms).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "dx", "dy", "dz"))).alias("p"))
    return rows.select("structure_id", F.transform("p", lambda p: F.array(p["i"], p["j"])).alias("layers"), F.transform("p", lambda p: F.array(p["dx"], p["dy"])).alias("lateral_offsets"), F.transform("p", lambda p: p["dz"]).alias("interlayer_heights"))
