"""Periodic edges: canonical form, cuts, contacts between components, contraction.

An edge (u, v, sx, sy, sz) says that v lies in the cell (sx, sy, sz) relative to u. ``keys`` name the
columns that tell structures apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["structure_id"]
SHIFT = ["sx", "sy", "sz"]


def flipped(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """The same edges seen from their other end."""
    ends = {u: F.col(v), v: F.col(u)} | {s: (-F.col(s)).cast("int") for s in SHIFT if s in edges.columns}
    return edges.select(*(ends.get(c, F.col(c)).alias(c) for c in edges.columns))


def both_ways(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return edges.unionByName(flipped(edges, u, v))


def canonical(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each undirected edge once: ends ascending, a self-edge with the smaller of its two shifts, none of zero shift."""
    back = [(-F.col(s)).cast("int") for s in SHIFT]
    keep = F.struct(F.col("u").alias("n"), *SHIFT) <= F.struct(F.col("v").alias("n"), *(x.alias(s) for x, s in zip(back, SHIFT, strict=True)))
    ends = [F.when(keep, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in ("uv", "vu")]
    shifts = [F.when(keep, F.col(s)).otherwise(x).cast("int").alias(s) for x, s in zip(back, SHIFT, strict=True)]
    once = edges.select(*keys, *ends, *shifts)
    nothing = (F.col("u") == F.col("v")) & (F.col("sx") == 0) & (F.col("sy") == 0) & (F.col("sz") == 0)
    return once.where(~nothing).distinct()


def cut(bonds: DataFrame, cuts: DataFrame, keys: list[str] = KEYS, u: str = "i", v: str = "j") -> DataFrame:
    """Bonds whose pair of ends is not cut, in either direction and whatever the shift."""
    pairs = both_ways(cuts.select(*keys, u, v), u, v).distinct()
    return bonds.join(pairs, [*keys, u, v], "left_anti")


def cut_alike(bonds: DataFrame, firsts: DataFrame, seconds: DataFrame, keys: list[str] = KEYS, u: str = "i", v: str = "j") -> DataFrame:
    """What ``cut`` leaves where every first and second of one kind are a cut pair, without a row for each pair; firsts, seconds: (node, kind).

    The kinds of a node go to the bonds' ends, so the work grows with bonds and nodes. The joins are merges, as no side is small.
    """
    kinds = lambda nodes, name: nodes.groupBy(*keys, "node").agg(F.collect_set("kind").alias(name))
    known = kinds(firsts, "first").join(kinds(seconds, "second").hint("merge"), [*keys, "node"], "full")
    met = bonds
    for end in (u, v):
        side = known.select(*keys, F.col("node").alias(end), F.col("first").alias(f"_first_{end}"), F.col("second").alias(f"_second_{end}"))
        met = met.join(side.hint("merge"), [*keys, end], "left")
    alike = lambda a, b: F.coalesce(F.arrays_overlap(f"_first_{a}", f"_second_{b}"), F.lit(False))
    return met.where(~(alike(u, v) | alike(v, u))).select(*bonds.columns)


def contacts(cuts: DataFrame, bonds: DataFrame, members: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cut pairs that are bonds and join a cluster's atom to a ligand's; members: (atom_id, comp_id, is_cluster)."""
    pairs = cuts.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    real = pairs.join(bonds.select(*keys, "i", "j").distinct(), [*keys, "i", "j"], "left_semi")
    for end in "ij":
        side = members.select(*keys, F.col("atom_id").alias(end), F.col("comp_id").alias(f"comp_{end}"), F.col("is_cluster").alias(f"cluster_{end}"))
        real = real.join(side, [*keys, end])
    return real.where(F.col("cluster_i") != F.col("cluster_j"))


def between_components(cuts: DataFrame, images: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Edges of components: shift = image of i - image of j + the bond's; images: (atom_id, comp_id, ix, iy, iz)."""
    found = cuts
    for end in "ij":
        side = images.select(*keys, F.col("atom_id").alias(end), F.col("comp_id").alias(f"comp_{end}"), *(F.col(f"i{x}").alias(f"{end}{x}") for x in "xyz"))
        found = found.join(side, [*keys, end])
    shifts = [(F.col(f"i{x}") - F.col(f"j{x}") + F.col(f"s{x}")).cast("int").alias(f"s{x}") for x in "xyz"]
    return canonical(found.select(*keys, F.col("comp_i").alias("u"), F.col("comp_j").alias("v"), *shifts), keys)


def reduced(edges: DataFrame, period: Column, axis: str) -> DataFrame:
    """Shifts along an axis as their remainder modulo a period; a period of 0 leaves them."""
    s = F.col(f"s{axis}")
    return edges.withColumn(f"s{axis}", F.when(period == 0, s).otherwise(s - F.floor(s / F.nullif(period, F.lit(0))) * period).cast("int"))


def usual_shift(bonds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The most frequent shift of each pair, of equally frequent ones the least."""
    counted = bonds.groupBy(*keys, "i", "j", *SHIFT).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys, "i", "j").orderBy(F.desc("n"), *SHIFT))
    return counted.withColumn("place", place).where("place = 1").drop("place", "n")


def degrees(edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How often a node is an end of an edge; a self-edge counts twice."""
    ends = F.explode(F.array("u", "v")).alias("node")
    return edges.select(*keys, ends).groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def splice(edges: DataFrame, candidates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Replace each candidate node of exactly two edges, none to itself or another candidate, by one edge; candidates: (node)."""
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("far"), *SHIFT), F.struct(F.col("v").alias("node"), F.col("u").alias("far"), *((-F.col(s)).cast("int").alias(s) for s in SHIFT)))).alias("e")).select(*keys, "e.*")
    at = ends.join(candidates.select(*keys, "node"), [*keys, "node"])
    two = at.groupBy(*keys, "node").agg(F.count("*").alias("n"), F.bool_or(F.col("far") == F.col("node")).alias("loop"), F.array_sort(F.collect_list(F.struct("far", *SHIFT))).alias("ends")).where("n = 2 AND NOT loop")
    far = two.select(*keys, "node", F.explode(F.array(F.col("ends")[0]["far"], F.col("ends")[1]["far"])).alias("far"))
    chained = far.join(two.select(*keys, F.col("node").alias("far")), [*keys, "far"], "left_semi").select(*keys, "node").distinct()
    gone = two.join(chained, [*keys, "node"], "left_anti")
    new = gone.select(*keys, F.col("ends")[0]["far"].alias("u"), F.col("ends")[1]["far"].alias("v"), *((F.col("ends")[1][s] - F.col("ends")[0][s]).cast("int").alias(s) for s in SHIFT))
    kept = edges
    for end in "uv":
        kept = kept.join(gone.select(*keys, F.col("node").alias(end)), [*keys, end], "left_anti")
    return canonical(kept.select(*keys, "u", "v", *SHIFT).unionByName(new), keys)


def contracted(incidences: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Links become edges: of a link's distinct (node, shift) pairs, one is dropped, two make an edge, more make the link a node.

    incidences: (node, link, sx, sy, sz) with the shift from node to link; a link that stays is node ``-1 - link``.
    """
    distinct = incidences.select(*keys, "node", "link", *SHIFT).distinct()
    lists = distinct.groupBy(*keys, "link").agg(F.array_sort(F.collect_list(F.struct("node", *SHIFT))).alias("ends"))
    a, b = F.col("ends")[0], F.col("ends")[1]
    pairs = lists.where(F.size("ends") == 2).select(*keys, a["node"].alias("u"), b["node"].alias("v"), *((a[s] - b[s]).cast("int").alias(s) for s in SHIFT))
    stars = lists.where(F.size("ends") > 2).select(*keys, "link", F.explode("ends").alias("e")).select(*keys, F.col("e.node").alias("u"), (-1 - F.col("link")).alias("v"), *(F.col(f"e.{s}").alias(s) for s in SHIFT))
    return canonical(pairs.unionByName(stars), keys)


def partners(pairs: DataFrame, ids: DataFrame, order: str, keys: list[str] = KEYS) -> DataFrame:
    """(id, partner): the other end of the first pair (by ``order``) that names an id at either end, null where none does. pairs: (i, j)."""
    ends = F.explode(F.array(F.struct(F.col("i").alias("id"), F.col("j").alias("other")), F.struct(F.col("j").alias("id"), F.col("i").alias("other")))).alias("e")
    first = pairs.select(*keys, F.col(order).alias("_at"), ends).groupBy(*keys, F.col("e.id").alias("id")).agg(F.min_by(F.col("e.other"), F.struct("_at", F.col("e.other"))).alias("partner"))
    return ids.select(*keys, "id").join(first, [*keys, "id"], "left")
