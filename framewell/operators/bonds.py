"""Bond perception: a periodic radius search in blocks of the cell.

A pair is bonded if it is nearer than the sum of its covalent radii and a
tolerance. Wrapped fractional coordinates fall into blocks, at least as wide as
the structure's largest cutoff and many only where a structure has many atoms.
A block gets its own atoms and the images within the cutoff of its faces: rows
with the block's name, so that one shuffle brings them together. Within blocks
atoms are sorted by columns of half a cutoff and their height, and a pair is
measured only if it lies in the few ranges around an atom.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions import elements

#: Added to the sum of two radii: the neighbour list's skin of 0.3 for each atom.
TOLERANCE = 0.6
#: Atoms of a structure for each block, about; rows that are taken together; atoms and pairs that are measured at once.
BLOCK, ROWS, ATOMS, PAIRS = 8000, 50_000, 10_000, 500_000


def heights(cell: Column) -> list[Column]:
    """Distance between opposite faces along each axis: volume over the area of the face."""
    def cross(a: Column, b: Column) -> list[Column]:
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    normals = [cross(cell[(k + 1) % 3], cell[(k + 2) % 3]) for k in range(3)]
    volume = F.abs(sum((cell[0][k] * normals[0][k] for k in (1, 2)), cell[0][0] * normals[0][0]))
    return [volume / F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) for n in normals]


def perceive(atoms: DataFrame, tolerance: float = TOLERANCE, most: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """bonds(structure_id, i, j, sx, sy, sz, dist), each both ways; atoms of unknown elements have none.

    With ``most`` only those nearer than that are looked for. Each column of atoms that ``carry`` names follows twice, as ``name_i`` and ``name_j``.
    """
    own = atoms.withColumn("r", elements.radius(F.col("element"))).where("r IS NOT NULL AND cell IS NOT NULL")
    for x in "xyz":
        own = own.where(F.abs(f"f{x}") < float("inf"))
    widest = 2 * F.max("r") + tolerance
    reach = own.groupBy("structure_id").agg((widest if most is None else F.least(widest, F.lit(max(most, 0.1)))).alias("reach"), F.max("r").alias("large"), F.ceil(F.cbrt(F.count("*") / BLOCK)).alias("blocks"))
    own = own.join(reach, "structure_id")
    high = heights(F.col("cell"))
    for k, x in enumerate("xyz"):
        periodic = F.col("pbc")[k]
        own = own.withColumn(f"w{x}", F.when(periodic, F.floor(f"f{x}")).otherwise(0).cast("int"))
        own = own.withColumn(f"g{x}", F.col(f"f{x}") - F.col(f"w{x}"))
        own = own.withColumn(f"n{x}", F.when(periodic, F.greatest(F.least(F.floor(high[k] / F.col("reach")), "blocks"), F.lit(1))).otherwise(1).cast("int"))
        own = own.withColumn(f"m{x}", F.when(periodic, F.col("reach") / high[k] * (1 + 1e-6)).otherwise(0.0))
        own = own.withColumn(f"b{x}", F.when(periodic, F.least(F.floor(F.col(f"g{x}") * F.col(f"n{x}")), F.col(f"n{x}") - 1)).otherwise(0).cast("int"))
    for k, x in enumerate("xyz"):
        edge = lambda e, x=x: F.floor((F.col(f"g{x}") + e * F.col(f"m{x}")) * F.col(f"n{x}")).cast("int")
        none = F.array(F.lit(0))
        own = own.withColumn(f"t{x}", F.explode(F.when(F.col("pbc")[k], F.sequence(F.least(edge(-1), f"b{x}"), F.greatest(edge(1), f"b{x}"))).otherwise(none)))
        # an image lies (target block - own block) away: an atom of block b, seen in target t, is in block c's image s
        own = own.withColumn(f"c{x}", F.pmod(f"t{x}", f"n{x}").cast("long")).withColumn(f"s{x}", F.floor(F.col(f"t{x}") / F.col(f"n{x}")).cast("int"))
    block = ((F.col("cx") * F.col("ny") + F.col("cy")) * F.col("nz") + F.col("cz")).alias("block")
    home = (F.col("tx") == F.col("bx")) & (F.col("ty") == F.col("by")) & (F.col("tz") == F.col("bz"))
    rows = own.select("structure_id", block, F.when(home, F.flatten("cell")).alias("cell"), "reach", "large", "atom_id", "r", *(f"{p}{x}" for p in "gsw" for x in "xyz"), *(F.col(c).alias(f"own_{c}") for c in carry))
    kinds = dict(atoms.dtypes)
    schema = f"structure_id {kinds['structure_id']}, i {kinds['atom_id']}, j {kinds['atom_id']}, sx int, sy int, sz int, dist double" + "".join(f", {c}_{end} {kinds[c]}" for c in carry for end in "ij")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield from _pairs(table, tolerance, most, carry)

    return rows.repartition("structure_id", "block").sortWithinPartitions("structure_id", "block").mapInArrow(run, schema)


def _starts(table: pa.Table) -> np.ndarray:
    """Where blocks start but the first."""
    differ = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (table["structure_id"].combine_chunks(), table["block"].combine_chunks())]
    return np.flatnonzero(pc.or_(*differ).to_numpy(zero_copy_only=False)) + 1


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of whole blocks."""
    held, rows, least = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table)
            end = int(starts[-1]) if len(starts) else 0
            if end:
                yield table.slice(0, end).combine_chunks()
            held, rows = table.slice(end).to_batches(), rows - end
            least = max(ROWS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(table: pa.Table, tolerance: float, most: float | None, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Bonds of the atoms of each block (rows with a cell) with all of its rows."""
    starts = np.concatenate([[0], _starts(table)]) if table.num_rows > 1 else np.zeros(1, int)
    group = np.zeros(table.num_rows, int)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    column = lambda name: table[name].combine_chunks().to_numpy(zero_copy_only=False)
    is_home = pc.is_valid(table["cell"]).combine_chunks().to_numpy(zero_copy_only=False)
    home = np.flatnonzero(is_home)
    if not len(home):
        return
    cells = table["cell"].combine_chunks().take(pa.array(home)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
    first = np.full(len(starts), -1)
    first[group[home[::-1]]] = np.arange(len(home))[::-1]
    # a block that has none of its own atoms has no bonds
    keep = np.flatnonzero(first[group] >= 0)
    table, group, is_home = table.take(pa.array(keep)).combine_chunks(), group[keep], is_home[keep]
    g, s, w = (np.stack([column(f"{p}{x}") for x in "xyz"]) for p in "gsw")
    seen, r, reach = g - s, column("r"), column("reach")
    place = np.einsum("kn,nkc->cn", seen, cells[first[group]])
    # columns half a cutoff wide, numbered on through the blocks; rows by column and height
    low = np.full((3, len(starts)), np.inf)
    for c in range(3):
        np.minimum.at(low[c], group, place[c])
    place -= low[:, group]
    wide = reach * (0.5 + 1e-6)
    ix, iy = (np.floor(place[c] / wide).astype(np.int64) for c in (0, 1))
    n = np.zeros((2, len(starts)), np.int64)
    for c, at in enumerate((ix, iy)):
        np.maximum.at(n[c], group, at + 5)
    base = np.concatenate([[0], np.cumsum(n[0] * n[1])[:-1]])
    number, deep = base[group] + (ix + 2) * n[1][group] + iy + 2, float(place[2].max() + 3 * reach.max() + 1)
    key = number * deep + place[2]
    order = np.argsort(key, kind="stable")
    table, key, number, group, ix, iy, r, wide, is_home = table.take(pa.array(order)), key[order], number[order], group[order], ix[order], iy[order], r[order], wide[order], is_home[order]
    place, seen, g, s, w = (a[:, order] for a in (place, seen, g, s, w))
    slack = 1e-9 + 8 * float(np.spacing(key.max() + deep))
    names, ids = table["structure_id"].combine_chunks(), column("atom_id")
    carried = [table[f"own_{c}"].combine_chunks() for c in carry]
    cut = r + column("large") + tolerance
    cut = cut if most is None else np.minimum(cut, most)
    home = np.flatnonzero(is_home)
    cells = np.stack(table["cell"].combine_chunks().take(pa.array(home)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 9), axis=1)
    same = bool((cells == cells[:, :1]).all())
    for at in range(0, len(home), ATOMS):
        own = home[at : at + ATOMS]
        lo, hi = np.zeros((2, len(own), 25), np.int64)
        for k in range(25):
            dx, dy = k // 5 - 2, k % 5 - 2
            off = [np.maximum(np.maximum((i[own] + d) * wide[own] - p[own], p[own] - (i[own] + d + 1) * wide[own]), 0) for i, d, p in ((ix, dx, place[0]), (iy, dy, place[1]))]
            left = (cut[own] + slack) ** 2 - off[0] ** 2 - off[1] ** 2
            half = np.sqrt(np.maximum(left, 0)) + slack
            there = (number[own] + dx * n[1][group[own]] + dy) * deep + place[2][own]
            lo[:, k], hi[:, k] = np.searchsorted(key, there - half), np.searchsorted(key, there + half, "right")
            hi[left < 0, k] = lo[left < 0, k]
        many = hi - lo
        ends = np.cumsum(many.sum(axis=1))
        a = 0
        while a < len(own):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            count, start = many[a:b].ravel(), lo[a:b].ravel()
            total = int(count.sum())
            j = np.arange(total) + np.repeat(start - (np.cumsum(count) - count), count)
            h = np.repeat(np.arange(at + a, at + b), many[a:b].sum(axis=1))
            i = home[h]
            gap = [seen[c][j] - g[c][i] for c in range(3)]
            way = []
            for c in range(3):
                parts = [gap[k] * (cells[3 * k + c, 0] if same else cells[3 * k + c][h]) for k in range(3) if not same or cells[3 * k + c, 0]]
                way.append(sum(parts[1:], parts[0]) if parts else np.zeros(total))
            dist = np.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])
            near = dist < r[i] + r[j] + tolerance
            if most is not None:
                near &= dist < most
            i, j, dist = i[near], j[near], dist[near]
            shift = [(w[c][i] - w[c][j] - s[c][j]).astype(np.int32) for c in range(3)]
            itself = (ids[i] == ids[j]) & (shift[0] == 0) & (shift[1] == 0) & (shift[2] == 0)
            i, j, dist, *shift = (x[~itself] for x in (i, j, dist, *shift))
            a = b
            if not len(i):
                continue
            ends_of = [pa.array(i), pa.array(j)]
            columns = [names.take(ends_of[0]), pa.array(ids[i]), pa.array(ids[j]), *map(pa.array, shift), pa.array(dist), *(c.take(e) for c in carried for e in ends_of)]
            yield pa.RecordBatch.from_arrays(columns, names=["structure_id", "i", "j", "sx", "sy", "sz", "dist", *(f"{c}_{e}" for c in carry for e in "ij")])


def overlapping(atoms: DataFrame, bonds: DataFrame, least: float = 0.9) -> DataFrame:
    """(structure_id, clear): False if a bonded pair, unless exactly one is hydrogen, is nearer than ``least``."""
    sort = atoms.select("structure_id", F.col("atom_id").alias("i"), (F.col("element") == "H").alias("h_i"))
    other = sort.withColumnsRenamed({"i": "j", "h_i": "h_j"})
    near = bonds.where("i < j").join(sort, ["structure_id", "i"]).join(other, ["structure_id", "j"]).groupBy("structure_id").agg(F.bool_or((F.col("h_i") == F.col("h_j")) & (F.col("dist") < least)).alias("near"))
    return atoms.select("structure_id").distinct().join(near, "structure_id", "left").select("structure_id", (~F.coalesce("near", F.lit(False))).alias("clear"))


def crowded(atoms: DataFrame, least: float = 0.9) -> DataFrame:
    """What ``overlapping`` tells of all bonds, from the pairs nearer than ``least`` alone: no other bond matters."""
    met = perceive(atoms.withColumn("h", F.col("element") == "H"), most=least, carry=("h",))
    near = met.where("i < j").groupBy("structure_id").agg(F.bool_or(F.col("h_i") == F.col("h_j")).alias("near"))
    return atoms.select("structure_id").distinct().join(near, "structure_id", "left").select("structure_id", (~F.coalesce("near", F.lit(False))).alias("clear"))


# How much shorter than the sum of radii a double and a triple bond is, and the tolerance of each.
SHORTER, SKIN = (0.0, 0.15, 0.30), 0.2


def orders(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, i, j, sx, sy, sz, bond_order) of covalent bonds by their length.

    The order is that of the shortest of three ranges that holds the distance; hydrogen's is at most 1.
    Bonds of a metal and hydrogen, of two alkali metals, and of a metal and an alkali metal don't count. Bonds of
    planar rings aren't set to 1.5 here; ``rings`` tells which bonds these may be.
    """
    kind = lambda end: atoms.select("structure_id", F.col("atom_id").alias(end), *(v.alias(f"{n}_{end}") for n, v in _facts().items()))
    return _ordered(bonds.join(kind("i"), ["structure_id", "i"]).join(kind("j"), ["structure_id", "j"]))


def orders_of(atoms: DataFrame) -> DataFrame:
    """What ``orders`` tells of all bonds, from those that can have an order alone: the bonds bring what is known of their ends, so nothing is joined to them."""
    return _ordered(perceive(atoms.withColumns(_facts()), SKIN, carry=tuple(_facts())))


def _facts() -> dict[str, Column]:
    e = F.col("element")
    return {"rad": elements.radius(e), "m": elements.is_metal(e), "a": elements.is_alkali(e), "h": e == "H"}


def _ordered(met: DataFrame) -> DataFrame:
    reach = F.col("rad_i") + F.col("rad_j")
    order = sum((F.when(F.col("dist") < reach - 2 * less + SKIN, 1).otherwise(0) for less in SHORTER[1:]), F.when(F.col("dist") < reach + SKIN, 1).otherwise(0))
    barred = ((F.col("m_i") & F.col("h_j")) | (F.col("h_i") & F.col("m_j")) | (F.col("m_i") & F.col("a_j")) | (F.col("a_i") & F.col("m_j")))
    capped = F.when(F.col("h_i") | F.col("h_j"), F.least(order, F.lit(1))).otherwise(order)
    return met.where(~barred).select("structure_id", "i", "j", "sx", "sy", "sz", capped.cast("double").alias("bond_order")).where("bond_order > 0")
