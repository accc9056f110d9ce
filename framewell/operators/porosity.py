"""Approximate porosity: free volume, surface and channels of a probe, and free spheres.

Each structure is measured by itself: seeded random points for volume and
surface, a voxel grid of distances to the nearest atom's surface for channels
and spheres. ``grid_A`` is the widest spacing of the grid: SPACING, or more where a
cell is so long that MOST voxels along an axis don't reach it. Results approximate exact geometry and are marked so; a structure
that can't be measured is a row of nulls, not a lost job.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.functions.elements import RADIUS

#: Spacing of voxels in angstrom, voxels along an axis at most, and what turns a covalent radius into a van der Waals one.
SPACING, MOST, SWELL = 0.5, 60, 0.8
# Names of the results.
NAMES = ("AV_Volume_fraction", "AV_A^3", "ASA_A^2", "ASA_m^2/cm^3", "Number_of_channels", "LCD_A", "lfpd_A", "PLD_A")
#: Spacing of the voxels that a structure was measured with.
GRID = "grid_A"


def clearance(points: np.ndarray, atoms: np.ndarray, radii: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Distance of fractional points to the nearest atom's surface, over the nearest images."""
    out = np.full(len(points), np.inf)
    near = np.array([[i, j, k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]) @ cell
    skewed = np.abs(np.tril(cell @ cell.T, -1)).max() > 1e-6
    for k in range(0, len(points), 2000):
        gap = points[k : k + 2000, None, :] - atoms[None]
        gap = (gap - np.rint(gap)) @ cell
        d2 = (gap**2).sum(axis=2)
        if skewed:
            for n in near:
                d2 = np.minimum(d2, ((gap + n) ** 2).sum(axis=2))
        out[k : k + 2000] = (np.sqrt(d2) - radii).min(axis=1)
    return out


def channels(free: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of free components of a periodic voxel grid that reach their own image, and the voxels of these."""
    from framewell.operators.components import walk

    shape = np.array(free.shape)
    index = np.full(free.shape, -1)
    place = np.argwhere(free)
    index[tuple(place.T)] = np.arange(len(place))
    i, j, s = [], [], []
    for axis in range(3):
        step = np.zeros(3, int)
        step[axis] = 1
        to = place + step
        shift = to // shape
        k = index[tuple((to % shape).T)]
        met = k >= 0
        i += [np.arange(len(place))[met], k[met]]
        j += [k[met], np.arange(len(place))[met]]
        s += [shift[met], -shift[met]]
    if not len(place):
        return 0, np.zeros(free.shape, bool)
    comp, _, lattices = walk(len(place), np.concatenate(i), np.concatenate(j), np.concatenate(s))
    open_ = np.array([bool(x) for x in lattices])
    through = np.zeros(free.shape, bool)
    through[tuple(place[open_[comp]].T)] = True
    return int(open_.sum()), through


def measure(elements: list[str], atoms: np.ndarray, cell: np.ndarray, probe: float, samples: int, seed: int) -> dict[str, float]:
    """The eight results of one structure."""
    random = np.random.default_rng(seed)
    radii = np.array([RADIUS.get(e, 0.7) + SWELL for e in elements])
    volume = abs(np.linalg.det(cell))
    free = clearance(random.random((samples, 3)), atoms, radii, cell) >= probe
    shape = np.clip(np.ceil(np.linalg.norm(cell, axis=1) / SPACING), 4, MOST).astype(int)
    grid = (np.stack(np.meshgrid(*(np.arange(n) for n in shape), indexing="ij"), axis=-1).reshape(-1, 3) + 0.5) / shape
    depth = clearance(grid, atoms, radii, cell).reshape(shape)
    number, through = channels(depth >= probe)
    low, high = 0.0, float(max(depth.max(), 0))
    if not channels(depth >= 0)[0]:
        high = 0.0
    for _ in range(8):
        mid = (low + high) / 2
        low, high = (mid, high) if channels(depth >= mid)[0] else (low, mid)
    widest = float(depth[channels(depth >= low)[1]].max()) if channels(depth >= low)[0] else 0.0
    share = max(1, samples // max(1, len(elements)))
    way = random.normal(size=(len(elements) * share, 3))
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    reach = np.repeat(radii + probe, share)
    shell = np.repeat(atoms, share, axis=0) + (way * (reach[:, None] + 1e-6)) @ np.linalg.inv(cell)
    bare = clearance(shell, atoms, radii, cell) >= probe
    area = float((4 * np.pi * (radii + probe) ** 2 * bare.reshape(-1, share).mean(axis=1)).sum())
    part = float(free.mean()) * bool(through.any())
    found = dict(zip(NAMES, (part, part * volume, area * bool(part), area * bool(part) / volume * 1e4, number, 2 * float(max(depth.max(), 0)), 2 * widest, 2 * low), strict=True))
    return found | {GRID: float((np.linalg.norm(cell, axis=1) / shape).max())}


def measured(atoms: DataFrame, probe: float = 1.86, samples: int = 10_000) -> DataFrame:
    """A row of the eight results for each structure, and ``approximate``."""
    rows = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", "element", "fx", "fy", "fz"))).alias("a"), F.any_value("cell").alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("structure_id", *NAMES, GRID)}
            for name, own, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found: dict = measure([a["element"] for a in own], np.array([[a["fx"], a["fy"], a["fz"]] for a in own]), np.array(cell), probe, samples, zlib.crc32(name.encode()))
                except (ValueError, np.linalg.LinAlgError):
                    found = dict.fromkeys((*NAMES, GRID))
                out["structure_id"].append(name)
                for k in (*NAMES, GRID):
                    out[k].append(found[k])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("structure_id", pa.string()), *((k, pa.int64() if k == "Number_of_channels" else pa.float64()) for k in (*NAMES, GRID))]))

    schema = "structure_id string, " + ", ".join(f"`{k}` {'long' if k == 'Number_of_channels' else 'double'}" for k in (*NAMES, GRID))
    return rows.select("structure_id", "a", "cell").mapInArrow(run, schema).withColumn("approximate", F.lit(True))
