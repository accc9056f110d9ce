"""What must hold on large tables: no join that broadcasts rows made from lists, rows by pairs, few candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.functions import elements
from framewell.operators import bonds, edges, stacking, units


@pytest.fixture
def broadcasts(spark):
    """The session with the usual threshold and no second thoughts about plans; it is put back afterwards."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unit_types_broadcast_no_atoms(broadcasts, tmp_path):
    # a file of a few numbers, which Spark takes for a few rows however many atoms each becomes
    broadcasts.range(50).write.parquet(str(tmp_path / "t"))
    own = broadcasts.read.parquet(str(tmp_path / "t")).select(F.col("id").cast("string").alias("structure_id"), F.posexplode(F.array_repeat(F.lit("Zn"), 40)).alias("atom_id", "element"), F.lit(0).alias("comp_id"), F.array().cast("array<struct<x:int,y:int,z:int>>").alias("lattice"))
    arms = own.where("atom_id > 0").select("structure_id", F.lit(0).alias("i"), F.col("atom_id").alias("j"))
    found = units.unit_types(own, arms)
    assert "Broadcast" not in plan(found)
    assert found.count() == 50


def test_unit_types_count_neighbours_of_the_component_only(spark):
    none = "array<struct<x:int,y:int,z:int>>"
    star = [("O", 0)] + [("Zn", 0)] * 4
    rows = [("in", k, e, c, None) for k, (e, c) in enumerate(star)] + [("out", k, e, c if k < 4 else 9, None) for k, (e, c) in enumerate(star)]
    own = spark.createDataFrame(rows, f"structure_id string, atom_id int, element string, comp_id int, lattice {none}")
    linked = spark.createDataFrame([(s, *e, k) for s in ("in", "out") for j in range(1, 5) for k in (0, 1) for e in ((0, j), (j, 0))], "structure_id string, i int, j int, sx int")
    assert {(r["structure_id"], r["comp_id"]): r["sbu_type"] for r in units.unit_types(own, linked).collect()} == {("in", 0): "IRMOF_sbu", ("out", 0): "still checking!", ("out", 9): "still checking!"}


CELL, KINDS = [[7.0, 0.0, 0.0], [2.0, 8.0, 0.0], [-1.0, 3.0, 9.0]], ("Zn", "O", "C", "H", "Na")


@pytest.fixture(scope="module")
def dense(spark):
    """Atoms crowded into a skew cell, some of them outside it, and one structure more that has an atom of no element."""
    rng = np.random.default_rng(5)
    rows = [("dense", k, KINDS[k % 5], *map(float, rng.uniform(-1, 2, 3))) for k in range(150)] + [("few", 0, "C", 0.0, 0.0, 0.0), ("few", 1, "X", 0.1, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "structure_id string, atom_id int, element string, fx double, fy double, fz double")
    return atoms.withColumn("cell", F.array(*(F.array(*map(F.lit, v)) for v in CELL))).withColumn("pbc", F.array(*[F.lit(True)] * 3)).localCheckpoint(), rows


def brute(rows, tolerance):
    own = [r for r in rows if r[0] == "dense"]
    f, radius = np.array([r[3:] for r in own]), np.array([elements.RADIUS[r[2]] for r in own])
    found = {}
    for s in np.ndindex(11, 11, 11):
        s = np.array(s) - 5
        d = np.linalg.norm((f[None] + s - f[:, None]) @ np.array(CELL), axis=2)
        found |= {(int(i), int(j), *map(int, s)): float(d[i, j]) for i, j in np.argwhere(d < radius[:, None] + radius + tolerance) if i != j or s.any()}
    return found


@pytest.mark.parametrize("block", [8000, 10])
def test_bonds_of_crowded_atoms_equal_brute_force(dense, block, monkeypatch):
    monkeypatch.setattr(bonds, "BLOCK", block)
    for most in (None, 1.0):
        found = bonds.perceive(dense[0], most=most, carry=("element",)).collect()
        want = {k: d for k, d in brute(dense[1], bonds.TOLERANCE).items() if most is None or d < most}
        assert len(found) == len(want) and {(r["i"], r["j"], r["sx"], r["sy"], r["sz"]) for r in found} == set(want)
        assert all(abs(r["dist"] - want[r["i"], r["j"], r["sx"], r["sy"], r["sz"]]) < 1e-9 and r["element_i"] == KINDS[r["i"] % 5] and r["element_j"] == KINDS[r["j"] % 5] for r in found)


def test_bonds_join_no_atoms_to_atoms(dense):
    assert plan(bonds.perceive(dense[0])).count("Join") <= 2  # the cutoff of each structure, named in the first and in the final plan


def test_only_near_pairs_are_measured(dense, monkeypatch):
    """Among many atoms of one block, pairs that are measured are a few times those that are bonds."""
    import pyarrow as pa

    n, rng = 4000, np.random.default_rng(1)
    f = rng.random((n, 3))
    table = pa.table({"structure_id": ["s"] * n, "block": pa.array(np.zeros(n, int)), "cell": [[16.0, 0, 0, 0, 16.0, 0, 0, 0, 16.0]] * n, "reach": np.full(n, 2.12), "large": np.full(n, 0.76), "atom_id": pa.array(np.arange(n, dtype=np.int32)), "r": np.full(n, 0.76)} | {f"g{x}": f[:, k] for k, x in enumerate("xyz")} | {f"{p}{x}": np.zeros(n, np.int32) for p in "sw" for x in "xyz"})
    measured, root = [], np.sqrt
    monkeypatch.setattr(bonds.np, "sqrt", lambda x: (measured.append(x.size), root(x))[1])
    found = sum(b.num_rows for b in bonds._pairs(table, bonds.TOLERANCE, None, ()))
    d = np.concatenate([np.linalg.norm((f[k : k + 500, None] - f[None]) * 16, axis=2).ravel() for k in range(0, n, 500)])
    assert found == (d < 2.12).sum() - n and sum(measured) - 25 * n < 4 * found


def test_orders_and_overlaps_without_all_bonds(dense):
    met = bonds.perceive(dense[0])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bonds.orders_of(dense[0])) == rows(bonds.orders(dense[0], met))
    for least in (0.0, 0.9, 1.0):
        assert rows(bonds.crowded(dense[0], least)) == rows(bonds.overlapping(dense[0], met, least))


def test_pairs_of_layers_are_not_gathered(spark):
    n = 60
    own = spark.createDataFrame([("s", k, k % n, 0.1 * k, float(k % 7), 0.005 * k) for k in range(2 * n)] + [("one", 0, 0, 0.0, 0.0, 0.0)], "structure_id string, atom_id int, comp_id int, x double, y double, z double")
    found = stacking.pairs(own.select("structure_id", "atom_id", "comp_id"), own.drop("comp_id"))
    assert "collect_list" not in plan(found)
    rows = found.collect()
    assert len(rows) == len({(r["i"], r["j"]) for r in rows}) == (n - 1) ** 2 - (n - 2) and all(r["structure_id"] == "s" and r["i"] < n and r["j"] > 1 and r["i"] != r["j"] for r in rows)
    told = stacking.layers(own.select("structure_id", "atom_id", "comp_id"), own.drop("comp_id")).collect()
    assert len(told) == 1 and [(*a, *b, c) for a, b, c in zip(told[0]["layers"], told[0]["lateral_offsets"], told[0]["interlayer_heights"], strict=True)] == sorted(tuple(r)[1:] for r in rows)


def test_hundredths_are_those_of_bround(spark):
    rng = np.random.default_rng(3)
    some = [*map(float, rng.uniform(0, 50, 3000)), *(k / 1000 for k in range(2000)), *(k / 200 for k in range(2000)), 0.0, 1e11 / 3, 1e12, 1e15 / 3, 1e300, float("inf"), 0.125, 0.375, 2.675, 1.005]
    rows = spark.createDataFrame([(x,) for x in some], "x double")
    assert rows.where(~stacking._hundredths(F.col("x")).eqNullSafe(F.bround("x", 2))).count() == 0


def test_cut_of_kinds_equals_cut_of_pairs(spark):
    firsts = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (3, None), (5, 9)], "node int, kind int")
    seconds = spark.createDataFrame([(1, 9), (10, 7), (11, 8), (12, None), (2, 8), (2, 8)], "node int, kind int")
    ends = (1, 2, 3, 5, 10, 11, 12, 99, None)
    linked = spark.createDataFrame([(a, b, s) for a in ends for b in ends for s in (0, 1)], "i int, j int, sx int")
    pairs = firsts.withColumnRenamed("node", "i").join(seconds.withColumnRenamed("node", "j"), "kind").select("i", "j")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(edges.cut_alike(linked, firsts, seconds, [])) == rows(edges.cut(linked, pairs, []).select("i", "j", "sx"))


def test_cut_contacts_make_no_row_for_each_pair(spark, monkeypatch):
    from framewell.plans import catalogue

    monkeypatch.setattr(catalogue.edges, "cut", None)
    assert "s_nationkey" not in "".join(x for x in plan(catalogue.cut_antijoin(spark, "/root/testdata/sf0.001")).splitlines() if "Join" in x)
