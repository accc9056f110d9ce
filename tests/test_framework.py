import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.functions import elements
from framewell.operators import bonds, components, nets, topology
from framewell.plans.framework import Framework
from framewell.sources import structures
from tests import crystals

FILES = {"cubic": crystals.cubic(), "double": crystals.cubic(2), "guest": crystals.cubic(guest=True), "moved": crystals.cubic(origin=0.3), "rod": crystals.rod(), "sheets": crystals.sheets(), "broken": "data_x\n_cell_length_a 3\n"}


@pytest.fixture(scope="module")
def parsed(spark):
    return structures.parse(spark.createDataFrame([(k, f"{k}.cif", v) for k, v in FILES.items()], "structure_id string, source string, text string")).cache()


@pytest.fixture(scope="module")
def framework(parsed):
    return Framework(parsed)


def by_id(df):
    return {r["structure_id"]: r for r in df.collect()}


def test_reader_maps_columns_by_name_and_keeps_errors(parsed):
    found = by_id(structures.structures(parsed))
    assert found["cubic"]["n_atoms"] == 13 and found["sheets"]["n_atoms"] == 2
    assert found["broken"]["error"] and found["broken"]["n_atoms"] == 0
    assert all(found[k]["error"] is None for k in FILES if k != "broken")


def test_symmetry_operations_are_applied():
    text = crystals.cif((4, 4, 4, 90, 90, 90), [("Na", 0.1, 0.2, 0.3), ("Cl", 0.0, 0.0, 0.0)]).replace(" 'x, y, z'\n", " 'x, y, z'\n '-x, -y, -z'\n")
    _, atoms = structures.parse_cif(text)
    assert sorted(a["element"] for a in atoms) == ["Cl", "Na", "Na"]


def test_bonds_equal_brute_force(parsed):
    atoms = structures.atoms(parsed)
    found = {(r["structure_id"], r["i"], r["j"], r["sx"], r["sy"], r["sz"]) for r in bonds.perceive(atoms).collect()}
    rows: dict[str, list] = {}
    for r in atoms.orderBy("structure_id", "atom_id").collect():
        rows.setdefault(r["structure_id"], []).append(r)
    brute = set()
    images = [(i, j, k) for i in range(-4, 5) for j in range(-4, 5) for k in range(-4, 5)]
    for name, own in rows.items():
        cell = np.array(own[0]["cell"])
        f = np.array([[r["fx"], r["fy"], r["fz"]] for r in own])
        radius = np.array([elements.RADIUS[r["element"]] for r in own])
        for s in images:
            d = np.linalg.norm((f[None] + s - f[:, None]) @ cell, axis=2)
            for i, j in np.argwhere(d < radius[:, None] + radius + bonds.TOLERANCE):
                if i != j or any(s):
                    brute.add((name, int(i), int(j), *s))
    assert found == brute


def test_guests_go(framework):
    n = by_id(framework.atoms.groupBy("structure_id").agg(F.count("*").alias("n")))
    assert n["guest"]["n"] == n["cubic"]["n"] == 13 and n["double"]["n"] == 26


def test_building_units(framework):
    rows = framework.building_units("ligand_cluster").where("structure_id = 'cubic'").collect()
    kinds = {r["kind"]: r for r in rows}
    assert kinds["metal"]["formula"] == "Zn" and kinds["metal"]["n_points_of_extension"] == 6
    assert kinds["organic"]["formula"] == "C2N2" and len(kinds["organic"]["members"]) == 3 and kinds["organic"]["n_points_of_extension"] == 2


@pytest.mark.parametrize("method", ["sbus", "all_node", "single_node"])
def test_primitive_cubic_net(framework, method):
    found = by_id(framework.topology(method))
    for name in ("cubic", "double", "guest", "moved"):
        assert (found[name]["topology"], found[name]["dimension"], found[name]["td10"]) == ("pcu", 3, 1561)


def test_fingerprint_does_not_see_cells_guests_or_origins(framework):
    found = by_id(framework.fingerprint())
    assert len({found[k]["fingerprint_hash"] for k in ("cubic", "double", "guest", "moved")}) == 1
    assert found["double"]["cluster_units"] == 2 * found["cubic"]["cluster_units"]
    payload = json.loads(found["cubic"]["payload"])
    assert payload["clusters"] == {"Zn": {"count": "1", "contacts": {"6": "1"}, "capped": {"0": "1"}}}
    assert payload["ligands"] == {"C2N2": {"count": "3", "contacts": {"2": "3"}, "denticity": {"1": "6"}}}
    assert payload["terminal"] == {} and found["rod"]["fingerprint_hash"] != found["cubic"]["fingerprint_hash"]


def test_rod_keeps_its_lattice(framework):
    own = framework.cut("sbu").members.where("structure_id = 'rod' AND element = 'Ti'").first()
    assert [tuple(v) for v in own["lattice"]] == [(0, 0, 1)]
    kind = framework.secondary_units().where("structure_id = 'rod' AND kind = 'metal'").first()
    assert kind["sbu_type"] == ["rodlike"]


def test_sheets_are_stacked(framework):
    row = by_id(framework.stacking())["sheets"]
    assert row["layers"] == [[1, 2]] and row["lateral_offsets"] == [[0.7, 0.0]] and row["interlayer_heights"] == [3.5]


def test_open_metals_and_overlaps(framework):
    found = by_id(framework.open_metals())
    assert found["cubic"]["metals"] == ["Zn"] and not found["cubic"]["has_oms"] and found["cubic"]["approximate"]
    assert by_id(framework.overlaps())["cubic"]["clear"]


def test_porosity_has_its_keys(framework):
    from framewell.operators.porosity import NAMES

    row = by_id(framework.porosity(probe=0.5, samples=500))["cubic"]
    assert set(NAMES) <= set(row.asDict()) and 0 < row["AV_Volume_fraction"] < 1 and row["LCD_A"] >= row["PLD_A"] > 0


def test_drawing_edges_fit_positions(framework):
    centres, edges = framework.drawing("all_node")
    place = {(r["structure_id"], r["node"]): np.array([r["fx"], r["fy"], r["fz"]]) for r in centres.collect()}
    rows = edges.where("structure_id IN ('cubic', 'double', 'moved')").collect()
    assert rows
    for r in rows:
        gap = place[r["structure_id"], r["v"]] + [r["sx"], r["sy"], r["sz"]] - place[r["structure_id"], r["u"]]
        assert np.abs(gap).max() <= 1.001 and np.abs(gap).max() > 0.4


def test_texts_can_be_read_again(spark, parsed, framework):
    atoms = framework.atoms.where("structure_id = 'cubic'")
    for suffix, made in (("cif", structures.cif_text(atoms)), ("xyz", structures.xyz_text(atoms))):
        again = structures.parse(made.select(F.concat("structure_id", F.lit(f"_{suffix}")).alias("structure_id"), F.lit(f"a.{suffix}").alias("source"), "text"))
        assert structures.structures(again).first()["n_atoms"] == 13
        kept = {(r["element"], round(r["fx"], 4), round(r["fy"], 4), round(r["fz"], 4)) for r in structures.atoms(again).collect()}
        assert kept == {(r["element"], round(r["fx"], 4), round(r["fy"], 4), round(r["fz"], 4)) for r in atoms.collect()}
    assert structures.cssr_text(atoms).first()["text"].splitlines()[2].split()[0] == "13"


def test_net_text_can_be_read_again(framework):
    found, _ = framework.net("all_node")
    texts = nets.net_text(found).withColumnRenamed("cgd", "text")
    assert {tuple(r) for r in nets.net_edges(texts).collect()} == {tuple(r) for r in found.collect()}


def test_lattice_basis_does_not_depend_on_order():
    random = np.random.default_rng(0)
    for _ in range(200):
        v = random.integers(-4, 5, (4, 3))
        basis = components.lattice_basis(v)
        assert basis == components.lattice_basis(random.permutation(v)) == components.lattice_basis(-v)
        for row in v:
            assert components.modulo(tuple(int(x) for x in row), basis) == (0, 0, 0)


def test_names_need_dimension_and_sequences():
    own = [[4 * k * k + 2 for k in range(1, 11)]]
    assert topology.name_of(3, own) == "pcu" and topology.name_of(2, own) == topology.name_of(3, [[1] * 10]) == "UNKNOWN"


def test_empty_table(spark, parsed):
    nothing = Framework(parsed.where("false"))
    assert nothing.secondary_units().count() == nothing.fingerprint().count() == nothing.topology().count() == nothing.stacking().count() == 0
