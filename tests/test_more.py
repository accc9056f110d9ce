import json
import zipfile

import pytest
from pyspark.sql import functions as F

from framewell.functions import geometry
from framewell.operators import bonds, components, edges, nets, records, rules, topology, units
from framewell.plans.framework import Framework
from framewell.sources import netlog, packed, structures, tables
from tests import crystals


@pytest.fixture(scope="module")
def cubic(spark):
    return Framework(structures.parse(spark.createDataFrame([("cubic", "cubic.cif", crystals.cubic())], "structure_id string, source string, text string")))


def test_geometry(spark):
    p = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    row = spark.range(1).select(
        geometry.planar(p(0, 0, 0), p(9, 0, 0), p(0, 9, 0), p(5, 5, 0)).alias("flat"), geometry.planar(p(0, 0, 0), p(9, 0, 0), p(0, 9, 0), p(5, 5, 4)).alias("bent"),
        geometry.nearest_image(p(0.75, -0.75, 0.25)).alias("near"), geometry.to_front(F.array(*(F.lit(x) for x in "abcd")), F.lit(2)).alias("front"), geometry.jittered(F.lit(90.0), 1).alias("angle"),
    ).first()
    assert row["flat"] and not row["bent"] and row["near"] == [-0.25, 0.25, 0.25] and row["front"] == ["c", "a", "b", "d"] and 1.48 < row["angle"] < 1.66
    labels = spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "l string")
    assert [r["l"] for r in labels.orderBy(*geometry.label_order(F.col("l"))).collect()] == ["9", "10", "a", "b"]


def test_bond_orders(cubic):
    found = {(r["i"], r["j"]): r["bond_order"] for r in bonds.orders(cubic.atoms, cubic.bonds).collect()}
    assert found and all(found[j, i] == o for (i, j), o in found.items()) and set(found.values()) <= {1.0, 2.0, 3.0}


def test_rings(spark):
    ring = [(k, (k + 1) % 6) for k in range(6)] + [(0, 7)]
    rows = [("s", a, b, 0, 0, 0) for i, j in ring for a, b in ((i, j), (j, i))] + [("t", 0, 0, 1, 0, 0), ("t", 0, 0, -1, 0, 0)]
    atoms = spark.createDataFrame([("s", k) for k in range(8)] + [("t", 0)], "structure_id string, atom_id int")
    found = components.rings(atoms, spark.createDataFrame(rows, "structure_id string, i int, j int, sx int, sy int, sz int")).collect()
    assert [(r["structure_id"], r["atoms"]) for r in found] == [("s", [0, 1, 2, 3, 4, 5])]


def test_as_many_dummies_as_points_of_extension(cubic):
    n = {r["comp_id"]: r["n"] for r in units.dummies(cubic.cut("ligand_cluster"), cubic.atoms).groupBy("comp_id").agg(F.count("*").alias("n")).collect()}
    for r in cubic.ligands().collect():
        assert n[r["unit_id"]] == r["n_points_of_extension"]


def test_drawing_over_cells(cubic):
    centres, edges = cubic.drawing("all_node")
    markers, lines = nets.replicas(centres, edges, (2, 1, 3))
    assert markers.count() == 6 * centres.count() and lines.count() == 6 * edges.count()


def test_first_hit(spark):
    rows = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["x"])], "id int, keys array<string>")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    assert {r["id"]: r["name"] for r in records.first_hit(rows, "id", F.col("keys"), names).collect()} == {1: "B", 2: None}


def test_json_text(cubic):
    made = json.loads(structures.json_text(cubic.atoms).first()["text"])
    assert made["n_atoms"] == len(made["positions"]) == len(made["labels"]) == 13 and made["periodic"] == [True] * 3


def test_msgpack(spark, tmp_path):
    value = {"a": [1, -1, -33, 127, 128, 2**40, -(2**40), 2**63], "b": {"c": None, "d": [True, False, 0.5]}, "é" * 40: b"x" * 300, "t": "y" * 70000, "l": list(range(20))}
    assert packed.unpack(packed.pack(value)) == value
    # the small forms of other writers: a mapping of one key, a list of two numbers, a short text, a float of four bytes
    assert packed.unpack(b"\x82\xa1a\x92\x01\xff\xa1b\xca\x3f\x00\x00\x00") == {"a": [1, -1], "b": 0.5}
    (tmp_path / "n.msgpack").write_bytes(packed.pack({"k1": "name one", "k2": 'two "x"'}))
    assert {tuple(r) for r in tables.names(spark, str(tmp_path / "n.msgpack")).collect()} == {("k1", "name one"), ("k2", 'two "x"')}
    rows = packed.packed(spark.createDataFrame([("r", 1, None)], "id string, n int, s string"), "id").collect()
    assert packed.unpack(bytes(rows[0]["content"])) == {"n": 1, "s": None}


def test_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    rows = tables.load(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()
    assert [r["cells"] for r in rows] == [{"id": "7", "name": ""}, {"id": "", "name": "x"}]


def test_arrays_as_json(spark):
    row = spark.range(1).select(tables.array_json(F.array(F.array(F.lit(0.5), F.lit(2.0)))).alias("j")).select("j", tables.json_array(F.col("j")).alias("a")).first()
    assert row["a"] == json.loads(row["j"]) == [[0.5, 2.0]]


def test_partners(spark):
    pairs = spark.createDataFrame([("s", 1, 5, 0), ("s", 7, 1, 1), ("t", 1, 2, 0)], "structure_id string, i int, j int, at int")
    ids = spark.createDataFrame([("s", 1), ("s", 7), ("s", 9), ("t", 2)], "structure_id string, id int")
    assert {(r["structure_id"], r["id"]): r["partner"] for r in edges.partners(pairs, ids, "at").collect()} == {("s", 1): 5, ("s", 7): 1, ("s", 9): None, ("t", 2): 1}


def test_components_of_an_output(spark):
    block = "Processing component {}:\n{}   Relaxed positions:\n      Node 1: 0 0 0\n   Edges:\n      0 0 0 <-> 1 0 0\n{}"
    text = block.format(1, "   Name: pcu\n", "") + block.format(2, "", "      0 0 0 <-> 0 1 0\n")
    rows = netlog.parsed(spark.createDataFrame([("a", text)], "structure_id string, stdout string"))
    assert [r["component"] for r in netlog.named(rows).collect()] == [1] and [r["n_edges"] for r in netlog.counts(netlog.unnamed(rows)).collect()] == [2]
    assert netlog.selected(rows).first()["component"] == 2 and netlog.selected(rows, 1).first()["name"] == "pcu"
    assert list(netlog.unnamed_hashes(rows).first()["hashes"]) == [2]
    line = spark.createDataFrame([("a", "pcu", 3, None)], "structure_id string, topology string, dimension int, td10 double").select(netlog.summary_line().alias("l"), netlog.default_cell().alias("c")).first()
    assert line["l"] == "a  pcu  3  -" and line["c"] == [1, 1, 1, 90, 90, 90]


def test_spheres_and_planes(spark):
    row = spark.range(1).select(units.coordination_sphere(F.array(F.array(F.lit("O")), F.array(F.lit("Zn"), F.lit("N"))), F.lit("Zn"), F.lit(1)).alias("s")).first()
    assert row["s"] == ["Zn", "N"]
    flat = [("Zn", 0, 0, 0), ("N", 2, 0, 0), ("N", 0, 2, 0), ("N", -2, 0, 0), ("N", 0, -2, 0)]
    bent = [*flat[:4], ("N", 0, 0, 2)]
    atoms = spark.createDataFrame([(k, i, e, float(x), float(y), float(z)) for k, own in (("flat", flat), ("bent", bent)) for i, (e, x, y, z) in enumerate(own)], "structure_id string, atom_id int, element string, x double, y double, z double")
    linked = spark.createDataFrame([(k, a, b) for k in ("flat", "bent") for n in range(1, 5) for a, b in ((0, n), (n, 0))], "structure_id string, i int, j int")
    assert [tuple(r) for r in rules.planar_porphyrin(rules.neighbours(atoms, linked), atoms).collect()] == [("flat", 0)]


def test_net_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.cgd").write_text("PERIODIC_GRAPH\n  ID p\n  EDGES\n    1 1 1 0 0\n    1 1 0 1 0\n    1 1 0 0 1\nEND\n")
    (tmp_path / "bad.cgd").write_text("nothing")
    found = {r["source"].rsplit("/", 1)[-1]: (r["topology"], r["error"]) for r in topology.identified(spark, str(tmp_path)).collect()}
    assert found == {"p.cgd": ("pcu", None), "bad.cgd": (None, "no net")}
