import random

import pytest
from pyspark.sql import functions as F

from framewell.functions import numbers, text
from framewell.operators import components, edges, groups, records
from framewell.sources import netlog, tables


def test_connected_components_equal_brute_force(spark):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {n: find(n) for n in root}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gcd_and_ratio(spark):
    row = spark.range(1).select(numbers.gcd(F.lit(84), F.lit(36)).alias("g"), numbers.gcd(F.lit(5), F.lit(0)).alias("z"), numbers.ratio(F.lit(6), F.lit(1)).alias("a"), numbers.ratio(F.lit(2), F.lit(48)).alias("b"), numbers.gcd_all(F.array(F.lit(12), F.lit(30), F.lit(18))).alias("c")).first()
    assert tuple(row) == (12, 5, "6", "1/24", 6)


def test_canonical_edges(spark):
    rows = [("s", 2, 1, 1, 0, 0), ("s", 1, 2, -1, 0, 0), ("s", 3, 3, 0, 0, 0), ("s", 3, 3, 1, -1, 0), ("s", 3, 3, -1, 1, 0)]
    found = edges.canonical(spark.createDataFrame(rows, "structure_id string, u int, v int, sx int, sy int, sz int")).collect()
    assert sorted(tuple(r)[1:] for r in found) == [(1, 2, -1, 0, 0), (3, 3, -1, 1, 0)]


def test_splice_and_contract(spark):
    schema = "structure_id string, u int, v int, sx int, sy int, sz int"
    path = spark.createDataFrame([("s", 1, 9, 0, 0, 0), ("s", 9, 2, 1, 0, 0), ("s", 2, 3, 0, 0, 0)], schema)
    out = edges.splice(path, spark.createDataFrame([("s", 9)], "structure_id string, node int"))
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(1, 2, 1, 0, 0), (2, 3, 0, 0, 0)]
    links = spark.createDataFrame([("s", 1, 5, 0, 0, 0), ("s", 1, 6, 0, 0, 0), ("s", 2, 6, 1, 0, 0), *(("s", n, 7, 0, 0, 0) for n in (1, 2, 3))], "structure_id string, node int, link int, sx int, sy int, sz int")
    got = sorted(tuple(r)[1:] for r in edges.contracted(links).collect())
    assert got == sorted([(1, 2, -1, 0, 0), *((-8, n, 0, 0, 0) for n in (1, 2, 3))])


def test_regions_and_formulae(spark):
    members = spark.createDataFrame([("s", c, e) for c, own in ((0, "CCHHO"), (3, "OCHCH"), (7, "Zn")) for e in ([own] if own == "Zn" else own)], "structure_id string, comp_id int, element string")
    assert {r["comp_id"]: r["region_id"] for r in groups.regions(members).collect()} == {0: 0, 3: 0, 7: 7}
    assert {r["comp_id"]: r["formula"] for r in groups.formula(members, ["structure_id", "comp_id"]).collect()} == {0: "C2H2O", 3: "C2H2O", 7: "Zn"}


def test_records(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(2):
        tables.upsert(spark, spark.createDataFrame([("a", k, k), ("b" if k else "c", 5, k)], "key string, value int, seq int"), path, ["key"], "seq")
    assert {r["key"]: r["value"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 5, "c": 5}
    assert records.unique(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), ["b"]).count() == 1


def test_text_keys(spark):
    row = spark.createDataFrame([("/x/my file.v2.cif",)], "p string").select(text.record_key(F.col("p")).alias("k"), text.base_name(F.col("p")).alias("b")).first()
    assert row["k"].startswith("my_file.v2__") and len(row["k"]) == len("my_file.v2__") + 12 and row["b"] == "my file"


def test_zip_and_suffixes(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "one")
        z.writestr("y.txt", "two")
    assert {r["name"]: bytes(r["content"]) for r in tables.unzipped(spark, str(tmp_path / "a.zip")).collect()} == {"x.txt": b"one", "y.txt": b"two"}
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t.json").write_text('{"a": 1}')
    (tmp_path / "t.log").write_text("l1\nl2\n")
    assert tables.load(spark, str(tmp_path / "t.csv")).columns == ["a", "b"] and tables.load(spark, str(tmp_path / "t.json")).first()["a"] == 1 and tables.load(spark, str(tmp_path / "t.log")).count() == 2
    with pytest.raises(ValueError, match="pickled"):
        tables.load(spark, "x.pkl")


LOG = """Data file "x".
   Processing component 1:
   dimension = 3
   Given space group is P1.
   Ideal space group is Pm-3m.
   Coordination sequences:
      Node 1:    6 18 38
   TD10 = 1561
   Structure was identified:
       Name:            pcu
   Relaxed cell parameters:
       a = 1.00000, b = 1.00000, c = 1.00000
       alpha = 90.0000, beta = 90.0000, gamma = 90.0000
   Relaxed positions:
      Node 1:    0.00000 0.00000 0.00000
   Edges:
      0.00000 0.00000 0.00000  <->  1.00000 0.00000 0.00000
   Edge centers:
      0.50000 0.00000 0.00000
   Processing component 2:
   a 2-periodic net
"""


def test_net_log(spark):
    outputs = spark.createDataFrame([("s", LOG), ("t", "an Error was met"), ("u", "nothing")], "structure_id string, stdout string")
    row = netlog.parsed(outputs).collect()
    assert len(row) == 1
    assert (row[0]["name"], row[0]["dimension"], row[0]["td10"], row[0]["coordination"]) == ("pcu", 3, 1561.0, [6])
    assert row[0]["cell"] == [1, 1, 1, 90, 90, 90] and row[0]["space_groups"]["ideal"] == "Pm-3m" and row[0]["centres"] == [[0.5, 0, 0]]
    assert {r["structure_id"]: r["topology"] for r in netlog.topologies(outputs).collect()} == {"s": "MISMATCH", "t": "ERROR", "u": "UNKNOWN"}
    made = netlog.best(netlog.parsed(outputs)).select(netlog.hashed().alias("h"), netlog.crystal_text(F.lit("x")).alias("t")).first()
    assert len(made["h"]) == 64 and "NODE 1 1 0.000000" in made["t"]
