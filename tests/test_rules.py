"""Each cut rule on a few atoms given by their bonds."""

import pytest
from pyspark.sql import functions as F

from framewell.operators import rules

#: rule: (scheme, elements by id, bonds, pairs that are cut by the rule)
CASES = {
    "S1": ("sbu", "C O O Zn C H", [(0, 1), (0, 2), (1, 3), (0, 4), (4, 5)], [(0, 4)]),
    "S3": ("sbu", "C Zn H", [(0, 1), (0, 2)], [(0, 1)]),
    "S4": ("sbu", "S O Zn C", [(0, 1), (1, 2), (0, 3)], [(0, 3)]),
    "S5": ("sbu", "S O Zn C C", [(0, 1), (1, 2), (0, 3), (0, 4)], [(1, 2)]),
    "S6": ("sbu", "C P P Zn C", [(0, 1), (0, 2), (1, 3), (0, 4)], [(0, 4)]),
    "S7": ("sbu", "C S S Zn C", [(0, 1), (0, 2), (1, 3), (0, 4)], [(0, 4)]),
    "S8": ("sbu", "C S O Zn Zn C", [(0, 1), (0, 2), (1, 3), (2, 4), (0, 5)], [(0, 5)]),
    "S9": ("sbu", "O Zn C H", [(0, 1), (0, 2), (2, 3)], [(0, 2)]),
    "S10": ("sbu", "O Zn C C", [(0, 1), (0, 2), (0, 3)], [(0, 1)]),
    "S11": ("sbu", "O Zn N C C O", [(0, 1), (0, 2), (2, 3), (2, 4), (2, 5)], [(0, 2)]),
    "S12": ("sbu", "N O Zn C", [(0, 1), (1, 2), (0, 3)], [(0, 1)]),
    "S13": ("sbu", "N Zn C", [(0, 1), (0, 2)], [(0, 1)]),
    "S14": ("sbu", "S Zn H", [(0, 1), (0, 2)], [(0, 1)]),
    "S15": ("sbu", "P O Zn C H", [(0, 1), (1, 2), (0, 3), (3, 4)], [(0, 3)]),
    "S16": ("sbu", "B N Zn", [(0, 1), (1, 2)], [(1, 2)]),
    "S17": ("sbu", "Zn H O", [(0, 1), (0, 2)], [(0, 1)]),
    "L2": ("ligand_cluster", "S O Zn C", [(0, 1), (1, 2), (0, 3)], [(1, 2)]),
    "L3": ("ligand_cluster", "C P P Zn", [(0, 1), (0, 2), (1, 3)], [(1, 3)]),
    "L4": ("ligand_cluster", "C S S Zn", [(0, 1), (0, 2), (1, 3)], [(1, 3)]),
    "L5": ("ligand_cluster", "C Zn H", [(0, 1), (0, 2)], [(0, 1)]),
    "L6": ("ligand_cluster", "N Zn C", [(0, 1), (0, 2)], [(0, 1)]),
    "L7": ("ligand_cluster", "S Zn H", [(0, 1), (0, 2)], [(0, 1)]),
    "L8": ("ligand_cluster", "C O O Zn C", [(0, 1), (0, 2), (1, 3), (0, 4)], [(1, 3)]),
    "L9": ("ligand_cluster", "O Zn N C C", [(0, 1), (0, 2), (2, 3), (2, 4)], [(0, 1)]),
    "L10": ("ligand_cluster", "O Zn C C", [(0, 1), (0, 2), (0, 3)], [(0, 1)]),
    "L11": ("ligand_cluster", "P O Zn", [(0, 1), (1, 2)], [(1, 2)]),
    "L12": ("ligand_cluster", "Zn H O", [(0, 1), (0, 2)], [(0, 1)]),
    "imine": ("cof", "C N H C", [(0, 1), (0, 2), (0, 3)], [(0, 1)]),
}


@pytest.fixture(scope="module")
def found(spark):
    atoms = spark.createDataFrame([(k, i, e) for k, (_, names, _, _) in CASES.items() for i, e in enumerate(names.split())], "structure_id string, atom_id int, element string")
    pairs = [(k, a, b, 0, 0, 0, 1.0) for k, (_, _, bonds, _) in CASES.items() for i, j in bonds for a, b in ((i, j), (j, i))]
    bonds = spark.createDataFrame(pairs, "structure_id string, i int, j int, sx int, sy int, sz int, dist double")
    marks = rules.marked(atoms, bonds).cache()
    out = {}
    for scheme in rules.SCHEMES:
        for r in rules.cuts(marks, bonds, scheme).withColumn("scheme", F.lit(scheme)).collect():
            out.setdefault((r["structure_id"], r["scheme"], r["rule"]), set()).add((min(r["i"], r["j"]), max(r["i"], r["j"])))
    return out


@pytest.mark.parametrize("rule", CASES)
def test_rule(found, rule):
    scheme, _, _, pairs = CASES[rule]
    assert found.get((rule, scheme, rule)) == set(pairs)


def test_porphyrin_nitrogens_are_not_cut(spark):
    ring = [(0, n) for n in range(1, 5)] + [(n, 4 + n) for n in range(1, 5)] + [(4 + n, 5 + n % 4) for n in range(1, 5)]
    names = ["Zn", "N", "N", "N", "N", "C", "C", "C", "C"]
    atoms = spark.createDataFrame([("p", i, e) for i, e in enumerate(names)], "structure_id string, atom_id int, element string")
    bonds = spark.createDataFrame([("p", a, b, 0, 0, 0, 1.0) for i, j in ring for a, b in ((i, j), (j, i))], "structure_id string, i int, j int, sx int, sy int, sz int, dist double")
    marks = rules.marked(atoms, bonds)
    assert rules.cuts(marks, bonds, "sbu").count() == rules.cuts(marks, bonds, "ligand_cluster").count() == 0
