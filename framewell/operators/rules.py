"""Where a framework is cut: local patterns around an atom, as expressions over its neighbourhood.

``around`` gives each atom a row with its neighbours (each once, however many
images bond) and, for each neighbour, what that one is bonded to. Groups mark
atoms (carboxylate carbons and so on); a rule is then an expression over one
row that yields pairs to cut. Rules are not exclusive; pairs are distinct in the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions import elements, geometry
from framewell.operators import components

KEY = ["structure_id"]
PAIR = "array<struct<i:int,j:int>>"


def neighbours(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, atom_id, element, metal, near): the neighbours of each atom with counts of what these are bonded to."""
    kinds = atoms.select("structure_id", "atom_id", "element", elements.is_metal(F.col("element")).alias("metal"))
    pairs = bonds.where("i <> j").select("structure_id", "i", "j").distinct()
    far = kinds.select("structure_id", F.col("atom_id").alias("j"), F.col("element").alias("e"), F.col("metal").alias("m"))
    met = pairs.join(far, ["structure_id", "j"])
    count = lambda s: F.count_if(F.col("e") == s).cast("int")
    own = met.groupBy("structure_id", F.col("i").alias("j")).agg(
        F.array_sort(F.collect_list(F.when(F.col("m"), F.col("j")))).alias("metals"), count("C").alias("n_c"), count("N").alias("n_n"), count("S").alias("n_s"), count("O").alias("n_o"),
        F.count_if(~F.col("m")).cast("int").alias("n_plain"), F.count("*").cast("int").alias("degree"),
    )
    known = met.join(own, ["structure_id", "j"])
    near = known.groupBy("structure_id", F.col("i").alias("atom_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("id"), F.col("e").alias("element"), F.col("m").alias("metal"), "metals", "n_c", "n_n", "n_s", "n_o", "n_plain", "degree"))).alias("near"))
    return kinds.join(near, ["structure_id", "atom_id"], "left").withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType)))


def of(symbol: str, where: str = "near") -> Column:
    """The neighbours of an element."""
    return F.filter(where, lambda x: x["element"] == symbol)


def n_of(symbol: str) -> Column:
    return F.size(of(symbol))


def meets_metal(symbol: str) -> Column:
    """Whether some neighbour of an element is bonded to a metal."""
    return F.exists(of(symbol), lambda x: F.size(x["metals"]) > 0)


#: Groups by the atom at their centre, and the neighbours (or itself) that they own.
GROUPS: dict[str, tuple[Callable[[], Column], str]] = {
    "carboxylate": (lambda: (F.col("element") == "C") & (n_of("O") == 2) & meets_metal("O"), "O"),
    "nitroxyl": (lambda: (F.col("element") == "N") & (n_of("O") == 1) & meets_metal("O"), "O"),
    "sulphate": (lambda: (F.col("element") == "S") & meets_metal("O") & (n_of("C") >= 1), "O"),
    "sulfide": (lambda: (F.col("element") == "C") & (n_of("S") == 2) & meets_metal("S"), "S"),
    "phosphite": (lambda: (F.col("element") == "C") & (n_of("P") == 2) & meets_metal("P"), "P"),
    "cos": (lambda: (F.col("element") == "C") & (F.size("near") == 3) & (n_of("S") + n_of("O") == 2) & meets_metal("S") & meets_metal("O"), "SO"),
    "ferrocene": (lambda: F.col("metal") & (F.size("near") >= 10) & (n_of("C") >= 10), ""),
}


def porphyrin(around: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, atom_id) of metals with four nitrogen neighbours, and these: if taking all such metals out leaves as many components as there were."""
    candidates = around.where(F.col("metal") & (n_of("N") == 4)).select("structure_id", "atom_id", F.transform(of("N"), lambda x: x["id"]).alias("nitrogens"))
    some = candidates.select("structure_id").distinct()
    atoms, links = around.select("structure_id", "atom_id").join(some, "structure_id", "left_semi"), bonds.join(some, "structure_id", "left_semi")
    fewer = atoms.join(candidates.select("structure_id", "atom_id"), ["structure_id", "atom_id"], "left_anti")
    count = lambda d, name: d.groupBy("structure_id").agg(F.count_distinct("comp_id").alias(name))
    same = count(components.unwrapped(atoms, links), "a").join(count(components.unwrapped(fewer, links), "b"), "structure_id").where("a = b")
    return candidates.join(same, "structure_id", "left_semi").select("structure_id", F.explode(F.concat(F.array("atom_id"), "nitrogens")).alias("atom_id")).distinct()


def marked(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``neighbours`` with the groups that an atom is the centre of, those that own it, and the same for each neighbour."""
    around = neighbours(atoms, bonds)
    centres = F.array_compact(F.array(*(F.when(test(), F.lit(name)) for name, (test, _) in GROUPS.items())))
    around = around.withColumn("centre", centres)
    parts = [F.when(F.array_contains("centre", name), _owned(symbol, name)) for name, (_, symbols) in GROUPS.items() for symbol in symbols]
    owned = around.select("structure_id", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("o")).select("structure_id", "o.atom_id", "o.by")
    ring = porphyrin(around, bonds).select("structure_id", "atom_id", F.lit("porphyrin").alias("by"))
    flags = owned.unionByName(ring).groupBy("structure_id", "atom_id").agg(F.collect_set("by").alias("owner"))
    none = F.array().cast("array<string>")
    around = around.join(flags, ["structure_id", "atom_id"], "left").withColumn("owner", F.coalesce("owner", none))
    told = around.select("structure_id", F.col("atom_id").alias("id"), F.col("centre").alias("is"), "owner")
    spread = around.select("structure_id", "atom_id", F.explode("near").alias("x")).select("structure_id", "atom_id", "x.*").join(told, ["structure_id", "id"])
    near = spread.groupBy("structure_id", "atom_id").agg(F.array_sort(F.collect_list(F.struct("id", "element", "metal", "metals", "n_c", "n_n", "n_s", "n_o", "n_plain", "degree", "is", "owner"))).alias("near"))
    whole = around.drop("near").join(near, ["structure_id", "atom_id"], "left")
    whole = whole.withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType)))
    iron = F.transform(F.filter("near", lambda x: x["metal"] & F.array_contains(x["is"], "ferrocene")), lambda x: x["id"])
    return whole.withColumn("ferrocenes", iron)


def _owned(symbol: str, name: str) -> Column:
    return F.transform(of(symbol), lambda x: F.struct(x["id"].alias("atom_id"), F.lit(name).alias("by")))


def is_(group: str) -> Column:
    return F.array_contains("centre", group)


def free(*groups: str) -> Column:
    """Whether none of the groups owns the atom."""
    return ~F.arrays_overlap("owner", F.array(*(F.lit(g) for g in groups)))


def metals(ferrocene: bool = False) -> Column:
    """Neighbouring metals, without those of ferrocenes unless asked for."""
    return F.filter("near", lambda x: x["metal"] & (F.lit(ferrocene) | ~F.array_contains(x["is"], "ferrocene")))


def to(neighbours: Column) -> Column:
    """Pairs of the atom with the given neighbours."""
    return F.transform(neighbours, lambda x: F.struct(F.col("atom_id").alias("i"), x["id"].alias("j")))


def beyond(neighbours: Column) -> Column:
    """Pairs of given neighbours with their metals."""
    return F.flatten(F.transform(neighbours, lambda x: F.transform(x["metals"], lambda m: F.struct(x["id"].alias("i"), m.alias("j")))))


def when(test: Column, pairs: Column) -> Column:
    return F.when(test, pairs.cast(PAIR))


def one(symbol: str) -> Column:
    """The neighbours of an element if there is exactly one."""
    return F.when(n_of(symbol) == 1, of(symbol)).otherwise(F.slice(of(symbol), 1, 0))


def is_element(symbol: str) -> Column:
    return F.col("element") == symbol


def loose_ends() -> Column:
    """Hydrogen and carbon on a metal that is no ferrocene's and no porphyrin's."""
    return when(F.col("metal") & ~is_("ferrocene") & free("porphyrin"), to(F.filter("near", lambda x: x["element"].isin("H", "C"))))


def unit_rules() -> dict[str, Column]:
    """Cuts that leave secondary building units."""
    plain_c = F.filter(of("C"), lambda x: ~F.array_contains(x["is"], "carboxylate"))
    oxygen = is_element("O") & free("carboxylate", "sulphate", "cos", "nitroxyl")
    n_m = F.size(metals())
    wide_n = lambda x: F.coalesce(F.when(x["n_c"] > 0, x["n_c"] > 1), F.when(x["n_n"] > 0, x["n_n"] > 1), x["n_s"] > 1)
    return {
        "S1": when(is_("carboxylate"), F.concat(to(one("C")), to(one("N")), to(one("S")))),
        "S3": when(is_element("C"), to(metals())),
        "S4": when(is_("sulphate"), to(one("C"))),
        "S5": when(is_("sulphate") & (n_of("C") > 1), beyond(of("O"))),
        "S6": when(is_("phosphite"), to(F.filter("near", lambda x: x["element"] != "P"))),
        "S7": when(is_("sulfide"), to(F.filter("near", lambda x: x["element"] != "S"))),
        "S8": when(is_("cos"), F.when(n_of("C") == 1, to(of("C"))).when(n_of("C") > 1, beyond(F.filter("near", lambda x: x["element"].isin("S", "O"))))),
        "S9": when(oxygen & (n_m >= 1) & (F.size(plain_c) == 1), to(plain_c)),
        "S10": when(oxygen & (n_m == 1) & (F.size(plain_c) == 2), to(metals())),
        "S11": when(oxygen & (n_m == 1) & (n_of("N") == 1), to(F.filter(of("N"), wide_n))),
        "S12": when(is_("nitroxyl"), to(of("O"))),
        "S13": when(is_element("N") & free("porphyrin") & (n_m == 1), to(metals())),
        "S14": when(is_element("S") & free("sulfide", "cos") & ~is_("sulphate"), to(metals())),
        "S15": when(is_element("P") & free("phosphite") & F.exists("near", lambda x: F.size(x["metals"]) > 0), to(F.filter("near", lambda x: ~x["metal"] & (x["n_plain"] > 1)))),
        "S16": when(is_element("B"), beyond(F.filter("near", lambda x: ~x["metal"]))),
        "S17": loose_ends(),
    }


def ligand_rules() -> dict[str, Column]:
    """Cuts between ligands and metal clusters."""
    oxygen = is_element("O")
    return {
        "L2": when(is_("sulphate"), beyond(of("O"))),
        "L3": when(is_element("P") & ~free("phosphite"), to(metals(True))),
        "L4": when(is_element("S") & ~free("sulfide"), to(metals(True))),
        "L5": when(is_element("C"), to(metals())),
        "L6": when(is_element("N") & free("porphyrin"), to(metals())),
        "L7": when(is_element("S") & free("sulfide"), to(metals())),
        "L8": when(oxygen & (n_of("C") == 1), to(metals())),
        "L9": when(oxygen & (n_of("N") == 1) & F.exists(of("N"), lambda x: x["n_c"] + x["n_s"] + x["n_n"] > 1), to(metals())),
        "L10": when(oxygen & (n_of("C") > 1), to(metals())),
        "L11": when(is_element("P") & free("phosphite"), beyond(F.filter("near", lambda x: ~x["metal"]))),
        "L12": loose_ends(),
    }


def layer_rules() -> dict[str, Column]:
    """Cuts of imine-linked layers: carbon of degree three with one nitrogen and one hydrogen."""
    return {"imine": when(is_element("C") & (F.size("near") == 3) & (n_of("N") == 1) & (n_of("H") == 1), to(of("N")))}


SCHEMES: dict[str, Callable[[], dict[str, Column]]] = {"sbu": unit_rules, "ligand_cluster": ligand_rules, "cof": layer_rules}


def cuts(marks: DataFrame, bonds: DataFrame, scheme: str) -> DataFrame:
    """(structure_id, rule, i, j, sx, sy, sz) of the bonds that a scheme's rules cut, each once for a rule and with every shift it has."""
    rules = SCHEMES[scheme]()
    found = F.array(*(F.struct(F.lit(name).alias("rule"), pairs.alias("pairs")) for name, pairs in rules.items()))
    rows = marks.select("structure_id", F.explode(found).alias("r")).select("structure_id", "r.rule", F.explode("r.pairs").alias("p")).select("structure_id", "rule", "p.i", "p.j").distinct()
    return rows.join(bonds.select("structure_id", "i", "j", "sx", "sy", "sz"), ["structure_id", "i", "j"]).select("structure_id", "rule", "i", "j", "sx", "sy", "sz")


def planar_porphyrin(around: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, atom_id) of metals with exactly four nitrogen neighbours, the places of which lie in a plane."""
    own = around.where(F.col("metal") & (n_of("N") == 4)).select("structure_id", "atom_id", F.explode(of("N")).alias("n"))
    place = atoms.select("structure_id", F.col("atom_id").alias("id"), F.array("x", "y", "z").alias("p"))
    met = own.select("structure_id", "atom_id", F.col("n.id").alias("id")).join(place, ["structure_id", "id"]).groupBy("structure_id", "atom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"]).alias("p"))
    return met.where(geometry.planar(*(F.col("p")[k] for k in range(4)))).select("structure_id", "atom_id")
