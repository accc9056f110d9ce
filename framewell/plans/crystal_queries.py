"""Queries that call the library's operators on crystals made from the driver's tables, each with its DuckDB oracle.

``points`` are parts in boxes, at places that doubles hold exactly; ``molecules``
are orders whose lines are atoms; ``stars`` are an atom for each part with
neighbours of chosen kinds; ``chains`` are orders whose lines follow each other.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions import elements, text
from framewell.operators import bonds, components, edges, nets, records, rules, stacking, topology, units
from framewell.sources import netlog, structures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register the decorated function under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nth(values: str, at: Column) -> Column:
    """A word of a list by its place from 0."""
    return F.element_at(F.array(*(F.lit(v) for v in values.split())), (at + 1).cast("int"))


def no_lattice() -> Column:
    return F.array().cast("array<struct<x:int,y:int,z:int>>")


def key(name: str) -> Column:
    return F.col(name).cast("string").alias("structure_id")


#: A line of an order for each number; numbers are repeated in the table.
LINE = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)"


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))


# ---------------------------------------------------------------- points

KINDS, SIDE = "Zn O O N C C H S", 16.0
POINTS = f"""points AS (SELECT CAST(p_size AS VARCHAR) AS structure_id, CAST(p_partkey AS INTEGER) AS atom_id, {KINDS.split()}[p_partkey % 8 + 1] AS element,
  {", ".join(f"CAST(((p_partkey * 2654435761) >> {b}) % 64 AS DOUBLE) / 64 AS f{x}" for b, x in ((8, "x"), (14, "y"), (20, "z")))} FROM part),
facts AS (SELECT * FROM (VALUES ('Zn', 1.22::DOUBLE, 65.38::DOUBLE, true), ('O', 0.66, 15.999, false), ('N', 0.71, 14.007, false), ('C', 0.76, 12.011, false), ('H', 0.31, 1.008, false), ('S', 1.05, 32.06, false)) f(element, r, mass, metal)),
own AS (SELECT points.*, r, metal FROM points JOIN facts USING (element)),
steps AS (SELECT CAST(x AS INTEGER) AS s FROM unnest([-1, 0, 1]) u(x)),
met AS (SELECT a.structure_id, a.atom_id AS i, b.atom_id AS j, x.s AS sx, y.s AS sy, z.s AS sz, a.element AS ei, b.element AS ej, a.metal AS mi, b.metal AS mj, a.r + b.r AS reach,
  (b.fx + x.s - a.fx) * {SIDE}::DOUBLE AS dx, (b.fy + y.s - a.fy) * {SIDE}::DOUBLE AS dy, (b.fz + z.s - a.fz) * {SIDE}::DOUBLE AS dz FROM own a JOIN own b USING (structure_id), steps x, steps y, steps z),
bonds AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM met
  WHERE sqrt(dx * dx + dy * dy + dz * dz) < reach + 0.6::DOUBLE AND NOT (i = j AND sx = 0 AND sy = 0 AND sz = 0))"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as atoms of boxes of one size each."""
    k = F.col("p_partkey")
    place = [(F.pmod(F.shiftright(k * 2654435761, b), F.lit(64)) / 64.0).cast("double").alias(f"f{x}") for b, x in ((8, "x"), (14, "y"), (20, "z"))]
    cell = F.array(*(F.array(*(F.lit(SIDE if r == c else 0.0) for c in range(3))) for r in range(3)))
    rows = table(spark, folder, "part").select(key("p_size"), k.cast("int").alias("atom_id"), nth(KINDS, k % 8).alias("element"), *place, cell.alias("cell"), F.array(*[F.lit(True)] * 3).alias("pbc"))
    return rows.select("*", *((F.col(f"f{x}") * SIDE).alias(x) for x in "xyz"))


@query(f"WITH {POINTS} SELECT structure_id, i, j, sx, sy, sz, dist FROM bonds")
def radius_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """Bonds of atoms by the sum of their radii, across the faces of the cell."""
    return bonds.perceive(points(spark, folder))


@query(f"WITH {POINTS} SELECT structure_id, NOT bool_or(coalesce(b.dist < 1.0::DOUBLE AND (ei = 'H') = (ej = 'H') AND i < j, false)) AS clear FROM points LEFT JOIN bonds b USING (structure_id) GROUP BY structure_id")
def overlap_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Whether no bonded atoms are too near, unless one is hydrogen."""
    return bonds.crowded(points(spark, folder), 1.0)


@query(f"""WITH {POINTS}, o AS (SELECT *, CAST(dist < reach - 0::DOUBLE + 0.2::DOUBLE AS INTEGER) + CAST(dist < reach - 2 * 0.15::DOUBLE + 0.2::DOUBLE AS INTEGER) + CAST(dist < reach - 2 * 0.3::DOUBLE + 0.2::DOUBLE AS INTEGER) AS n FROM bonds)
SELECT structure_id, i, j, sx, sy, sz, CAST(CASE WHEN ei = 'H' OR ej = 'H' THEN least(n, 1) ELSE n END AS DOUBLE) AS bond_order FROM o WHERE n > 0 AND NOT (mi AND ej = 'H') AND NOT (ei = 'H' AND mj)""")
def bond_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of covalent bonds by their length."""
    return bonds.orders_of(points(spark, folder))


@query(f"WITH {POINTS} SELECT structure_id, count(*) AS atoms, to_json(list(element ORDER BY atom_id))::VARCHAR AS labels FROM points GROUP BY structure_id")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the JSON text of a structure."""
    made = structures.json_text(points(spark, folder))
    return made.select("structure_id", F.get_json_object("text", "$.n_atoms").cast("long").alias("atoms"), F.get_json_object("text", "$.labels").alias("labels"))


@query(f"WITH {POINTS} SELECT element, any_value(r) AS radius, any_value(mass) AS mass, any_value(metal) AS metal, false AS alkali, count(*) AS n FROM points JOIN facts USING (element) GROUP BY element")
def element_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Radius, mass and kind of the elements that occur."""
    e = F.col("element")
    return points(spark, folder).groupBy("element").agg(F.count("*").alias("n")).select("element", elements.radius(e).alias("radius"), elements.mass(e).alias("mass"), elements.is_metal(e).alias("metal"), elements.is_alkali(e).alias("alkali"), "n")


@query("""WITH p AS (SELECT p_brand || '-' || p_size AS structure_id, p_partkey, CAST((p_partkey * 2654435761 >> 8) % 64 AS DOUBLE) / 4 AS x, CAST((p_partkey * 2654435761 >> 14) % 64 AS DOUBLE) / 4 AS y, CAST((p_partkey * 2654435761 >> 20) % 64 AS DOUBLE) / 4 AS z FROM part),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY p_partkey) AS INTEGER) AS k, count(*) OVER (PARTITION BY structure_id) AS n FROM p)
SELECT structure_id, a.k AS i, b.k AS j, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, abs(a.z - b.z) AS dz FROM n a JOIN n b USING (structure_id) WHERE a.k < a.n AND b.k > 1 AND a.k <> b.k""")
def layer_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets between the centres of all layers of a structure."""
    k = F.col("p_partkey")
    place = [(F.pmod(F.shiftright(k * 2654435761, b), F.lit(64)) / 4.0).cast("double").alias(x) for b, x in ((8, "x"), (14, "y"), (20, "z"))]
    own = table(spark, folder, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("structure_id"), k.cast("int").alias("atom_id"), k.cast("int").alias("comp_id"), *place)
    return stacking.pairs(own.select("structure_id", "atom_id", "comp_id"), own.drop("comp_id"))


# ---------------------------------------------------------------- molecules

ATOMS = "Zn O C O N C S H P B"
#: At most three nitrogens to a molecule, so that none has a porphyrin.
MOLECULES = f"""{LINE}, am AS (SELECT CAST(l_orderkey AS VARCHAR) AS s, l_linenumber AS a, l_suppkey % 2 AS side, l_orderkey AS k, l_partkey AS p,
  CASE WHEN l_partkey % 10 = 4 AND l_linenumber > 3 THEN 'Cu' ELSE {ATOMS.split()}[l_partkey % 10 + 1] END AS e FROM lines),
bd AS (SELECT x.s, x.a AS i, y.a AS j, CAST(x.side - y.side AS INTEGER) AS sx, x.e AS ei, y.e AS ej, y.e IN ('Zn', 'Cu') AS mj FROM am x JOIN am y ON x.s = y.s AND x.a <> y.a AND (x.p + y.p) % 3 <> 0),
n AS (SELECT s, i, count(*) FILTER (mj) AS nm, {", ".join(f"count(*) FILTER (ej = '{e}') AS n{e}" for e in "CNSOPHB")}, count(*) FILTER (NOT mj) AS plain, count(*) AS deg FROM bd GROUP BY s, i),
f AS (SELECT bd.*, coalesce(m.nm, 0) AS jm, m.nC AS jC, m.nN AS jN, m.nS AS jS, m.plain AS jplain FROM bd JOIN n m ON m.s = bd.s AND m.i = bd.j),
mm AS (SELECT s, i, bool_or(ej = 'O' AND jm > 0) AS mO, bool_or(ej = 'S' AND jm > 0) AS mS, bool_or(ej = 'P' AND jm > 0) AS mP, bool_or(jm > 0) AS mAny FROM f GROUP BY s, i),
x AS (SELECT am.s, am.a AS i, am.e, am.e IN ('Zn', 'Cu') AS m, n.* EXCLUDE (s, i), mO, mS, mP, mAny,
  e = 'C' AND nO = 2 AND mO AS carb, e = 'N' AND nO = 1 AND mO AS nitr, e = 'S' AND mO AND nC >= 1 AS sulph, e = 'C' AND nS = 2 AND mS AS sulf, e = 'C' AND nP = 2 AND mP AS phos, e = 'C' AND deg = 3 AND nS + nO = 2 AND mS AND mO AS cos
  FROM am JOIN n ON n.s = am.s AND n.i = am.a JOIN mm ON mm.s = am.s AND mm.i = am.a),
o AS (SELECT f.s, f.j, bool_or(x.carb AND f.ej = 'O') AS oc, bool_or(x.nitr AND f.ej = 'O') AS onit, bool_or(x.sulph AND f.ej = 'O') AS os, bool_or(x.sulf AND f.ej = 'S') AS osf, bool_or(x.phos AND f.ej = 'P') AS op, bool_or(x.cos AND f.ej IN ('S', 'O')) AS ocos FROM f JOIN x ON x.s = f.s AND x.i = f.i GROUP BY f.s, f.j),
pc AS (SELECT f.s, f.i, count(*) AS npc FROM f JOIN x ON x.s = f.s AND x.i = f.j WHERE f.ej = 'C' AND NOT x.carb GROUP BY f.s, f.i),
c AS (SELECT x.*, oc, onit, os, osf, op, ocos, coalesce(npc, 0) AS npc, e = 'O' AND NOT (oc OR os OR ocos OR onit) AS ox FROM x JOIN o ON o.s = x.s AND o.j = x.i LEFT JOIN pc ON pc.s = x.s AND pc.i = x.i),
t AS (SELECT c.*, f.j, f.ej, f.mj, f.jC, f.jN, f.jS, f.jplain, xj.carb AS jcarb FROM c JOIN f ON f.s = c.s AND f.i = c.i JOIN x xj ON xj.s = f.s AND xj.i = f.j),
far AS (SELECT t.* EXCLUDE (j), t.j AS mid, b.j AS k FROM t JOIN bd b ON b.s = t.s AND b.i = t.j AND b.mj)"""
TO = {
    "S1": "carb AND ((ej = 'C' AND nC = 1) OR (ej = 'N' AND nN = 1) OR (ej = 'S' AND nS = 1))",
    "S3": "e = 'C' AND mj", "S4": "sulph AND nC = 1 AND ej = 'C'", "S6": "phos AND ej <> 'P'", "S7": "sulf AND ej <> 'S'", "S8": "cos AND nC = 1 AND ej = 'C'",
    "S9": "ox AND nm >= 1 AND npc = 1 AND ej = 'C' AND NOT jcarb", "S10": "ox AND nm = 1 AND npc = 2 AND mj",
    "S11": "ox AND nm = 1 AND nN = 1 AND ej = 'N' AND CASE WHEN jC > 0 THEN jC > 1 WHEN jN > 0 THEN jN > 1 ELSE jS > 1 END",
    "S12": "nitr AND ej = 'O'", "S13": "e = 'N' AND nm = 1 AND mj", "S14": "e = 'S' AND NOT osf AND NOT ocos AND NOT sulph AND mj",
    "S15": "e = 'P' AND NOT op AND mAny AND NOT mj AND jplain > 1", "S17": "m AND ej IN ('H', 'C')",
    "L3": "e = 'P' AND op AND mj", "L4": "e = 'S' AND osf AND mj", "L5": "e = 'C' AND mj", "L6": "e = 'N' AND mj", "L7": "e = 'S' AND NOT osf AND mj", "L8": "e = 'O' AND nC = 1 AND mj",
    "L9": "e = 'O' AND nN = 1 AND mj AND EXISTS (SELECT 1 FROM t u WHERE u.s = t.s AND u.i = t.i AND u.ej = 'N' AND u.jC + u.jS + u.jN > 1)", "L10": "e = 'O' AND nC > 1 AND mj", "L12": "m AND ej IN ('H', 'C')",
    "imine": "e = 'C' AND deg = 3 AND nN = 1 AND nH = 1 AND ej = 'N'",
}
BEYOND = {"S5": "sulph AND nC > 1 AND ej = 'O'", "S16": "e = 'B' AND NOT mj", "L2": "sulph AND ej = 'O'", "L11": "e = 'P' AND NOT op AND NOT mj"}


def molecules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as atoms, and bonds between their lines."""
    own = lines_of(spark, folder).select(key("l_orderkey"), F.col("l_linenumber").cast("int").alias("atom_id"), "l_partkey", "l_suppkey")
    kind = F.when((F.col("l_partkey") % 10 == 4) & (F.col("atom_id") > 3), "Cu").otherwise(nth(ATOMS, F.col("l_partkey") % 10))
    a = own.select("structure_id", F.col("atom_id").alias("i"), F.col("l_partkey").alias("p"), (F.col("l_suppkey") % 2).alias("m"))
    b = a.withColumnsRenamed({"i": "j", "p": "q", "m": "n"})
    met = a.join(b, "structure_id").where("i <> j AND (p + q) % 3 <> 0")
    return own.select("structure_id", "atom_id", kind.alias("element")), met.select("structure_id", "i", "j", (F.col("m") - F.col("n")).cast("int").alias("sx"), F.lit(0).alias("sy"), F.lit(0).alias("sz"), F.lit(1.5).alias("dist"))


def cut_sql(prefix: str) -> str:
    parts = [f"SELECT s, '{r}' AS rule, i, j FROM t WHERE {w}" for r, w in TO.items() if r.startswith(prefix)] + [f"SELECT s, '{r}', mid, k FROM far WHERE {w}" for r, w in BEYOND.items() if r.startswith(prefix)]
    return f"WITH {MOLECULES}, r AS ({' UNION '.join(parts)}) SELECT r.s AS structure_id, rule, r.i, r.j, bd.sx, 0 AS sy, 0 AS sz FROM r JOIN bd ON bd.s = r.s AND bd.i = r.i AND bd.j = r.j"


def cuts(spark: SparkSession, folder: str, scheme: str) -> DataFrame:
    own, linked = molecules(spark, folder)
    return rules.cuts(rules.marked(own, linked), linked, scheme)


@query(cut_sql("S"))
def unit_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Bonds that each rule for secondary building units cuts."""
    return cuts(spark, folder, "sbu")


@query(cut_sql("L"))
def ligand_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Bonds that each rule between ligands and metal clusters cuts."""
    return cuts(spark, folder, "ligand_cluster")


@query(cut_sql("imine"))
def layer_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Bonds that the rule for layers cuts."""
    return cuts(spark, folder, "cof")


@query(f"""WITH {MOLECULES} SELECT structure_id, element, string_agg(ej, ' ' ORDER BY j) AS neighbours, CAST(count(ej) AS INTEGER) AS degree
FROM (SELECT am.s AS structure_id, am.e AS element, am.a, row_number() OVER (PARTITION BY am.s, am.e ORDER BY am.a) AS r FROM am WHERE am.e IN ('Zn', 'Cu')) q
LEFT JOIN bd ON bd.s = structure_id AND bd.i = q.a WHERE r = 1 GROUP BY structure_id, element""")
def first_last_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of the first metal atom of each element."""
    found = units.environment(rules.marked(*molecules(spark, folder)))
    return found.select("structure_id", "element", F.nullif(F.array_join("neighbours", " "), F.lit("")).alias("neighbours"), "degree")


#: Components of a molecule: every third line, the first of them being the cluster.
MEMBERS = f"""{MOLECULES}, mb AS (SELECT s, a, a % 3 AS c, CAST(p % 3 - 1 AS INTEGER) AS ix, CAST(k % 2 AS INTEGER) AS iy FROM am)"""


def members(spark: SparkSession, folder: str) -> SimpleNamespace:
    """Cuts between components, members and regions; the clusters of even orders repeat every second cell."""
    own, linked = molecules(spark, folder)
    lines = lines_of(spark, folder).select(key("l_orderkey"), F.col("l_linenumber").cast("int").alias("atom_id"), (F.col("l_linenumber") % 3).cast("int").alias("comp_id"), (F.col("l_partkey") % 3 - 1).cast("int").alias("ix"), (F.col("l_orderkey") % 2).cast("int").alias("iy"), F.lit(0).alias("iz"))
    two = F.array(F.struct(F.lit(2).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z")))
    held = lines.withColumn("lattice", F.when((F.col("comp_id") == 0) & (F.col("iy") == 0), two).otherwise(no_lattice()))
    apart = linked.where("i % 3 <> j % 3")
    regions = held.select("structure_id", "comp_id", (F.col("comp_id") == 0).alias("has")).distinct()
    return SimpleNamespace(cuts=apart, members=held, regions=regions, bonds=linked, atoms=own)


@query(f"""WITH {MEMBERS} SELECT structure_id, cluster, ligand, sx, sy, 0 AS sz, CAST(count(*) AS INTEGER) AS denticity FROM (
  SELECT bd.s AS structure_id, 0 AS cluster, u.c AS ligand, CASE WHEN t.iy = 0 THEN ((t.ix - u.ix + bd.sx) % 2 + 2) % 2 ELSE t.ix - u.ix + bd.sx END AS sx, t.iy - u.iy AS sy
  FROM bd JOIN mb t ON t.s = bd.s AND t.a = bd.i JOIN mb u ON u.s = bd.s AND u.a = bd.j WHERE t.c = 0 AND u.c <> 0) GROUP BY ALL""")
def incidence_denticity(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts of clusters with ligands, counted for each pair and cell modulo the cluster's lattice."""
    cut = members(spark, folder)
    return nets.incidences(cut, cut.bonds)


@query(f"""WITH {MEMBERS} SELECT bd.s AS structure_id, bd.i, bd.j, t.c AS comp_i, u.c AS comp_j FROM (SELECT DISTINCT s, i, j FROM bd) bd JOIN mb t ON t.s = bd.s AND t.a = bd.i JOIN mb u ON u.s = bd.s AND u.a = bd.j WHERE bd.i < bd.j AND t.c <> u.c AND (t.c = 0) <> (u.c = 0)""")
def genuine_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Cut pairs that are bonds and join a cluster's atom to a ligand's."""
    cut = members(spark, folder)
    return nets.contact_cuts(cut, cut.bonds).select("structure_id", "i", "j", "comp_i", "comp_j")


@query(f"""WITH {MEMBERS}, e AS (SELECT bd.s AS structure_id, t.c AS u, w.c AS v, t.ix - w.ix + bd.sx AS sx, t.iy - w.iy AS sy FROM bd JOIN mb t ON t.s = bd.s AND t.a = bd.i JOIN mb w ON w.s = bd.s AND w.a = bd.j WHERE t.c <> w.c)
SELECT DISTINCT structure_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, sx, sy, 0 AS sz FROM e WHERE u < v""")
def unit_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the components that a cut leaves."""
    return units.separated(members(spark, folder))


@query(f"""WITH {MEMBERS}, g AS (SELECT * FROM (VALUES ('Zn', 653800), ('O', 159990), ('C', 120110), ('N', 140070), ('S', 320600), ('H', 10080), ('P', 309740), ('B', 108100), ('Cu', 635460)) g(e, w)),
w AS (SELECT am.s, am.a, c, sum(w) OVER (PARTITION BY am.s, c) AS mass, (am.k + c) % 4 % 2 = 1 AS linked FROM am JOIN mb ON mb.s = am.s AND mb.a = am.a JOIN g USING (e)),
r AS (SELECT *, bool_or(linked) OVER (PARTITION BY s) AS held, first_value(c) OVER (PARTITION BY s ORDER BY mass DESC, c) AS top FROM w)
SELECT s AS structure_id, a AS atom_id FROM r WHERE CASE WHEN held THEN linked ELSE c = top END""")
def guests_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Atoms of the components that stay linked in a doubled cell, else of the heaviest."""
    cut = members(spark, folder)
    x = ((F.col("structure_id").cast("long") + F.col("comp_id")) % 4).cast("int")
    lattice = F.when(x > 0, F.array(F.struct(x.alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z")))).otherwise(no_lattice())
    return units.framework_atoms(cut.atoms, cut.members.withColumn("lattice", lattice).select("structure_id", "atom_id", "comp_id", "lattice"))


# ---------------------------------------------------------------- stars and chains

STAR = "s AS (SELECT CAST(p_partkey AS VARCHAR) AS structure_id, p_partkey % 3 AS e, p_partkey // 3 % 5 AS nm, [0, 4, 5, 6, 8][p_partkey // 15 % 5 + 1] AS no, [0, 0, 10][p_partkey // 75 % 3 + 1] AS nc, p_partkey % 7 = 0 AS rod FROM part)"


@query(f"""WITH {STAR} SELECT structure_id, 0 AS comp_id, CASE WHEN rod THEN 'rodlike' WHEN nm = 1 AND no = 4 AND nm + no + nc IN (5, 6) THEN 'paddlewheel' WHEN e = 0 AND no = 5 AND nm = 1 THEN 'paddlewheel_with_water'
  WHEN nm = 4 AND no IN (6, 8) AND nm + no + nc IN (10, 12) THEN 'UIO66_sbu' WHEN e = 0 AND no = 8 AND nm = 0 THEN 'MOF32_sbu' WHEN e = 1 AND nm = 4 AND nm + no + nc = 4 THEN 'IRMOF_sbu' WHEN nc >= 10 THEN 'ferrocenelike' ELSE 'still checking!' END AS sbu_type FROM s""")
def unit_type_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The first pattern of a building unit that a star has."""
    k = F.col("p_partkey")
    n = lambda e, many: F.array_repeat(F.lit(e), many.cast("int"))
    names = F.concat(F.array(nth("Zn O C", k % 3)), n("Zn", F.floor(k / 3) % 5), n("O", nth("0 4 5 6 8", F.floor(k / 15) % 5)), n("C", nth("0 0 10", F.floor(k / 75) % 3)))
    one = F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z")))
    own = table(spark, folder, "part").select(key("p_partkey"), F.posexplode(names).alias("atom_id", "element"), F.lit(0).alias("comp_id"), F.when(k % 7 == 0, one).otherwise(no_lattice()).alias("lattice"))
    arms = own.where("atom_id > 0").select("structure_id", F.lit(0).alias("i"), F.col("atom_id").alias("j"), *(F.lit(0).alias(s) for s in edges.SHIFT))
    return units.unit_types(own, edges.both_ways(arms, "i", "j"))


CHAIN = f"""{LINE}, l AS (SELECT CAST(l_orderkey AS VARCHAR) AS s, l_linenumber AS a, CAST(l_partkey % 3 - 1 AS INTEGER) AS dx, CAST(l_suppkey % 2 AS INTEGER) AS dy, CAST(l_partkey % 4 AS INTEGER) AS p,
  lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM lines)"""


def chain(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as chains of their lines; the last atom is bonded to its own image some cells away."""
    own = lines_of(spark, folder).select(key("l_orderkey"), F.col("l_linenumber").cast("int").alias("atom_id"), (F.col("l_partkey") % 3 - 1).cast("int").alias("sx"), (F.col("l_suppkey") % 2).cast("int").alias("sy"), (F.col("l_partkey") % 4).cast("int").alias("p"))
    lines = own.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", "sx", "sy", "p"))).alias("l"))
    steps = F.transform("l", lambda a, k: F.struct(a["atom_id"].alias("i"), F.coalesce(F.get("l", k + 1)["atom_id"], a["atom_id"]).alias("j"), F.when(k + 1 < F.size("l"), a["sx"]).otherwise(a["p"]).alias("sx"), F.when(k + 1 < F.size("l"), a["sy"]).otherwise(0).alias("sy"), F.lit(0).alias("sz")))
    return own.select("structure_id", "atom_id"), edges.both_ways(lines.select("structure_id", F.explode(steps).alias("e")).select("structure_id", "e.*").where("NOT (i = j AND sx = 0)"), "i", "j")


@query(f"""WITH {CHAIN} SELECT s AS structure_id, a AS atom_id, first AS comp_id, coalesce(CAST(sum(dx) OVER w AS INTEGER), 0) AS ix, coalesce(CAST(sum(dy) OVER w AS INTEGER), 0) AS iy, 0 AS iz,
  nullif(sum(CASE WHEN b IS NULL THEN p ELSE 0 END) OVER (PARTITION BY s), 0)::INTEGER AS period FROM l WINDOW w AS (PARTITION BY s ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def unwrapped_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Component, image and lattice of each atom of a chain."""
    found = components.unwrapped(*chain(spark, folder))
    return found.select("structure_id", "atom_id", "comp_id", "ix", "iy", "iz", F.get("lattice", F.lit(0))["x"].alias("period"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS structure_id, 0 AS ring, string_agg(DISTINCT l_linenumber, ' ' ORDER BY l_linenumber) AS atoms FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 3")
def ring_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Rings of the orders' lines in a circle."""
    own, _ = chain(spark, folder)
    lines = own.groupBy("structure_id").agg(F.array_sort(F.collect_list("atom_id")).alias("l")).where("size(l) >= 2")
    steps = F.transform("l", lambda a, k: F.struct(a.alias("i"), F.coalesce(F.get("l", k + 1), F.col("l")[0]).alias("j")))
    around = lines.select("structure_id", F.explode(steps).alias("e")).select("structure_id", "e.*", *(F.lit(0).alias(s) for s in edges.SHIFT))
    return components.rings(own, edges.both_ways(around, "i", "j").distinct()).select("structure_id", "ring", F.array_join("atoms", " ").alias("atoms"))


# ---------------------------------------------------------------- nets


@query("""WITH e AS (SELECT l_returnflag AS structure_id, CAST(l_suppkey % 7 AS INTEGER) AS u, CAST(l_partkey % 7 AS INTEGER) AS v, CAST(l_linenumber % 3 - 1 AS INTEGER) AS sx, CAST(l_orderkey % 2 AS INTEGER) AS sy FROM lineitem)
SELECT DISTINCT structure_id, CASE WHEN k THEN u ELSE v END AS u, CASE WHEN k THEN v ELSE u END AS v, CASE WHEN k THEN sx ELSE -sx END AS sx, CASE WHEN k THEN sy ELSE -sy END AS sy, 0 AS sz
FROM (SELECT *, (u, sx, sy) <= (v, -sx, -sy) AS k FROM e) WHERE NOT (u = v AND sx = 0 AND sy = 0)""")
def net_text_read_again(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of nets that were written as text."""
    own = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("structure_id"), (F.col("l_suppkey") % 7).cast("int").alias("u"), (F.col("l_partkey") % 7).cast("int").alias("v"), (F.col("l_linenumber") % 3 - 1).cast("int").alias("sx"), (F.col("l_orderkey") % 2).cast("int").alias("sy"), F.lit(0).alias("sz"))
    return nets.net_edges(nets.net_text(edges.canonical(own)).withColumnRenamed("cgd", "text"))


@query("""SELECT n_name AS structure_id, ['pcu', 'sql', 'UNKNOWN'][n_nationkey % 3 + 1] AS topology, CAST(3 - n_nationkey % 3 AS INTEGER) AS dimension, [1561.0, 221.0, 21.0][n_nationkey % 3 + 1]::DOUBLE AS td10 FROM nation""")
def named_nets(spark: SparkSession, folder: str) -> DataFrame:
    """Name, dimension and TD10 of nets of one node that is linked along one, two or three axes."""
    k = F.col("n_nationkey") % 3
    loops = F.slice(F.array(*(F.struct(*(F.lit(int(x == y)).alias(f"s{y}") for y in "xyz")) for x in "xyz")), F.lit(1), 3 - k)
    own = table(spark, folder, "nation").select(F.col("n_name").alias("structure_id"), F.lit(0).alias("u"), F.lit(0).alias("v"), F.explode(loops).alias("e")).select("structure_id", "u", "v", "e.*")
    return topology.described(edges.canonical(own), "all_node").select("structure_id", "topology", "dimension", "td10")


@query("SELECT o_custkey AS structure_id, o_orderkey AS comp_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) - 1 AS INTEGER) AS node FROM orders")
def renumber_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes numbered from 0 within their structure, by kind and then id."""
    own = table(spark, folder, "orders").select(F.col("o_custkey").alias("structure_id"), F.col("o_orderkey").alias("comp_id"), "o_orderpriority")
    return nets.numbered(own, ["o_orderpriority", "comp_id"]).drop("o_orderpriority")


# ---------------------------------------------------------------- output of a net tool

#: One component for each line of an order; some have no name, and some orders' output tells of an error.
NAMES = "pcu fcu dia tbo-a"
LINES = f"""{LINE}, o AS (SELECT CAST(l_orderkey AS VARCHAR) AS s, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS component, CASE WHEN l_partkey % 5 > 0 THEN {NAMES.split()}[l_suppkey % 4 // 2 + 1] END AS name,
  CAST(l_linenumber % 2 + 2 AS INTEGER) AS dimension, CAST(l_partkey AS DOUBLE) AS td10, l_partkey, l_suppkey, l_linenumber, l_orderkey % 3 = 0 AS bad FROM lines)"""


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(structure_id, stdout): text as a net identification tool writes it."""
    p, s, n = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    name = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("   Name: "), nth(NAMES, F.floor(F.col("l_suppkey") % 4 / 2)), F.lit("\n"))).otherwise("")
    block = F.concat(
        F.lit("\n   dimension = "), (F.col("l_linenumber") % 2 + 2).cast("string"), F.lit("\n   Given space group is P1.\n   Ideal space group is Fm-3m.\n   Relaxed cell parameters:\n       a = "), p, F.lit(".5, b = "), s, F.lit(".25, c = "), n,
        F.lit("\n       alpha = 90.0, beta = 60.5, gamma = 120\n   Relaxed positions:\n      Node 1:    0.5 -0.25 "), n, F.lit("\n      Node 2:    0 0 0\n   Coordination sequences:\n      Node 1:    "), s, F.lit(" 18 38\n      Node 2:    4 12 24\n   Edges:\n      0 0 0 <-> 0.5 -0.25 "), n,
        F.lit("\n   Edge centers:\n      0.25 -0.125 0.5\n   TD10 = "), p, F.lit("\n"), name, F.when(F.col("l_orderkey") % 3 == 0, "   an error occurred\n").otherwise(""),
    )
    rows = lines_of(spark, folder).groupBy(key("l_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("block")))).alias("b"))
    return rows.select("structure_id", F.concat(F.lit("Data file\n"), F.array_join(F.transform("b", lambda x, k: F.concat(F.lit("Processing component "), (k + 1).cast("string"), F.lit(":"), x["block"])), "")).alias("stdout"))


@query(f"""WITH {LINES} SELECT s AS structure_id, component, name, dimension, td10, 'P1' AS given, 'Fm-3m' AS ideal, l_partkey + 0.5::DOUBLE AS a, l_suppkey + 0.25::DOUBLE AS b, CAST(l_linenumber AS DOUBLE) AS c, 60.5::DOUBLE AS beta, '1 2' AS nodes, CAST(l_linenumber AS DOUBLE) AS z,
  2 AS ends, 0.5::DOUBLE AS middle, CAST(l_suppkey AS INTEGER) AS coordination FROM o""")
def regex_parse(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of each component's text."""
    found = netlog.parsed(outputs(spark, folder))
    return found.select(
        "structure_id", "component", "name", "dimension", "td10", "space_groups.given", "space_groups.ideal", F.col("cell")[0].alias("a"), F.col("cell")[1].alias("b"), F.col("cell")[2].alias("c"), F.col("cell")[4].alias("beta"),
        F.array_join(F.transform("nodes", lambda x: x["node"]), " ").alias("nodes"), F.col("nodes")[0]["place"][2].alias("z"), F.size(F.col("edges")[0]).alias("ends"), F.col("centres")[0][2].alias("middle"), F.col("coordination")[0].alias("coordination"),
    )


@query(f"WITH {LINES} SELECT s AS structure_id, component, name, 'Fm-3m' AS ideal FROM o")
def split_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered blocks of each text with what one can read in them."""
    b = F.col("block")
    return netlog.components(outputs(spark, folder)).select("structure_id", "component", netlog.name(b).alias("name"), netlog.space_groups(b)["ideal"].alias("ideal"))


@query(f"""WITH {LINES} SELECT s AS structure_id, CASE WHEN count(name) = 0 THEN CASE WHEN bool_or(bad) THEN 'ERROR' ELSE 'UNKNOWN' END WHEN count(DISTINCT name) = 1 AND count(name) = count(*) THEN min(name) ELSE 'MISMATCH' END AS topology FROM o GROUP BY s""")
def topology_of_output(spark: SparkSession, folder: str) -> DataFrame:
    """The one name of all components, or a word that tells why there is none."""
    return netlog.topologies(outputs(spark, folder))


@query("""SELECT structure_id, component, n_edges, n_nodes FROM (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY n_edges DESC, n_nodes DESC, component) AS r FROM (
  SELECT l_suppkey AS structure_id, l_orderkey AS component, CAST(count(*) AS INTEGER) AS n_edges, CAST(count(DISTINCT l_partkey) AS INTEGER) AS n_nodes FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def best_component(spark: SparkSession, folder: str) -> DataFrame:
    """The component of most edges, then nodes, of each structure."""
    own = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("structure_id"), F.col("l_orderkey").alias("component")).agg(F.collect_list("l_linenumber").alias("edges"), F.collect_set("l_partkey").alias("nodes"))
    return netlog.best(own).select("structure_id", "component", F.size("edges").alias("n_edges"), F.size("nodes").alias("n_nodes"))


# ---------------------------------------------------------------- records


@query("""SELECT d.doc_id, k.name FROM documents d LEFT JOIN (
  SELECT doc_id, arg_min(n_name, ord) AS name FROM (
    SELECT doc_id, 1 AS ord, n_name FROM documents JOIN nation ON n_name = upper(source)
    UNION ALL SELECT doc_id, 2, n_name FROM documents JOIN nation ON n_nationkey = n_chars % 40
    UNION ALL SELECT doc_id, 3, n_name FROM documents JOIN nation ON n_nationkey = doc_id % 30) GROUP BY doc_id) k USING (doc_id)""")
def first_hit_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The name under the first of three keys that a dictionary has."""
    keys = F.array(F.upper("source"), (F.col("n_chars") % 40).cast("string"), (F.col("doc_id") % 30).cast("string"))
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    return records.first_hit(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), "doc_id", keys, names.unionByName(names.select(F.col("name").alias("key"), "name")))


@query("""SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Stored values, computed where there are none."""
    own = table(spark, folder, "documents").select("doc_id", "n_chars")
    held = table(spark, folder, "labels").select("doc_id", "quality")
    return records.filled(own, held, "doc_id", "quality", F.when(F.col("n_chars") > 500, 1).otherwise(0)).select("doc_id", "quality")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def unique_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records without their bulky columns, each once."""
    return records.unique(table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey"), ["l_orderkey"])


@query(r"""SELECT page_id, string_split(regexp_extract(url, '([^/]*)$', 1), '.')[1] AS base, contains(upper(html), 'PERIODIC_GRAPH') OR contains(upper(html), 'CRYSTAL') AS net, to_json(url)::VARCHAR AS quoted FROM pages""")
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Base name, kind and JSON form of texts."""
    return table(spark, folder, "pages").select("page_id", text.base_name(F.col("url")).alias("base"), text.is_net_text(F.col("html")).alias("net"), text.quoted(F.col("url")).alias("quoted"))
