"""Queries that run whole analyses on frameworks made from the driver's tables, and that write, read and hash records, each with its DuckDB oracle.

A nation is a crystal: a metal with linkers N-C-C-N along each axis, repeated one to
three times along c, every second one with a molecule in its pore. Nothing but the
cell differs, so the answers are known for any number of nations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewell.functions import geometry, numbers, text
from framewell.operators import edges, nets, units
from framewell.plans.crystal_queries import LINE, LINES, lines_of, outputs, points, table
from framewell.plans.framework import Framework
from framewell.sources import netlog, structures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register the decorated function under its own name, with its oracle."""

    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# ---------------------------------------------------------------- frameworks

SIDE = 8.0
#: Sites of a cell: elements with their distances from the metal along each axis.
LINKER = [("N", 2.0), ("C", 3.3), ("C", 4.7), ("N", 6.0)]
MADE = "made AS (SELECT n_name AS structure_id, CAST(n_nationkey % 3 + 1 AS BIGINT) AS times, n_nationkey % 2 = 1 AS guest FROM nation)"


def frameworks(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed structures of the nations' CIF texts."""
    times, guest = (F.col("n_nationkey") % 3 + 1).cast("int"), F.col("n_nationkey") % 2 == 1
    sites = [("Zn", (0.0, 0.0, 0.0))] + [(s, tuple(d / SIDE if axis == x else 0.0 for x in range(3))) for axis in range(3) for s, d in LINKER]
    pore = [("C", (0.5, 0.5, 0.5)), ("O", (0.5 + 1.4 / SIDE, 0.5, 0.5))]

    def lines(listed: list, k: Column) -> Column:
        return F.array(*(F.format_string("%s %s %.6f %.6f %.6f", F.lit(s), F.lit(s), F.lit(x), F.lit(y), (F.lit(z) + k) / times) for s, (x, y, z) in listed))

    own = F.flatten(F.transform(F.sequence(F.lit(0), times - 1), lambda k: lines(sites, k)))
    every = F.concat(own, F.when(guest, lines(pore, F.lit(0))).otherwise(F.array().cast("array<string>")))
    head = F.format_string("data_made\n_cell_length_a 8\n_cell_length_b 8\n_cell_length_c %d\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\nloop_\n", times * int(SIDE))
    columns = "".join(f"_atom_site_{c}\n" for c in ("type_symbol", "label", "fract_x", "fract_y", "fract_z"))
    return structures.parse(table(spark, folder, "nation").select(F.col("n_name").alias("structure_id"), F.concat("n_name", F.lit(".cif")).alias("source"), F.concat(head, F.lit(columns), F.array_join(every, "\n"), F.lit("\n")).alias("text")))


@query(f"WITH {MADE} SELECT structure_id, 13 * times AS kept, CAST(CASE WHEN guest THEN 2 ELSE 0 END AS BIGINT) AS gone FROM made")
def framework_guests(spark: SparkSession, folder: str) -> DataFrame:
    """How many atoms of each crystal stay when its guests go."""
    made = Framework(frameworks(spark, folder))
    count = lambda rows, name: rows.groupBy("structure_id").agg(F.count("*").alias(name))
    return count(made.raw_atoms, "n").join(count(made.atoms, "kept"), "structure_id").select("structure_id", "kept", (F.col("n") - F.col("kept")).alias("gone"))


@query(f"""WITH {MADE} SELECT structure_id, kind, formula, CAST(points AS INTEGER) AS points, per * times AS members FROM made,
  (VALUES ('metal', 'Zn', 6, 1::BIGINT), ('organic', 'C2N2', 2, 3::BIGINT)) v(kind, formula, points, per)""")
def framework_units(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and ligands of each crystal, one for each composition."""
    found = Framework(frameworks(spark, folder)).ligands()
    return found.select("structure_id", "kind", "formula", F.col("n_points_of_extension").cast("int").alias("points"), F.size("members").cast("long").alias("members"))


@query(f"""WITH {MADE} SELECT structure_id, method, nodes * times AS nodes, edges * times AS edges FROM made,
  (VALUES ('sbus', 1::BIGINT, 3::BIGINT), ('all_node', 1, 3), ('single_node', 1, 3), ('ligand_cluster', 4, 6)) v(method, nodes, edges)""")
def framework_nets(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges of each crystal's net by every method."""
    made, parts = Framework(frameworks(spark, folder)), []
    for method in nets.METHODS:
        found, nodes = made.net(method)
        count = lambda rows, name: rows.groupBy("structure_id").agg(F.count("*").alias(name))
        parts.append(count(nodes, "nodes").join(count(found, "edges"), "structure_id").select("structure_id", F.lit(method).alias("method"), "nodes", "edges"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


@query(f"WITH {MADE} SELECT structure_id, 'pcu' AS topology, 3 AS dimension, 1561::DOUBLE AS td10, 'PERIODIC_GRAPH' AS heading FROM made")
def framework_topology(spark: SparkSession, folder: str) -> DataFrame:
    """The net's name, dimension and TD10 of each crystal, and how its net text begins."""
    found = Framework(frameworks(spark, folder)).topology("all_node")
    return found.select("structure_id", "topology", "dimension", "td10", F.split("cgd", "\n")[0].alias("heading"))


@query(f"""WITH {MADE} SELECT '{{"Zn":{{"capped":{{"0":"1"}},"contacts":{{"6":"1"}},"count":"1"}}}}' AS clusters, '{{"C2N2":{{"contacts":{{"2":"3"}},"count":"3","denticity":{{"1":"6"}}}}}}' AS ligands,
  count(*) AS structures, 1::BIGINT AS hashes, CAST(sum(times) AS BIGINT) AS cluster_units FROM made""")
def framework_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints, which neither cells nor guests change: how many structures share each."""
    found = Framework(frameworks(spark, folder)).fingerprint()
    part = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    return found.groupBy(part("clusters"), part("ligands")).agg(F.count("*").alias("structures"), F.count_distinct("fingerprint_hash").alias("hashes"), F.sum("cluster_units").alias("cluster_units"))


# ---------------------------------------------------------------- structure files

POINTS = """points AS (SELECT CAST(p_size AS VARCHAR) AS structure_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS atom_id, ['Zn', 'O', 'O', 'N', 'C', 'C', 'H', 'S'][p_partkey % 8 + 1] AS element,
  CAST(((p_partkey * 2654435761) >> 8) % 64 AS DOUBLE) / 64 AS fx, CAST(((p_partkey * 2654435761) >> 14) % 64 AS DOUBLE) / 64 AS fy, CAST(((p_partkey * 2654435761) >> 20) % 64 AS DOUBLE) / 64 AS fz FROM part)"""


@query(f"WITH {POINTS} SELECT format, points.* FROM points, (VALUES ('cif'), ('xyz')) f(format)")
def files_read_again(spark: SparkSession, folder: str) -> DataFrame:
    """Atoms of structures that were written as CIF and as XYZ."""
    own = points(spark, folder).withColumn("occupancy", F.lit(1.0))
    texts = [made.select(F.concat_ws("/", F.lit(kind), "structure_id").alias("structure_id"), F.concat("structure_id", F.lit(f".{kind}")).alias("source"), "text") for kind, made in (("cif", structures.cif_text(own)), ("xyz", structures.xyz_text(own)))]
    found = structures.atoms(structures.parse(texts[0].unionByName(texts[1])))
    name = F.split("structure_id", "/")
    return found.select(name[0].alias("format"), name[1].alias("structure_id"), "atom_id", "element", "fx", "fy", "fz")


@query(f"""WITH {POINTS} SELECT structure_id, sha256(printf('%28s%8.4f%8.4f%8.4f', '', 16.0, 16.0, 16.0) || chr(10) || printf('%21s%8.4f%8.4f%8.4f    SPGR =  1 P 1         OPT = 1', '', 90.0, 90.0, 90.0) || chr(10) || printf('%4d   0', count(*)) || chr(10) || '0 ' || structure_id || chr(10)
  || string_agg(printf('%4d %-4s %8.4f %8.4f %8.4f    0   0   0   0   0   0   0   0  0.0000', atom_id + 1, element, floor(fz * 16) / 16, floor(fy * 16) / 16, floor(fx * 16) / 16), chr(10) ORDER BY atom_id) || chr(10)) AS cssr_sha256 FROM points GROUP BY structure_id""")
def cssr_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of structures as CSSR, atoms on a grid that four decimals hold."""
    own = points(spark, folder).withColumn("atom_id", (F.row_number().over(Window.partitionBy("structure_id").orderBy("atom_id")) - 1).cast("int"))
    made = structures.cssr_text(own.select("structure_id", "atom_id", "element", "cell", *((F.floor(F.col(f"f{x}") * 16) / 16).alias(f"f{x}") for x in "xyz")))
    return made.select("structure_id", F.sha2("text", 256).alias("cssr_sha256"))


# ---------------------------------------------------------------- records of nets


@query(f"WITH {LINES} SELECT s AS structure_id, component, CASE WHEN name IS NULL THEN 'unnamed' ELSE 'named' END AS kind, 2 AS n_nodes, 1 AS n_edges FROM o")
def net_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Named and unnamed components with their numbers of nodes and edges."""
    found = netlog.counts(netlog.parsed(outputs(spark, folder)))
    part = lambda rows, kind: rows.select("structure_id", "component", F.lit(kind).alias("kind"), "n_nodes", "n_edges")
    return part(netlog.named(found), "named").unionByName(part(netlog.unnamed(found), "unnamed"))


@query(f"WITH {LINES} SELECT s AS structure_id, component, name, s || '  ' || coalesce(name, '-') || '  ' || dimension || '  ' || td10 AS line FROM o WHERE component = 2")
def component_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The second component of each structure, and its record as a line."""
    picked = netlog.selected(netlog.parsed(outputs(spark, folder)), 2).withColumn("topology", F.col("name"))
    return picked.select("structure_id", "component", "name", netlog.summary_line().alias("line"))


#: The canonical text of a component, as the made output has it.
PAYLOAD = """'{"cell":[' || (l_partkey + 0.5::DOUBLE) || ',' || (l_suppkey + 0.25::DOUBLE) || ',' || CAST(l_linenumber AS DOUBLE) || ',90.0,60.5,120.0],"dimension":' || dimension || ',"edges":[[[0.0,0.0,0.0],[0.5,-0.25,' || CAST(l_linenumber AS DOUBLE) || ']]],"edge_centers":[[0.25,-0.125,0.5]],"nodes":[[0.0,0.0,0.0],[0.5,-0.25,' || CAST(l_linenumber AS DOUBLE) || ']],"space_group":"Fm-3m","td10":' || td10 || '}'"""


@query(f"WITH {LINES} SELECT s AS structure_id, component, {PAYLOAD} AS payload, sha256({PAYLOAD}) AS topology_hash FROM o")
def topology_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical text of each component, and its hash."""
    return netlog.parsed(outputs(spark, folder)).select("structure_id", "component", netlog.payload().alias("payload"), netlog.hashed().alias("topology_hash"))


@query(f"WITH {LINES}, h AS (SELECT s, component, sha256({PAYLOAD}) AS h FROM o WHERE name IS NULL) SELECT s AS structure_id, string_agg(component || '=' || h, ' ' ORDER BY component) AS hashes FROM h GROUP BY s")
def hashes_of_unnamed(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of each structure's unnamed components."""
    pairs = F.map_entries("hashes")
    return netlog.unnamed_hashes(netlog.parsed(outputs(spark, folder))).select("structure_id", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"].cast("string"), F.lit("="), p["value"])), " ").alias("hashes"))


@query(f"""WITH {LINES}, t AS (SELECT s, component, 'CRYSTAL' || chr(10) || '  NAME ' || s || chr(10) || '  GROUP Fm-3m' || chr(10) || printf('  CELL %.6f %.6f %.6f %.6f %.6f %.6f', l_partkey + 0.5::DOUBLE, l_suppkey + 0.25::DOUBLE, l_linenumber::DOUBLE, 90.0, 60.5, 120.0) || chr(10)
  || printf('  NODE 1 1 %.6f %.6f %.6f', 0.5, -0.25, l_linenumber::DOUBLE) || chr(10) || '  NODE 2 1 0.000000 0.000000 0.000000' || chr(10) || printf('  EDGE 0.000000 0.000000 0.000000  %.6f %.6f %.6f', 0.5, -0.25, l_linenumber::DOUBLE) AS body FROM o)
SELECT s AS structure_id, component, body || chr(10) || '  # EDGE_CENTER 0.250000 -0.125000 0.500000' || chr(10) || 'END' || chr(10) AS crystal, sha256(body || chr(10) || 'END' || chr(10)) AS crystal_hash FROM t""")
def crystal_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each component as a CRYSTAL block, and the hash of it without centres."""
    name = F.col("structure_id")
    return netlog.parsed(outputs(spark, folder)).select("structure_id", "component", netlog.crystal_text(name).alias("crystal"), F.sha2(netlog.crystal_text(name, False), 256).alias("crystal_hash"))


@query("SELECT n_name AS structure_id, 'CRYSTAL' || chr(10) || '  NAME ' || n_name || chr(10) || '  1 2 0 0 0' || chr(10) || '  2 1 ' || n_regionkey || ' 0 1' || chr(10) || 'END' || chr(10) AS crystal, '1.0 1.0 1.0 90.0 90.0 90.0' AS cell FROM nation")
def crystal_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """Nets that weren't relaxed as CRYSTAL blocks of their lines, and the cell that stands in for theirs."""
    own = F.concat(F.lit("PERIODIC_GRAPH\n  ID "), "n_name", F.lit("\n  EDGES\n    1 2 0 0 0\n    2 1 "), F.col("n_regionkey").cast("string"), F.lit(" 0 1\nEND\n"))
    return table(spark, folder, "nation").select(F.col("n_name").alias("structure_id"), netlog.crystal_fallback(own, F.col("n_name")).alias("crystal"), F.array_join(netlog.default_cell().cast("array<string>"), " ").alias("cell"))


# ---------------------------------------------------------------- values and lookups


@query("""SELECT p_partkey, CAST(gcd(p_partkey * 6, p_size * 4) AS BIGINT) AS divisor, CAST(floor((p_size - 25) / 4) AS INTEGER) AS quotient, round_even(p_size / 8::DOUBLE, 2) AS near,
  p_size / 64::DOUBLE * 3 - round_even(p_size / 64::DOUBLE * 3, 0) AS gap, CASE p_partkey % 4 WHEN 0 THEN 'abcd' WHEN 1 THEN 'bacd' WHEN 2 THEN 'cabd' ELSE 'dabc' END AS front, (p_partkey % 3) * (p_size % 4 + 1) = 0 AS flat FROM part""")
def value_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Divisors, quotients, rounding, nearest images, reordering and planes of numbers."""
    p, size = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y, z: F.array(*(F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (x, y, z)))
    flat = geometry.planar(point(0, 0, 0), point(size % 4 + 1, 0, 0), point(0, 1, 0), point(1, 1, p % 3))
    letters = F.array(*(F.lit(x) for x in "abcd"))
    return table(spark, folder, "part").select(
        "p_partkey", numbers.gcd(F.greatest(p * 6, size * 4), F.least(p * 6, size * 4)).alias("divisor"), numbers.floor_div(size - 25, F.lit(4)).alias("quotient"), text.rounded(F.array(size / 8.0), 2)[0].alias("near"),
        geometry.nearest_image(F.array(size / 64.0 * 3))[0].alias("gap"), F.array_join(geometry.to_front(letters, (p % 4).cast("int")), "").alias("front"), flat.alias("flat"),
    )


#: Labels of parts: every third one is a word, the others are numbers.
LABEL = "CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 7) || 'x' || p_partkey ELSE CAST(p_partkey % 50 AS VARCHAR) END"


@query(f"SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY try_cast({LABEL} AS BIGINT) IS NULL, try_cast({LABEL} AS BIGINT), {LABEL}, p_partkey) AS INTEGER) AS place FROM part")
def label_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places of labels in their order: numbers by value, then words."""
    label = F.expr(LABEL.replace("VARCHAR", "STRING"))
    return table(spark, folder, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(*geometry.label_order(label), "p_partkey")).alias("place"))


@query(f"""WITH {LINE}, e AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS id, l_suppkey % 5 AS other FROM lines UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey % 5, l_partkey % 5 FROM lines),
f AS (SELECT l_orderkey, id, other, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY l_linenumber, other) AS r FROM e)
SELECT o.l_orderkey AS structure_id, i.id AS id, CAST(f.other AS VARCHAR) AS partner FROM (SELECT DISTINCT l_orderkey FROM lines) o CROSS JOIN (VALUES (0::BIGINT), (3::BIGINT)) i(id) LEFT JOIN f ON f.l_orderkey = o.l_orderkey AND f.id = i.id AND f.r = 1""")
def partner_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The other end of the first pair that names an id."""
    own = lines_of(spark, folder).select(F.col("l_orderkey").alias("structure_id"), "l_linenumber", (F.col("l_partkey") % 5).alias("i"), (F.col("l_suppkey") % 5).alias("j"))
    asked = own.select("structure_id").distinct().select("structure_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("id"))
    return edges.partners(own, asked, "l_linenumber").withColumn("partner", F.col("partner").cast("string"))


@query(f"""WITH {LINE}, s AS (SELECT l_orderkey, l_linenumber, ['Zn', 'Cu', 'Fe'][l_suppkey % 3 + 1] AS metal, list_slice(['O', 'N', 'S', 'C', 'O'], 1, CAST(l_partkey % 5 + 1 AS BIGINT)) AS near FROM lines),
g AS (SELECT l_orderkey, list(list_prepend(metal, near) ORDER BY l_linenumber) AS spheres FROM s GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(spheres, lambda x: len(x) = 4 AND list_contains(x, 'Zn'))[1], ' ') AS sphere FROM g""")
def coordination_spheres(spark: SparkSession, folder: str) -> DataFrame:
    """The first sphere of each order that holds zinc and three more."""
    metal = F.element_at(F.array(*(F.lit(m) for m in ("Zn", "Cu", "Fe"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    near = F.slice(F.array(*(F.lit(e) for e in ("O", "N", "S", "C", "O"))), F.lit(1), (F.col("l_partkey") % 5 + 1).cast("int"))
    listed = lines_of(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.array(metal), near).alias("sphere")))).alias("s"))
    found = units.coordination_sphere(F.transform("s", lambda x: x["sphere"]), F.lit("Zn"), F.lit(3))
    return listed.select("l_orderkey", F.array_join(found, " ").alias("sphere"))
