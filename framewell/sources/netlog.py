"""Fields of a net identification tool's text output, by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Result words where there is no name.
UNKNOWN, ERROR, MISMATCH, TIMEOUT = "UNKNOWN", "ERROR", "MISMATCH", "TIMEOUT"
NUMBER = r"-?\d+(?:\.\d+)?"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def components(outputs: DataFrame) -> DataFrame:
    """(structure_id, component, block) of (structure_id, stdout): the text after each component's heading, the whole text without headings."""
    parts = F.split("stdout", r"Processing component \d+:")
    own = outputs.select("structure_id", F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts) - 1)).otherwise(parts).alias("parts"))
    return own.select("structure_id", F.posexplode("parts").alias("at", "block")).select("structure_id", (F.col("at") + 1).alias("component"), "block")


def td10(block: Column) -> Column:
    return _found(block, r"TD10\s*=\s*(\d+(?:\.\d+)?)").cast("double")


def name(block: Column) -> Column:
    """The net's name, by either of two headings."""
    return F.coalesce(_found(block, r"Name:\s*(\S+)"), _found(block, r"(?i)net\s+([a-z]{3}(?:-[a-z0-9]+)*)\s+was identified"))


def dimension(block: Column) -> Column:
    """As stated, else of the last mention of ``N-periodic``."""
    mentions = F.regexp_extract_all(block, F.lit(r"(\d)-periodic"), F.lit(1))
    return F.coalesce(_found(block, r"dimension\s*=\s*(\d)"), F.when(F.size(mentions) > 0, F.element_at(mentions, -1))).cast("int")


def space_groups(block: Column) -> Column:
    """Given and ideal space group."""
    return F.struct(_found(block, r"Given space group is\s+([^\s.]+)").alias("given"), _found(block, r"Ideal space group is\s+([^\s.]+)").alias("ideal"))


def _section(block: Column, heading: str) -> Column:
    """The lines below a heading that are indented by four and more."""
    body = F.regexp_extract(block, heading + r"[^\n]*\n((?:[ \t]{4,}[^\n]*\n?)*)", 1)
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _numbers(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def cell(block: Column) -> Column:
    """Relaxed cell as six numbers; of a plane net (a, b, 1, 90, 90, gamma)."""
    got = _numbers(F.array_join(F.slice(_section(block, "Relaxed cell parameters"), 1, 2), " "))
    one, right = F.lit(1.0), F.lit(90.0)
    return F.when(F.size(got) == 6, got).when(F.size(got) == 3, F.array(got[0], got[1], one, right, right, got[2]))


def positions(block: Column) -> Column:
    """Node labels with their relaxed positions."""
    rows = F.filter(_section(block, "Relaxed positions"), lambda x: x.rlike(r"^Node\s"))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"^Node\s+([^:\s]+)", 1).alias("node"), _numbers(F.regexp_replace(x, r"^Node\s+[^:\s]+:?", "")).alias("place")))


def edges(block: Column) -> Column:
    """Pairs of end points."""
    rows = F.filter(_section(block, "Edges:"), lambda x: x.contains("<->"))
    return F.transform(rows, lambda x: F.transform(F.split(x, "<->"), _numbers))


def centres(block: Column) -> Column:
    """Edge centres; in a plane with z = 0."""
    rows = F.transform(_section(block, "Edge centers"), _numbers)
    return F.transform(F.filter(rows, lambda x: F.size(x) >= 2), lambda x: F.when(F.size(x) == 2, F.concat(x, F.array(F.lit(0.0)))).otherwise(x))


def coordination(block: Column) -> Column:
    """The first number of each row of coordination sequences."""
    return F.transform(_section(block, "Coordination sequences"), lambda x: F.nullif(F.regexp_extract(x, r":\s*(\d+)", 1), F.lit("")).cast("int"))


def parsed(outputs: DataFrame) -> DataFrame:
    """One row for each component that has positions or edges, with all of its fields."""
    b = F.col("block")
    rows = components(outputs).select("structure_id", "component", name(b).alias("name"), F.coalesce(dimension(b), F.lit(0)).alias("dimension"), td10(b).alias("td10"), space_groups(b).alias("space_groups"), cell(b).alias("cell"), positions(b).alias("nodes"), edges(b).alias("edges"), centres(b).alias("centres"), coordination(b).alias("coordination"))
    return rows.where((F.size("nodes") > 0) & (F.size("edges") > 0))


def topologies(outputs: DataFrame) -> DataFrame:
    """(structure_id, topology): the one name of all components, or a word that tells why there is none."""
    own = components(outputs).select("structure_id", name(F.col("block")).alias("name"), F.col("block").rlike(r"(?i)\berror\b|exception").alias("bad"))
    agreed = F.when(F.count("name") == 0, F.when(F.bool_or("bad"), ERROR).otherwise(UNKNOWN)).when((F.count_distinct("name") == 1) & (F.count("name") == F.count("*")), F.min("name")).otherwise(MISMATCH)
    return own.groupBy("structure_id").agg(agreed.alias("topology"))


def best(rows: DataFrame) -> DataFrame:
    """Each structure's component of most edges, then nodes, then the first."""
    rest = [c for c in rows.columns if c != "structure_id"]
    pick = F.min_by(F.struct(*rest), F.struct((-F.size("edges")).alias("e"), (-F.size("nodes")).alias("n"), "component"))
    return rows.groupBy("structure_id").agg(pick.alias("c")).select("structure_id", "c.*")


def payload(row_decimals: int = 8) -> Column:
    """Canonical text of a component without its labels: rounded, sorted nodes, edges and centres, cell, dimension, TD10."""
    rounded = lambda a: F.transform(a, lambda x: F.bround(x, row_decimals))
    nodes = F.array_sort(F.transform("nodes", lambda n: rounded(n["place"])))
    pairs = F.array_sort(F.array_distinct(F.transform("edges", lambda e: F.array_sort(F.transform(e, rounded)))))
    middle = F.array_sort(F.transform("centres", rounded))
    return F.to_json(F.struct(rounded(F.col("cell")).alias("cell"), F.col("dimension"), pairs.alias("edges"), middle.alias("edge_centers"), nodes.alias("nodes"), F.col("space_groups.ideal").alias("space_group"), F.col("td10")))


def hashed(decimals: int = 8) -> Column:
    return F.sha2(payload(decimals), 256)


def crystal_text(name: Column, with_centres: bool = True) -> Column:
    """A CRYSTAL block of a component: group, cell, nodes with their degree, edges, and centres as comments."""
    six = lambda a: F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x)), " ")
    unit = F.array(*(F.lit(x) for x in (1.0, 1.0, 1.0, 90.0, 90.0, 90.0)))
    ends = F.flatten("edges")
    node = F.transform("nodes", lambda n, i: F.concat(F.lit("  NODE "), (i + 1).cast("string"), F.lit(" "), F.size(F.filter(ends, lambda e: e == n["place"])).cast("string"), F.lit(" "), six(n["place"])))
    edge = F.transform("edges", lambda e: F.concat(F.lit("  EDGE "), six(e[0]), F.lit("  "), six(e[1])))
    middle = F.transform("centres", lambda c: F.concat(F.lit("  # EDGE_CENTER "), six(c)))
    body = F.concat(node, edge, middle) if with_centres else F.concat(node, edge)
    head = F.concat(F.lit("CRYSTAL\n  NAME "), name, F.lit("\n  GROUP "), F.coalesce("space_groups.ideal", F.lit("P1")), F.lit("\n  CELL "), six(F.coalesce("cell", unit)), F.lit("\n"))
    return F.concat(head, F.array_join(body, "\n"), F.lit("\nEND\n"))


def crystal_fallback(cgd: Column, name: Column) -> Column:
    """A CRYSTAL block of a periodic graph's lines, its headings dropped, where nothing was relaxed."""
    rows = F.filter(F.transform(F.split(cgd, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.upper(x).rlike("^(PERIODIC_GRAPH|ID|EDGES|END)"))
    return F.concat(F.lit("CRYSTAL\n  NAME "), name, F.lit("\n"), F.array_join(F.transform(rows, lambda x: F.concat(F.lit("  "), x)), "\n"), F.lit("\nEND\n"))


def named(rows: DataFrame) -> DataFrame:
    """Components whose net has a name."""
    return rows.where("name IS NOT NULL")


def unnamed(rows: DataFrame) -> DataFrame:
    """Components whose net has none."""
    return rows.where("name IS NULL")


def selected(rows: DataFrame, component: int | None = None) -> DataFrame:
    """Each structure's component of a number; without a number the best one."""
    return best(rows) if component is None else rows.where(F.col("component") == component)


def counts(rows: DataFrame) -> DataFrame:
    """Rows with the numbers of nodes and edges of each component added."""
    return rows.withColumn("n_nodes", F.size("nodes")).withColumn("n_edges", F.size("edges"))


def unnamed_hashes(rows: DataFrame, decimals: int = 8) -> DataFrame:
    """(structure_id, hashes): a map from the unnamed components' numbers to their hashes."""
    pairs = unnamed(rows).select("structure_id", F.struct("component", hashed(decimals).alias("hash")).alias("p"))
    return pairs.groupBy("structure_id").agg(F.map_from_entries(F.array_sort(F.collect_list("p"))).alias("hashes"))


def default_cell() -> Column:
    """Lengths and angles of the unit cell that stands in for a missing one."""
    return F.array(*(F.lit(x) for x in (1.0, 1.0, 1.0, 90.0, 90.0, 90.0)))


def summary_line() -> Column:
    """One line of a record: its key, name, dimension and TD10, those that are null as ``-``."""
    return F.concat_ws("  ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("structure_id", "topology", "dimension", "td10")))
