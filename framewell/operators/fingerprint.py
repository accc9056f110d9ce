"""Fingerprints of a framework: which clusters and ligands it has, how they meet, in exact ratios for one cluster unit.

Input: incidences (cluster, ligand, sx, sy, sz, denticity) and vertices (kind,
vertex, element_counts, formula, rank) where rank is that of the component's own
translation lattice. Everything is grouped by ``keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions.numbers import ratio
from framewell.operators import groups
from framewell.session import cut_lineage

KEYS = ["structure_id"]
#: Rounds of colour refinement, and digits of a colour that are shown.
ROUNDS, SHOWN = 3, 16


def terminal_split(incidences: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Number of contacts of each ligand, and whether it is terminal: has one."""
    return incidences.groupBy(*keys, "ligand").agg(F.count("*").alias("contacts")).withColumn("terminal", F.col("contacts") == 1)


def _by_vertex(incidences: DataFrame, keys: list[str]) -> DataFrame:
    """Each incidence from both of its ends: (kind, vertex, other kind, other, denticity, terminal)."""
    split = terminal_split(incidences, keys).select(*keys, "ligand", "terminal")
    rows = incidences.join(split, [*keys, "ligand"])
    ends = F.array(
        F.struct(F.lit("cluster").alias("kind"), F.col("cluster").alias("vertex"), F.lit("ligand").alias("other_kind"), F.col("ligand").alias("other")),
        F.struct(F.lit("ligand").alias("kind"), F.col("ligand").alias("vertex"), F.lit("cluster").alias("other_kind"), F.col("cluster").alias("other")),
    )
    return rows.select(*keys, F.explode(ends).alias("e"), "denticity", "terminal").select(*keys, "e.*", "denticity", "terminal")


def _shared(n: Column, units: Column) -> Column:
    """A count over the repeat units where they divide it."""
    return F.when(n % units == 0, (n / units).cast("long")).otherwise(n)


def _histogram(rows: DataFrame, by: list[str], of: str, units: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted ``value:count`` text of a column for each vertex."""
    counted = rows.groupBy(*by, of).agg(F.count("*").alias("n")).join(units, by)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(of).cast("string").alias("v"), _shared(F.col("n"), F.col("units")).alias("n"))))
    return counted.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["v"], p["n"].cast("string"))), ",").alias("histogram"))


def vertices(incidences: DataFrame, known: DataFrame) -> DataFrame:
    """(structure_id, kind, vertex, element_counts, formula, rank) of components; the formula is over the repeat units of a periodic component.

    known: (structure_id, comp_id, kind, formula, element_counts, rank).
    """
    terminal = terminal_split(incidences).select("structure_id", F.col("ligand").alias("vertex"), F.lit("ligand").alias("kind"), "terminal")
    ends = _by_vertex(incidences, KEYS).groupBy("structure_id", "kind", "vertex").agg(F.count_if((F.col("kind") == "ligand") | ~F.col("terminal")).alias("framework"))
    own = known.withColumnRenamed("comp_id", "vertex").join(ends, ["structure_id", "kind", "vertex"]).join(terminal, ["structure_id", "kind", "vertex"], "left")
    units = F.when(F.coalesce("terminal", F.lit(False)), F.lit(1).cast("long")).otherwise(groups.repeat_units(F.col("element_counts"), F.col("framework"), F.col("rank") > 0))
    own = own.withColumn("u", units)
    part = F.transform("elements", lambda e: F.concat(e["element"], F.when(e["n"] == F.col("u"), "").otherwise((e["n"] / F.col("u")).cast("long").cast("string"))))
    return own.select("structure_id", "kind", "vertex", "element_counts", F.array_join(part, "").alias("formula"), "rank")


def refine(colours: DataFrame, meets: DataFrame, units: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One round of colour refinement: a vertex's colour and the histogram of its neighbours' colours make the next."""
    by = [*keys, "kind", "vertex"]
    near = meets.join(colours.select(*keys, F.col("kind").alias("other_kind"), F.col("vertex").alias("other"), F.col("colour").alias("near")), [*keys, "other_kind", "other"])
    told = _histogram(near, by, "near", units, keys)
    return colours.join(told, by, "left").select(*by, F.sha2(F.concat_ws("|", "colour", F.coalesce("histogram", F.lit(""))), 256).alias("colour"))


def fingerprint(incidences: DataFrame, vertices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(payload, fingerprint_hash, cluster_units) of each structure; payload is canonical JSON that the hash covers."""
    by = [*keys, "kind", "vertex"]
    ends = _by_vertex(incidences, keys)
    sizes = ends.groupBy(*by).agg(
        F.count("*").alias("contacts"),
        F.count_if((F.col("kind") == "cluster") & F.col("terminal")).alias("capped"),
        F.bool_or((F.col("kind") == "ligand") & F.col("terminal")).alias("terminal"),
    )
    known = sizes.join(vertices, by)
    framework = F.when(F.col("kind") == "cluster", F.col("contacts") - F.col("capped")).otherwise(F.col("contacts"))
    known = known.withColumn("framework", framework).withColumn("units", F.when(F.col("terminal"), F.lit(1).cast("long")).otherwise(groups.repeat_units(F.col("element_counts"), F.col("framework"), F.col("rank") > 0)))
    known, ends = cut_lineage(known), cut_lineage(ends)
    inner = known.where("NOT terminal")
    units = inner.select(*by, "units")
    meets = ends.where("NOT terminal")
    told = _histogram(meets, by, "denticity", units, keys)
    first = inner.join(told, by, "left").select(*by, F.sha2(F.concat_ws("|", "kind", "formula", F.col("rank").cast("string"), F.floor(F.col("framework") / F.col("units")).cast("string"), F.coalesce("histogram", F.lit(""))), 256).alias("colour"))
    for _ in range(ROUNDS):
        first = cut_lineage(refine(first, meets, units, keys))
    total = inner.where("kind = 'cluster'").groupBy(*keys).agg(F.greatest(F.sum("units"), F.lit(1).cast("long")).alias("cluster_units"))
    role = F.when(F.col("terminal"), "terminal").when(F.col("kind") == "cluster", "clusters").otherwise("ligands")
    per_unit = lambda c: F.floor(F.col(c) / F.col("units")).cast("string")
    fields = F.array(
        F.struct(F.lit("count").alias("field"), F.lit(None).cast("string").alias("key"), F.col("units").alias("n")),
        F.struct(F.lit("contacts").alias("field"), F.when(~F.col("terminal"), F.when(F.col("kind") == "cluster", per_unit("framework")).otherwise(per_unit("contacts"))).alias("key"), F.col("units").alias("n")),
        F.struct(F.lit("capped").alias("field"), F.when(F.col("kind") == "cluster", per_unit("capped")).alias("key"), F.col("units").alias("n")),
    )
    counted = known.select(*keys, role.alias("role"), F.col("formula").alias("species"), F.explode(fields).alias("f")).select(*keys, "role", "species", "f.*").where("field = 'count' OR key IS NOT NULL")
    dents = ends.where("kind = 'ligand'").join(known.select(*by, "formula"), by)
    dents = dents.select(*keys, F.when(F.col("terminal"), "terminal").otherwise("ligands").alias("role"), F.col("formula").alias("species"), F.lit("denticity").alias("field"), F.col("denticity").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    colours = first.join(units, by).select(*keys, F.lit("refinement").alias("role"), F.substring("colour", 1, SHOWN).alias("species"), F.lit("count").alias("field"), F.lit(None).cast("string").alias("key"), F.col("units").alias("n"))
    rows = counted.unionByName(dents).unionByName(colours).groupBy(*keys, "role", "species", "field", "key").agg(F.sum("n").alias("n")).join(total, keys)
    return assembled(rows.withColumn("value", ratio(F.col("n"), F.col("cluster_units"))), keys)


def _object(pairs: Column) -> Column:
    """JSON object of an array of (name, JSON text), sorted by name."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["json"])), ","), F.lit("}"))


def assembled(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Canonical JSON (sorted names, no blanks) of (role, species, field, key, value, cluster_units) rows, and its hash."""
    quoted = F.concat(F.lit('"'), F.col("value"), F.lit('"'))
    leaf = rows.groupBy(*keys, "cluster_units", "role", "species", "field").agg(F.max(F.when(F.col("key").isNull(), quoted)).alias("plain"), _object(F.collect_list(F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("name"), quoted.alias("json"))))).alias("nested"))
    species = leaf.groupBy(*keys, "cluster_units", "role", "species").agg(
        _object(F.collect_list(F.struct(F.col("field").alias("name"), F.coalesce("plain", "nested").alias("json")))).alias("body"), F.max("plain").alias("plain")
    )
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.when(F.col("role") == "refinement", F.concat(F.lit('["'), F.col("species"), F.lit('",'), F.col("plain"), F.lit("]"))))), ","), F.lit("]"))
    roles = [F.struct(F.lit(r).alias("name"), _object(F.collect_list(F.when(F.col("role") == r, F.struct(F.col("species").alias("name"), F.col("body").alias("json"))))).alias("json")) for r in ("clusters", "ligands", "terminal")]
    whole = species.groupBy(*keys, "cluster_units").agg(*(x.alias(f"r{k}") for k, x in enumerate(roles)), listed.alias("listed"))
    payload = _object(F.array(*(F.col(f"r{k}") for k in range(3)), F.struct(F.lit("refinement").alias("name"), F.col("listed").alias("json"))))
    return whole.select(*keys, payload.alias("payload"), "cluster_units").withColumn("fingerprint_hash", F.sha2("payload", 256))
