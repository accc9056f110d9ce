"""Batches over folders of structures: what was done before is skipped, results go to Parquet tables by key, summaries to CSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.text import base_name
from framewell.operators import nets, records, units
from framewell.plans.framework import Framework
from framewell.session import cut_lineage
from framewell.sources import structures, tables

#: Each analysis by the name of its table.
ANALYSES: dict[str, Callable[[Framework], DataFrame]] = {
    "sbus_and_linkers": lambda f: units.records(f.secondary_units()),
    "ligands": lambda f: units.records(f.ligands()),
    "building_units": lambda f: f.secondary_units().unionByName(f.ligands()),
    "porosity": lambda f: f.porosity(),
    "topology": lambda f: f.topology(),
    "all_topologies": lambda f: _each(f, list(nets.METHODS)),
    "fingerprint": lambda f: f.fingerprint(),
    "open_metals": lambda f: f.open_metals(),
    "overlaps": lambda f: f.overlaps(),
    "stacking": lambda f: f.stacking(),
}
#: Columns that summaries leave out, and the one that tells if there is a result.
BULKY = {"topology": (["cgd", "sequences"], "topology"), "all_topologies": (["cgd", "sequences"], "topology"), "porosity": ([], "AV_A^3"), "fingerprint": (["payload"], "fingerprint_hash")}


def _each(parent: Framework, methods: list[str]) -> DataFrame:
    found = [parent.topology(m) for m in methods]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def pending(spark: SparkSession, parsed: DataFrame, out: str, name: str) -> DataFrame:
    """Structures without a row in a table, whose own skip list is kept per analysis."""
    path = f"{out}/{name}/_done"
    return records.pending(parsed, spark.read.parquet(path), "structure_id") if exists(spark, path) else parsed


def run(spark: SparkSession, folder: str, out: str, analyses: list[str], pattern: str = "*.cif", recursive: bool = False) -> dict[str, DataFrame]:
    """Analyse the structures of a folder that each table lacks; tables are at ``out/name/rows``, with ``record`` facts at ``out/structures``.

    A structure that can't be read, or has no result, is marked as done all the same: its row in ``structures`` has the error.
    """
    parsed = cut_lineage(structures.read(spark, folder, pattern, recursive))
    facts = structures.structures(parsed).withColumn("mof_name", base_name(F.col("source"))).withColumn("seq", F.current_timestamp())
    tables.upsert(spark, facts, f"{out}/structures", ["structure_id"], "seq")
    found, shared = {}, {}
    for name in analyses:
        todo = pending(spark, parsed, out, name)
        # analyses that lack the same structures share what is derived from these
        own = todo.agg(F.count("*"), F.sum(F.xxhash64("structure_id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "structure_id"))).first()
        parent = shared.setdefault(tuple(own), Framework(todo))
        rows = ANALYSES[name](parent).withColumn("seq", F.current_timestamp())
        keys = ["structure_id", *(c for c in ("method", "scheme", "unit_id") if c in rows.columns)]
        tables.upsert(spark, rows, f"{out}/{name}/rows", keys, "seq")
        done = todo.select("structure_id").withColumn("seq", F.current_timestamp())
        tables.upsert(spark, done, f"{out}/{name}/_done", ["structure_id"], "seq")
        found[name] = spark.read.parquet(f"{out}/{name}/rows")
        if name in BULKY:
            bulky, result = BULKY[name]
            tables.write_summary(found[name].drop("seq"), f"{out}/{name}/summary", f"`{result}`", bulky)
    return found


def curate(spark: SparkSession, folder: str, out: str, pattern: str = "*.cif") -> DataFrame:
    """Write each structure without its guests as CIF; return which have overlapping atoms."""
    parent = Framework(structures.read(spark, folder, pattern, False))
    structures.write_texts(structures.cif_text(parent.atoms), f"{out}/cif")
    return parent.overlaps()
