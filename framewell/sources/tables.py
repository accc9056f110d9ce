"""Tables and texts by suffix, and the sinks of results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators import records
from framewell.sources import packed

READERS = {"json": lambda r: r.option("multiLine", True).format("json"), "csv": lambda r: r.option("header", True).format("csv"), "parquet": lambda r: r.format("parquet"), "orc": lambda r: r.format("orc")}


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its path's suffix: JSON, CSV, Parquet, ORC, MessagePack (keys with JSON) or a workbook (rows of cells), else lines of text. Pickles aren't read: they can run code."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("p", "pkl", "pickle"):
        raise ValueError("pickled files aren't read, as loading one can run any code; write Parquet instead")
    if kind == "msgpack":
        return packed.read_msgpack(spark, path)
    if kind == "xlsx":
        return packed.read_workbook(spark, path)
    if kind not in READERS:
        return lines(spark, path)
    reader = READERS[kind](spark.read)
    return (reader.schema(schema) if schema else reader).load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, a ``value`` each."""
    return spark.read.text(path)


def put_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Write one string column as lines."""
    df.write.mode("append" if append else "overwrite").text(path)


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the members of zip files; members that can't be read are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, its fields in order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str, result: str, bulky: list[str]) -> None:
    """CSV of the records that have a result, less bulky columns."""
    records.summary(df, result, bulky).write.mode("overwrite").option("header", True).csv(path)


def write_fingerprints(df: DataFrame, path: str) -> None:
    """CSV of record_id, mof_name, source, fingerprint_hash and cluster_units."""
    df.select("record_id", "mof_name", "source", "fingerprint_hash", "cluster_units").write.mode("overwrite").option("header", True).csv(path)


def write_topologies(df: DataFrame, path: str, methods: list[str]) -> None:
    """CSV with the columns of each method beside each other; one method's columns keep their names."""
    fields = ["topology", "dimension", "td10", "topology_hash"]
    if len(methods) == 1:
        wide = df.where(F.col("method") == methods[0]).select("structure_id", *fields)
    else:
        wide = df.groupBy("structure_id").pivot("method", methods).agg(*(F.first(f).alias(f) for f in fields))
    wide.write.mode("overwrite").option("header", True).csv(path)


def upsert(spark: SparkSession, df: DataFrame, path: str, keys: list[str], seq: str) -> None:
    """Merge rows into a Parquet table, of a key's rows the one of greatest ``seq`` staying.

    The merged table is written beside the old one and then takes its place: a failed
    write loses nothing, and a table that a run left under its old name, having ended
    before the new one took its place, is put back by the next run.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = files.getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new"), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    if store.exists(old) and not store.exists(files):
        store.rename(old, files)
    held = spark.read.parquet(path) if store.exists(files) else df.where("false")
    records.upsert(held, df, keys, seq).write.mode("overwrite").parquet(f"{path}.new")
    store.delete(old, True)
    if store.exists(files):
        store.rename(files, old)
    store.rename(new, files)
    store.delete(old, True)


def array_json(values: Column) -> Column:
    """An array, nested or not, as JSON."""
    return F.to_json(values)


def json_array(text: Column, kind: str = "array<array<double>>") -> Column:
    """JSON as an array; null where it isn't one."""
    return F.from_json(text, kind)


def names(spark: SparkSession, path: str) -> DataFrame:
    """(key, name) of a dictionary of names, from MessagePack, JSON or CSV; for ``records.first_hit``."""
    rows = load(spark, path)
    return rows.select("key", F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v").alias("name")) if path.endswith(".msgpack") else rows.select("key", "name")
