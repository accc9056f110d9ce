"""Structure files as they arrive: a file stream whose batches append to Parquet tables, and resume by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewell.functions.text import record_key
from framewell.sources import structures


def files(spark: SparkSession, path: str, pattern: str = "*.cif", most: int = 1000) -> DataFrame:
    """(structure_id, source, text) of new files, at most so many in a batch."""
    stream = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).format("text").load(path)
    named = stream.select("value", F.col("_metadata.file_path").alias("source"))
    return named.select(record_key(F.col("source")).alias("structure_id"), "source", F.col("value").alias("text"))


def ingest(spark: SparkSession, path: str, out: str, analyse: Callable[[DataFrame], dict[str, DataFrame]], pattern: str = "*.cif", most: int = 1000) -> StreamingQuery:
    """Analyse files that weren't seen before and end; each named result goes to a table below ``out``, a folder for each batch.

    A batch that is repeated after a failure overwrites its own folder, so
    nothing is twice there.
    """

    def batch(rows: DataFrame, number: int) -> None:
        for name, found in analyse(structures.parse(rows)).items():
            found.write.mode("overwrite").parquet(f"{out}/{name}/batch={number:06d}")

    return files(spark, path, pattern, most).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
