"""Tables of results that grow: keyed upserts, resuming, batches, wide and summary forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(held: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of greatest ``seq`` of each key of both tables; aggregates before it shuffles."""
    every = held.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("row")).select(*keys, "row.*")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key wasn't processed."""
    return inputs.join(done.select(key), key, "left_anti")


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows with a batch number within each ``by``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def wide(rows: DataFrame, key: str, method: str, methods: list[str], value: Column) -> DataFrame:
    """A column for each method."""
    return rows.groupBy(key).pivot(method, methods).agg(value)


def summary(rows: DataFrame, result: str, bulky: list[str]) -> DataFrame:
    """Rows that have a result, without bulky columns."""
    return rows.where(F.col(result).isNotNull()).drop(*bulky)


def unique(rows: DataFrame, ignored: list[str]) -> DataFrame:
    """Rows without the ignored columns, each once."""
    return rows.drop(*ignored).dropDuplicates()


def first_hit(rows: DataFrame, key: str, keys: Column, dictionary: DataFrame) -> DataFrame:
    """(key, name): the name under the first of a row's keys that the dictionary (key, name) has, null without one."""
    asked = rows.select(F.col(key).alias("_row"), F.posexplode(keys).alias("_ord", "_key"))
    met = asked.join(dictionary.select(F.col("key").alias("_key"), "name"), "_key", "left")
    found = met.groupBy("_row").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("_ord"))).alias("name"))
    return found.withColumnRenamed("_row", key)


def filled(rows: DataFrame, held: DataFrame, key: str, column: str, otherwise: Column) -> DataFrame:
    """Rows with a column of the values that ``held`` has for their key, computed from the row where it has none."""
    met = rows.join(held.select(F.col(key).alias("_key"), F.col(column).alias("_held")), F.col(key) == F.col("_key"), "left")
    return met.withColumn(column, F.coalesce("_held", otherwise)).drop("_key", "_held")
