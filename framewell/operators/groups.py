"""Groupings of components: regions of equal composition, representatives, formulae, picks with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions.numbers import gcd_all

KEYS = ["structure_id"]


def regions(members: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(comp_id, signature, region_id) of components with the same sorted elements; a region is named by its least component. members: (comp_id, element)."""
    signed = members.groupBy(*keys, "comp_id").agg(F.array_join(F.array_sort(F.collect_list("element")), " ").alias("signature"))
    names = signed.groupBy(*keys, "signature").agg(F.min("comp_id").alias("region_id"))
    return signed.join(names, [*keys, "signature"]).select(*keys, "comp_id", "signature", "region_id")


def representatives(rows: DataFrame, region: str, order: str, keys: list[str] = KEYS) -> DataFrame:
    """The row of least ``order`` of each region."""
    rest = [c for c in rows.columns if c not in (*keys, region)]
    return rows.groupBy(*keys, region).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, region, "row.*")


def largest(rows: DataFrame, size: Column, order: str, keys: list[str] = KEYS) -> DataFrame:
    """The row of greatest ``size`` of each structure, of equal ones that of least ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct((-size).alias("size"), F.col(order).alias("first"), F.struct(*rest).alias("row")))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.row.*")


def formula(members: DataFrame, by: list[str], divisor: Column | None = None) -> DataFrame:
    """Hill formula of each group of (element) rows: carbon, hydrogen, then by name; counts over a divisor. A count of 1 isn't written."""
    n = F.count("*") if divisor is None else (F.count("*") / F.first(divisor))
    counted = members.groupBy(*by, "element").agg(n.cast("long").alias("n"))
    place = F.when(F.col("element") == "C", 0).when(F.col("element") == "H", 1).otherwise(2)
    listed = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "element", "n"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["element"], F.when(p["n"] == 1, "").otherwise(p["n"].cast("string")))), "")
    return listed.select(*by, text.alias("formula"), F.transform("parts", lambda p: p["n"]).alias("element_counts"), F.transform("parts", lambda p: F.struct(p["element"].alias("element"), p["n"].alias("n"))).alias("elements"))


def repeat_units(counts: Column, contacts: Column, periodic: Column) -> Column:
    """Greatest common divisor of element counts and contacts for a periodic component, else 1."""
    return F.when(periodic, F.greatest(gcd_all(F.concat(counts, F.array(contacts.cast("long")))), F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long"))


def agreed(values: Column, otherwise: str = "MISMATCH") -> Column:
    """The one value of a group, or a word if there are several."""
    return F.when(F.count_distinct(values) == 1, F.min(values)).otherwise(F.lit(otherwise))
