"""Exact integers: greatest common divisors, ratios as text, floor division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of Euclid's algorithm that any two 64-bit integers need at most.
STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative integers."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(F.pmod(s["a"], F.nullif(s["b"], F.lit(0)))).cast("long").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["a"])


def gcd_all(values: Column) -> Column:
    """Greatest common divisor of an array of non-negative integers; 0 of an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: gcd(F.greatest(s, x.cast("long")), F.least(s, x.cast("long"))))


def ratio(count: Column, of: Column) -> Column:
    """``count / of`` as a reduced fraction in text: ``"6"`` or ``"1/24"``."""
    g = F.greatest(gcd(F.greatest(count, of), F.least(count, of)), F.lit(1).cast("long"))
    top, bottom = (count / g).cast("long"), (of / g).cast("long")
    return F.when(bottom == 1, top.cast("string")).otherwise(F.concat_ws("/", top.cast("string"), bottom.cast("string")))


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded down, also for negative numbers."""
    return F.floor(a / b).cast("int")
