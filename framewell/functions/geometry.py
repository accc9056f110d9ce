"""Points as arrays of three doubles: planes, images, angles, orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(a: Column, b: Column) -> list[Column]:
    return [a[k] - b[k] for k in range(3)]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def planar(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Whether the fourth point lies in the plane of the others; both sides are rounded to whole numbers first."""
    normal = cross(minus(p2, p1), minus(p3, p1))
    dot = lambda v: normal[0] * v[0] + normal[1] * v[1] + normal[2] * v[2]
    return F.bround(dot(p1), 0) == F.bround(dot(p4), 0)


def nearest_image(gap: Column) -> Column:
    """A fractional difference as that to the nearest image, axis by axis."""
    return F.transform(gap, lambda x: x - F.rint(x))


def jittered(angle: Column, seed: int, tolerance: float = 5.0) -> Column:
    """Degrees as radians after a seeded change of at most ``tolerance``."""
    return F.radians(angle + (F.rand(seed) * 2 - 1) * tolerance)


def to_front(values: Column, place: Column) -> Column:
    """An array with the element at ``place`` (from 0) moved to its front."""
    return F.concat(F.slice(values, place + 1, 1), F.slice(values, 1, place), F.slice(values, place + 2, F.greatest(F.size(values) - place - 1, F.lit(0))))


def label_order(label: Column) -> list[Column]:
    """Sort keys that put numeric labels, by value, before others."""
    number = F.when(label.rlike("^[0-9]{1,18}$"), label).cast("long")
    return [number.isNull(), number, label]
