"""Names, keys and canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_stem(name: Column, default: str = "structure") -> Column:
    """White space and unusual characters as ``_``."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", "_"), "[^A-Za-z0-9_.-]", "_")
    return F.when(stem == "", default).otherwise(stem)


def base_name(path: Column) -> Column:
    """The last part of a path, up to its first dot."""
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]


def record_key(path: Column, name: Column | None = None) -> Column:
    """``stem__`` and the first 12 digits of the path's SHA-1."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "") if name is None else name
    return F.concat(safe_stem(stem), F.lit("__"), F.substring(F.sha1(path.cast("binary")), 1, 12))


def rounded(values: Column, decimals: int) -> Column:
    """An array of numbers, rounded half to even."""
    return F.transform(values, lambda x: F.bround(x, decimals))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def is_net_text(text: Column) -> Column:
    """Whether text looks like a net file."""
    upper = F.upper(text)
    return upper.contains("PERIODIC_GRAPH") | upper.contains("CRYSTAL")
