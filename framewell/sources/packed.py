"""MessagePack and spreadsheet files as rows: bounded files that are read whole, each by itself."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of the format's sized kinds, with the format of the size.
TEXT, BYTES, LIST, MAP = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}, {0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}, {0xDC: ">H", 0xDD: ">I"}, {0xDE: ">H", 0xDF: ">I"}
# First bytes of plain values and of numbers.
PLAIN, NUMBERS = {0xC0: None, 0xC2: False, 0xC3: True}, {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def pack(value: Any) -> bytes:
    """A value of null, booleans, numbers, text, bytes, lists and mappings as MessagePack."""
    for first, plain in PLAIN.items():
        if value is plain:
            return bytes([first])
    if isinstance(value, int):
        return bytes([value & 0xFF]) if -32 <= value < 128 else bytes([0xD3 if value < 2**63 else 0xCF]) + struct.pack(">q" if value < 2**63 else ">Q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    kinds = {str: TEXT, bytes: BYTES, list: LIST, tuple: LIST, dict: MAP}
    sizes = next((s for kind, s in kinds.items() if isinstance(value, kind)), None)
    if sizes is None:
        raise TypeError(f"no MessagePack form of {type(value).__name__}")
    body = value.encode() if isinstance(value, str) else value
    first, form = next((k, f) for k, f in sizes.items() if len(body) < 256 ** struct.calcsize(f))
    head = bytes([first]) + struct.pack(form, len(body))
    if isinstance(body, bytes):
        return head + body
    return head + b"".join(pack(k) + pack(v) for k, v in body.items()) if isinstance(body, dict) else head + b"".join(map(pack, body))


def unpack(data: bytes) -> Any:
    """The value of one MessagePack text."""
    stream = io.BytesIO(data)

    def sized(form: str) -> int:
        return struct.unpack(form, stream.read(struct.calcsize(form)))[0]

    def mapping(n: int) -> dict:
        return {key: one() for key in (one() for _ in range(n))}

    def one() -> Any:
        first = sized(">B")
        if first < 0x80 or first >= 0xE0:
            return first if first < 0x80 else first - 256
        if first < 0x90:
            return mapping(first & 15)
        if first < 0xA0:
            return [one() for _ in range(first & 15)]
        if first < 0xC0:
            return stream.read(first & 31).decode()
        if first in PLAIN:
            return PLAIN[first]
        if first in NUMBERS:
            return sized(NUMBERS[first])
        if first in TEXT:
            return stream.read(sized(TEXT[first])).decode()
        if first in BYTES:
            return stream.read(sized(BYTES[first]))
        if first in LIST:
            return [one() for _ in range(sized(LIST[first]))]
        if first in MAP:
            return mapping(sized(MAP[first]))
        raise ValueError(f"MessagePack extension {first:#x} isn't read")

    return one()


def read_msgpack(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, json) of files that hold a mapping each: a row for each of its keys, the value as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(unpack(content.as_py()).items())
                yield pa.RecordBatch.from_pydict({"path": [at] * len(rows), "key": pa.array([str(k) for k, _ in rows], pa.string()), "json": pa.array([json.dumps(v) for _, v in rows], pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, key string, json string")


def packed(df: DataFrame, key: str) -> DataFrame:
    """(key, content): each row as a MessagePack mapping of its other columns."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}).alias("json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(json.loads(j)) for j in batch.column(1).to_pylist()], pa.binary())], names=["key", "content"])

    return rows.mapInArrow(run, "key string, content binary")


def cells(content: bytes) -> list[dict[str, str]]:
    """The rows of a workbook's first sheet below its first row, which names the columns; every value as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    rows = []
    for row in sheet.iter(f"{space}row"):
        own = {}
        for cell in row.iter(f"{space}c"):
            text = "".join(t.text or "" for t in cell.iter() if t.tag in (f"{space}v", f"{space}t"))
            own[re.sub("[0-9]", "", cell.get("r", ""))] = shared[int(text)] if cell.get("t") == "s" else text
        rows.append(own)
    return [{name: row.get(column, "") for column, name in rows[0].items()} for row in rows[1:]] if rows else []


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells): rows of the first sheet of workbooks, numbered from 0, as maps from column names to text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = cells(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))], names=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, cells map<string,string>")
