"""Avro object container files, read without a package, after the published specification.

A file is read by one task, block by block. Codecs: null, deflate, bzip2, xz,
zstandard. Enums and fixed come as strings and binary, unions of null and one
type as that type, nullable; other unions aren't read.
"""

from __future__ import annotations

import bz2
import datetime as dt
import decimal
import json
import lzma
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAGIC = b"Obj\x01"
_UNPACK: dict[str, Callable[[bytes], bytes]] = {
    "null": lambda b: b,
    "deflate": lambda b: zlib.decompress(b, -15),
    "bzip2": bz2.decompress,
    "xz": lzma.decompress,
    "zstandard": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b),
}
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
_PLAIN = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


class _Bytes:
    """A place in a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the Avro file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = out = 0
        while True:
            byte = self.take(1)[0]
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out >> 1 ^ -(out & 1)


def _branch(schema: Any) -> tuple[Any, int | None]:
    """Of a union of null and one type that type and the place of null; else the schema itself."""
    if not isinstance(schema, list):
        return schema, None
    rest = [s for s in schema if s != "null"]
    if len(rest) != 1 or len(schema) > 2:
        raise ValueError(f"only unions of null and one type are read: {schema}")
    return rest[0], schema.index("null") if "null" in schema else None


def spark_type(schema: Any) -> T.DataType:
    """The Spark type of an Avro schema."""
    schema, _ = _branch(schema)
    if isinstance(schema, str):
        return _PLAIN[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical == "date":
        return T.DateType()
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    return T.StringType() if kind == "enum" else T.BinaryType() if kind == "fixed" else spark_type(kind)


def _items(b: _Bytes) -> Iterator[None]:
    while n := b.long():
        if n < 0:
            b.long()  # the size in bytes, for those who skip
        for _ in range(abs(n)):
            yield


def reader(schema: Any) -> Callable[[_Bytes], Any]:
    """A function from a place in a buffer to the value there."""
    inner, null = _branch(schema)
    if isinstance(schema, list):
        read = reader(inner)
        return lambda b: None if b.long() == null else read(b)
    kind, logical = (schema, None) if isinstance(schema, str) else (schema["type"], schema.get("logicalType"))
    if isinstance(kind, dict | list):
        return reader(kind)
    if kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in schema["fields"]]
        return lambda b: {name: read(b) for name, read in fields}
    if kind == "array":
        item = reader(schema["items"])
        return lambda b: [item(b) for _ in _items(b)]
    if kind == "map":
        value = reader(schema["values"])
        return lambda b: {b.take(b.long()).decode(): value(b) for _ in _items(b)}
    if logical == "decimal":
        scale = schema.get("scale", 0)
        size = schema.get("size")
        return lambda b: decimal.Decimal(int.from_bytes(b.take(size if size is not None else b.long()), "big", signed=True)).scaleb(-scale)
    if logical in ("timestamp-millis", "timestamp-micros"):
        unit = 1000 if logical == "timestamp-millis" else 1
        return lambda b: _EPOCH + dt.timedelta(microseconds=b.long() * unit)
    if logical == "date":
        return lambda b: dt.date(1970, 1, 1) + dt.timedelta(days=b.long())
    if kind == "enum":
        symbols = schema["symbols"]
        return lambda b: symbols[b.long()]
    if kind == "fixed":
        return lambda b: b.take(schema["size"])
    return {
        "null": lambda b: None,
        "boolean": lambda b: b.take(1) == b"\1",
        "int": _Bytes.long,
        "long": _Bytes.long,
        "float": lambda b: struct.unpack("<f", b.take(4))[0],
        "double": lambda b: struct.unpack("<d", b.take(8))[0],
        "bytes": lambda b: b.take(b.long()),
        "string": lambda b: b.take(b.long()).decode(),
    }[kind]


def _head(data: bytes) -> tuple[Any, str, bytes, _Bytes]:
    """(schema, codec, sync marker, place of the first block) of a file."""
    b = _Bytes(data)
    if b.take(4) != MAGIC:
        raise ValueError("no Avro file")
    meta = reader({"type": "map", "values": "bytes"})(b)
    if "avro.schema" not in meta:
        raise ValueError("the Avro file has no schema")
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), b.take(16), b


def _blocks(data: bytes) -> Iterator[list[dict]]:
    schema, codec, sync, b = _head(data)
    if codec not in _UNPACK:
        raise ValueError(f"no codec for {codec}")
    row = reader(schema)
    while b.at < len(data):
        n, size = b.long(), b.long()
        block = _Bytes(_UNPACK[codec](b.take(size)))
        yield [row(block) for _ in range(n)]
        if b.take(16) != sync:
            raise ValueError("an Avro block has a wrong sync marker")


def read(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of Avro files; without a schema that of the first file. Columns are found by name, missing ones are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(paths)
    if schema is None:
        first = files.select("content").first()
        if first is None:
            raise ValueError(f"no Avro file in {paths}")
        schema = spark_type(_head(bytes(first.content))[0])
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for rows in _blocks(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in wanted], schema=wanted)

    return files.select("content").mapInArrow(run, schema)


def _long(n: int) -> bytes:
    n = n << 1 ^ n >> 63
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _deflated(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packed.compress(data) + packed.flush()


_PACK: dict[str, Callable[[bytes], bytes]] = {"null": lambda b: b, "deflate": _deflated, "bzip2": bz2.compress, "xz": lzma.compress, "zstandard": lambda b: zstandard.ZstdCompressor().compress(b)}
_WRITE: dict[str, Callable[[Any], bytes]] = {
    "boolean": lambda v: bytes([bool(v)]),
    "int": lambda v: _long(int(v)),
    "long": lambda v: _long(int(v)),
    "float": lambda v: struct.pack("<f", v),
    "double": lambda v: struct.pack("<d", v),
    "bytes": lambda v: _long(len(v)) + bytes(v),
    "string": lambda v: _long(len(v.encode())) + v.encode(),
}


def container(fields: list[tuple[str, Any]], rows: list[tuple], codec: str = "deflate", block_rows: int = 4096) -> bytes:
    """A file of flat rows; fields are (name, Avro type: a name, or a dict with a logicalType date or timestamp-micros), all nullable."""
    schema = {"type": "record", "name": "row", "fields": [{"name": n, "type": ["null", kind]} for n, kind in fields]}

    def cell(kind: Any, v: Any) -> bytes:
        if v is None:
            return _long(0)
        if isinstance(kind, dict):
            v = (v - dt.date(1970, 1, 1)).days if kind["logicalType"] == "date" else (v.replace(tzinfo=v.tzinfo or dt.UTC) - _EPOCH) // dt.timedelta(microseconds=1)
            kind = kind["type"]
        return _long(1) + _WRITE[kind](v)

    sync = os.urandom(16)
    out = [MAGIC, _long(2), _WRITE["string"]("avro.schema"), _WRITE["string"](json.dumps(schema)), _WRITE["string"]("avro.codec"), _WRITE["string"](codec), _long(0), sync]
    for at in range(0, len(rows), block_rows):
        own = rows[at : at + block_rows]
        data = _PACK[codec](b"".join(cell(kind, v) for row in own for (_, kind), v in zip(fields, row, strict=True)))
        out += [_long(len(own)), _long(len(data)), data, sync]
    return b"".join(out)
