"""Byte encodings of keys, for the encoded order.

Spark's own order of a type is the natural one. The encoded order compares the bytes that a value is stored as:
little-endian numbers, UTF-8 text, raw binary, ticks of 100 ns for times.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = datetime.datetime(1, 1, 1)


def _ticks(delta: datetime.timedelta) -> int:
    return (delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds) * 10


def _decimal(value: Decimal) -> bytes:
    sign, digits, exponent = value.as_tuple()
    number = int("".join(map(str, digits))) * 10 ** max(exponent, 0)
    return struct.pack("<III", number & 0xFFFFFFFF, number >> 32 & 0xFFFFFFFF, number >> 64 & 0xFFFFFFFF) + struct.pack("<I", sign << 31 | max(-exponent, 0) << 16)


def _number(kind: str) -> tuple[Callable, Callable]:
    return (lambda v: struct.pack(kind, v)), (lambda b: struct.unpack(kind, b)[0])


#: Encoder and decoder by type name.
CODECS: dict[str, tuple[Callable, Callable]] = {
    "string": (str.encode, bytes.decode),
    "char": (str.encode, bytes.decode),
    "sbyte": _number("<b"), "byte": _number("<B"), "short": _number("<h"), "ushort": _number("<H"), "int": _number("<i"), "uint": _number("<I"),
    "long": _number("<q"), "ulong": _number("<Q"), "bool": _number("<?"), "float": _number("<f"), "double": _number("<d"),
    "decimal": (_decimal, lambda b: Decimal(int.from_bytes(b[:12], "little") * (-1 if b[15] & 128 else 1)).scaleb(-b[14])),
    "datetime": (lambda v: struct.pack("<q", _ticks(v.replace(tzinfo=None) - _EPOCH)), lambda b: _EPOCH + datetime.timedelta(microseconds=struct.unpack("<q", b)[0] // 10)),
    "timespan": (lambda v: struct.pack("<q", _ticks(v)), lambda b: datetime.timedelta(microseconds=struct.unpack("<q", b)[0] // 10)),
    "guid": (lambda v: uuid.UUID(str(v)).bytes_le, lambda b: uuid.UUID(bytes_le=b)),
    "bytes": (bytes, bytes),
}
_OF_SPARK = {"string": "string", "tinyint": "sbyte", "smallint": "short", "int": "int", "bigint": "long", "boolean": "bool", "float": "float", "double": "double", "binary": "bytes", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def encoded(column: Column, kind: str) -> Column:
    """The bytes of a column by one of ``CODECS``."""
    encode = CODECS[kind][0]

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v is pd.NaT else encode(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v))

    return run(column)


def order_by_encoded(df: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    kind = kind or _OF_SPARK[df.schema[key].dataType.simpleString().split("(")[0]]
    return df.withColumn("__bytes", encoded(F.col(key), kind)).orderBy("__bytes").drop("__bytes")
