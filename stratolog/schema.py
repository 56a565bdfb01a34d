"""The one fixed row shape of a changelog, its op codes and argument checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OP_PUT = 1
OP_DELETE = 2

CHANGELOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)

#: Bytes of framing per record in the log: op (1), key length (4), value length (4).
FRAME_BYTES = 9


def as_bytes(x, what: str) -> bytes:
    """A key or value as immutable bytes; bytearray is normalised before anything is logged."""
    if not isinstance(x, (bytes, bytearray)):
        raise TypeError(f"{what} must be bytes, not {type(x).__name__}")
    return bytes(x)


def as_bound(x, what: str) -> bytes | None:
    return None if x is None else as_bytes(x, what)


def conform(df: DataFrame) -> DataFrame:
    """The changelog columns of df in order; raises at once if one is missing or of another type."""
    for f in CHANGELOG_SCHEMA:
        if f.name not in df.columns:
            raise ValueError(f"changelog column {f.name} is missing")
        if df.schema[f.name].dataType != f.dataType:
            raise TypeError(f"changelog column {f.name} must be {f.dataType.simpleString()}, not {df.schema[f.name].dataType.simpleString()}")
    return df.select(*CHANGELOG_SCHEMA.names)


def payload_bytes(key="key", value="value"):
    """Bytes that count towards the memtable limit: key plus value, a tombstone's value counting 0."""
    return F.octet_length(F.col(key)) + F.coalesce(F.octet_length(F.col(value)), F.lit(0))
