"""Logical types of the query language and the catalog, their widening rules and their Spark carriers.

uint32 is carried by a long and uint64 by decimal(20, 0), as Spark's Parquet reader gives them; both are range-checked after every
operation.  json is carried as JSON text.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Logical(str, Enum):
    BOOL = "bool"
    INT32 = "int32"
    INT64 = "int64"
    UINT32 = "uint32"
    UINT64 = "uint64"
    FLOAT32 = "float32"
    FLOAT64 = "float64"
    UTF8 = "utf8"
    DATETIME = "datetime"
    EID = "eid"
    JSON = "json"

    def __str__(self) -> str:
        return self.value


L = Logical
INTEGERS = {L.INT32: (-(2**31), 2**31 - 1), L.INT64: (-(2**63), 2**63 - 1), L.UINT32: (0, 2**32 - 1), L.UINT64: (0, 2**64 - 1)}
UNSIGNED = {L.UINT32, L.UINT64}
FLOATS = {L.FLOAT32, L.FLOAT64}
NUMERIC = set(INTEGERS) | FLOATS
ORDERED = NUMERIC | {L.UTF8, L.DATETIME, L.EID}
#: Types that a schema may declare.
DECLARABLE = [t for t in L if t not in (L.EID, L.JSON)]

SPARK: dict[Logical, T.DataType] = {
    L.BOOL: T.BooleanType(),
    L.INT32: T.IntegerType(),
    L.INT64: T.LongType(),
    L.UINT32: T.LongType(),
    L.UINT64: T.DecimalType(20, 0),
    L.FLOAT32: T.FloatType(),
    L.FLOAT64: T.DoubleType(),
    L.UTF8: T.StringType(),
    L.DATETIME: T.TimestampType(),
    L.EID: T.BinaryType(),
    L.JSON: T.StringType(),
}

#: Types that each type widens to without loss.
WIDENS = {
    L.INT32: (L.INT64, L.FLOAT64),
    L.UINT32: (L.UINT64, L.FLOAT64),
    L.FLOAT32: (L.FLOAT64,),
}


def reaches(a: Logical, b: Logical) -> bool:
    return a == b or any(reaches(x, b) for x in WIDENS.get(a, ()))


def common_type(a: Logical, b: Logical) -> Logical | None:
    """The first numeric type that both widen to."""
    order = (L.INT32, L.UINT32, L.INT64, L.UINT64, L.FLOAT32, L.FLOAT64)
    return next((t for t in order if reaches(a, t) and reaches(b, t)), None)


def castable(a: Logical, b: Logical) -> bool:
    if a == b or L.JSON in (a, b) or b == L.UTF8:
        return True
    if a in NUMERIC and b in NUMERIC:
        return True
    return a == L.UTF8


def as_float32(x: float) -> float:
    """The nearest float32, as a float; infinite beyond its range."""
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


@dataclass(frozen=True)
class Field:
    """A named, typed column of a relation; id is the catalog's identity of a schema field, else None."""

    name: str
    type: Logical
    nullable: bool
    id: str | None = None
    pointer: str | None = None
    description: str | None = None

    @property
    def system(self) -> bool:
        return self.name.startswith("@")


#: Identities of the system fields.
EVENT_TIME = Field("@event_time", L.DATETIME, False, "00000000-0000-7000-8000-000000000001")
INGESTION_TIME = Field("@ingestion_time", L.DATETIME, False, "00000000-0000-7000-8000-000000000002")
EVENT_ID = Field("@event_id", L.EID, False, "00000000-0000-7000-8000-000000000003")
REST = Field("@rest", L.JSON, True, "00000000-0000-7000-8000-000000000004")


def with_system(fields: list[Field]) -> list[Field]:
    return [EVENT_TIME, INGESTION_TIME, EVENT_ID, *fields, REST]


def spark_schema(fields: list[Field], names: list[str] | None = None) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK[f.type], True, {"field_id": f.id} if f.id else None) for n, f in zip(names or [f.name for f in fields], fields, strict=True)])
