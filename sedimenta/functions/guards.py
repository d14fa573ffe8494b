"""Expressions that fail with a stable code, and the mapping of Spark's failures to such codes."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from ..types import INTEGERS, SPARK, Logical

EVALUATION, CAST = "QUERY_EVALUATION_FAILED", "QUERY_CAST_FAILED"
ARITHMETIC = ("ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "REMAINDER_BY_ZERO", "BINARY_ARITHMETIC_OVERFLOW")
MISSING, CORRUPT = ("FAILED_READ_FILE.FILE_NOT_EXIST", "PATH_NOT_FOUND", "FileNotFoundException"), ("CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "is not a Parquet file", "PARQUET", "ChecksumException", "PUBLISHED_OBJECT_CORRUPT")


def failing(code: str, like: Column | Logical) -> Column:
    kind = SPARK[like] if isinstance(like, Logical) else like
    return F.raise_error(F.lit(code)).cast(kind)


def finite(x: Column, kind: Logical) -> Column:
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, failing(EVALUATION, kind)).otherwise(x)


def in_range(x: Column, kind: Logical) -> Column:
    """x as the carrier of an integer type; fails outside its range."""
    low, high = (whole(v) for v in INTEGERS[kind])
    return F.when((x < low) | (x > high), failing(EVALUATION, kind)).otherwise(x).cast(SPARK[kind])


def whole(v: int) -> Column:
    if -(2**31) <= v < 2**31:
        return F.lit(v)
    return F.lit(v).cast("long") if -(2**63) <= v < 2**63 else F.lit(str(v)).cast("decimal(20,0)")


def engine_error(error: Exception) -> EngineError:
    """The failure of a Spark job as one of the engine's."""
    if isinstance(error, EngineError):
        return error
    text = str(error)
    condition = (error.getCondition() if isinstance(error, PySparkException) else None) or ""
    for code in (CAST, EVALUATION):
        if code in text:
            return EngineError(code)
    if any(c in condition or f"[{c}" in text for c in ARITHMETIC):
        return EngineError(EVALUATION, condition)
    if any(c in text for c in MISSING):
        return EngineError("PUBLISHED_OBJECT_MISSING", text[:300])
    if any(c in condition or c in text for c in CORRUPT):
        return EngineError("PUBLISHED_OBJECT_CORRUPT", text[:300])
    if "cancelled" in text.lower():
        return EngineError("QUERY_CANCELLED", text[:300])
    return EngineError("QUERY_EXECUTION_FAILED", text[:2000])
