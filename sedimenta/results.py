"""Results as JSON: typed values, bounded rows and bytes, with the reason where a result is cut."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame

from .errors import EngineError
from .lang.times import instant_of, spell_instant
from .types import Field, Logical

#: Fixed value: bytes of an encoded row at most.
MOST_ROW_BYTES = 1 << 20


@dataclass
class Result:
    columns: list[dict]
    rows: list[list]
    state: str = "COMPLETE"
    reason: str | None = None
    segments: int = 0
    scanned_bytes: int = 0
    elapsed_ms: int = 0
    extra: dict = field(default_factory=dict)


def encoded(value, kind: Logical):
    """int64 and uint64 as decimal text, since JSON readers may round them; times, ids and json in their canonical spelling."""
    if value is None:
        return None
    if kind in (Logical.INT64, Logical.UINT64):
        return str(int(value) if isinstance(value, Decimal) else value)
    if kind == Logical.DATETIME:
        return spell_instant(instant_of(value) if isinstance(value, datetime) else value)
    if kind == Logical.EID:
        return bytes(value).hex()
    if kind == Logical.JSON:
        return ordered(json.loads(value))
    if kind == Logical.FLOAT32:
        import numpy as np

        return float(str(np.float32(value)))
    return value


def ordered(value):
    if isinstance(value, dict):
        return {k: ordered(value[k]) for k in sorted(value)}
    return [ordered(v) for v in value] if isinstance(value, list) else value


def collect(df: DataFrame, fields: tuple[Field, ...], most_rows: int, most_bytes: int) -> Result:
    """The first rows that fit the bounds.  One row more than allowed is asked for, to tell a whole result from a cut one."""
    out = Result([{"name": f.name, "type": f.type.value, "nullable": f.nullable} for f in fields], [])
    size = 2
    for row in df.limit(min(most_rows + 1, 2**31 - 1)).toLocalIterator(prefetchPartitions=False):
        values = [encoded(v, f.type) for v, f in zip(row, fields, strict=True)]
        for v, f in zip(values, fields, strict=True):
            if v is None and not f.nullable:
                raise EngineError("CATALOG_CORRUPT", f"{f.name} holds a null")
        n = len(json.dumps(values, ensure_ascii=False, separators=(",", ":")).encode())
        if n > MOST_ROW_BYTES:
            raise EngineError("QUERY_RESOURCE_LIMIT_EXCEEDED", f"a row has over {MOST_ROW_BYTES} bytes")
        if len(out.rows) == most_rows:
            out.state, out.reason = "TRUNCATED", "OUTPUT_ROWS"
            break
        if size + n + (1 if out.rows else 0) > most_bytes:
            out.state, out.reason = "TRUNCATED", "OUTPUT_BYTES"
            break
        size += n + (1 if out.rows else 0)
        out.rows.append(values)
    return out
