"""Aggregates with checked results; all have partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ir import Measure
from ..types import SPARK, Logical
from .guards import finite, in_range

L = Logical


def aggregate(m: Measure, x: Column | None) -> Column:
    if m.function == "count":
        return F.count(F.lit(1) if x is None else x)
    if m.function in ("min", "max"):
        return (F.min if m.function == "min" else F.max)(x)
    if m.function == "avg":
        return finite(F.avg(x.cast("double")), L.FLOAT64)
    total = F.sum(x.cast(SPARK[m.type]))
    if m.type == L.FLOAT64:
        return finite(total, L.FLOAT64)
    return in_range(total, L.UINT64) if m.type == L.UINT64 else total
