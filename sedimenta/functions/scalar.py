"""Typed expressions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import ir
from ..lang.times import EPOCH
from ..types import FLOATS, SPARK, UNSIGNED, Field, Logical
from . import casts
from .guards import failing, EVALUATION, finite, in_range

L = Logical
COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def constant(v: ir.Value) -> Column:
    if v.value is None:
        return F.lit(None).cast(SPARK[v.type])
    if v.type == L.DATETIME:
        return F.lit(EPOCH + timedelta(milliseconds=v.value))
    if v.type == L.EID:
        return F.lit(bytearray(v.value))
    if v.type in (L.UINT32, L.UINT64, L.INT64):
        return F.lit(str(v.value)).cast(SPARK[v.type])
    return F.lit(v.value).cast(SPARK[v.type])


def arithmetic(op: str, a: Column, b: Column, kind: Logical) -> Column:
    if kind in FLOATS:
        zero = failing(EVALUATION, kind)
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b == 0, zero).otherwise(a / b)}[op]()
        return finite(out.cast(SPARK[kind]), kind)
    if op == "/":
        if kind == L.UINT64:
            return ((a - a % b) / b).cast(SPARK[kind])
        return F.call_function("div", a, b).cast(SPARK[kind])
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
    return in_range(out, kind) if kind in UNSIGNED else out


def expression(e, column: Callable[[Field], Column]) -> Column:
    """column: gives the Spark column of a field of the current relation."""
    if isinstance(e, ir.Value):
        return constant(e)
    if isinstance(e, ir.Column):
        return column(e.field)
    if isinstance(e, ir.Remainder):
        rest = column(e.rest)
        return casts.has_member(rest, e.key) if e.exists else casts.member(rest, e.key)
    if isinstance(e, ir.Convert):
        x = expression(e.arg, column)
        if e.mode == "widen":
            return x.cast(SPARK[e.type])
        return (casts.strict if e.mode == "strict" else casts.convert)(x, e.arg.type, e.type)
    args = [expression(a, column) for a in e.args]
    if e.op in COMPARE:
        return COMPARE[e.op](*args)
    if e.op in ("+", "-", "*", "/"):
        return arithmetic(e.op, *args, e.type)
    if e.op == "and":
        return args[0] & args[1]
    if e.op == "or":
        return args[0] | args[1]
    one = {"not": lambda x: ~x, "neg": lambda x: -x, "is_null": lambda x: x.isNull(), "is_not_null": lambda x: x.isNotNull()}
    return one[e.op](args[0])
