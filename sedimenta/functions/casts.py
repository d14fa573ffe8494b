"""Strict conversions between logical types: null where a value has no exact counterpart.

Spark's own casts accept more (blanks, signs, dates without a time, lossy numbers), so each conversion is gated by the shape or by a
round trip.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..types import FLOATS, INTEGERS, NUMERIC, SPARK, UNSIGNED, Logical
from .guards import CAST, failing, whole

L = Logical
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,3})0*)?(?:[Zz]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))$"
TWO32 = float(2**32)


def null(kind: Logical) -> Column:
    return F.lit(None).cast(SPARK[kind])


def spell_float(x: float) -> str:
    """Shortest spelling that reads back as x: plain from 1e-5 up to 1e16, else with an exponent."""
    if x == 0:
        return "-0.0" if str(x)[0] == "-" else "0.0"
    return respelled(repr(x))


def respelled(text: str) -> str:
    sign, text = ("-", text[1:]) if text[0] == "-" else ("", text)
    mantissa, _, exponent = text.partition("e")
    whole_part, _, part = mantissa.partition(".")
    digits = (whole_part + ("" if part == "0" else part)).lstrip("0")
    point = len(whole_part) + int(exponent or 0)
    if whole_part.strip("0") == "":
        leading = len(part) - len(part.lstrip("0"))
        point = int(exponent or 0) - leading
    digits = digits.rstrip("0") or "0"
    if -5 < point <= 16:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        if len(digits) <= point:
            return f"{sign}{digits}{'0' * (point - len(digits))}.0"
        return f"{sign}{digits[:point]}.{digits[point:]}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{point - 1}"


@F.pandas_udf(StringType())
def float64_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else spell_float(float(v)))


@F.pandas_udf(StringType())
def float32_text(x: pd.Series) -> pd.Series:
    import numpy as np

    return x.map(lambda v: None if pd.isna(v) else "0.0" if v == 0 else respelled(np.format_float_scientific(np.float32(v), unique=True, trim="0")))


def double_as_decimal(x: Column) -> Column:
    """A whole double of 0 to 2**64 as decimal(20, 0), exactly."""
    upper = F.floor(x / TWO32)
    lower = x - upper.cast("double") * TWO32
    return (upper.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(20,0)") + lower.cast("long").cast("decimal(20,0)")).cast("decimal(20,0)")


def numeric(x: Column, source: Logical, target: Logical) -> Column:
    carrier = SPARK[target]
    if target in INTEGERS:
        low, high = INTEGERS[target]
        if source in FLOATS:
            d = x.cast("double")
            fits = (d >= float(low)) & (d < float(high + 1)) & (F.floor(d) == d) if target != L.UINT64 else (d >= 0.0) & (d < float(2**64)) & (d % 1.0 == 0.0)
            exact = double_as_decimal(d) if target == L.UINT64 else d.cast("long").cast(carrier)
            return F.when(fits, exact).otherwise(null(target))
        return F.when((x >= whole(low)) & (x <= whole(high)), x.cast(carrier)).otherwise(null(target))
    if source in FLOATS:
        y = x.cast(carrier)
        same = (y.cast("double") == x.cast("double")) & ~F.isnan(y) & (F.abs(y) != float("inf"))
        return F.when(same, y).otherwise(null(target))
    # whole numbers: exact if the way back gives the same
    y = x.cast(carrier)
    # the addition keeps the optimizer from reading int to float to double as int to double
    d = (y + F.lit(0).cast(carrier)).cast("double")
    if source == L.UINT64:
        back = F.when(d < float(2**64), double_as_decimal(d))
    else:
        back = F.when((d < float(2**63)) & (d >= -float(2**63)), d.cast("long"))
    return F.when(back == x, y).otherwise(null(target))


def from_text(x: Column, target: Logical) -> Column:
    if target == L.UTF8:
        return x
    if target == L.BOOL:
        return F.when(x == "true", F.lit(True)).when(x == "false", F.lit(False))
    if target in INTEGERS:
        shape = r"^[0-9]+$" if target in UNSIGNED else r"^-?[0-9]+$"
        digits = F.regexp_replace(x, r"^(-?)0+(?=[0-9])", "$1")
        value = F.when(F.length(digits) <= 21, digits.try_cast("decimal(21,0)"))
        low, high = INTEGERS[target]
        return F.when(x.rlike(shape) & (value >= whole(low)) & (value <= whole(high)), value.cast(SPARK[target])).otherwise(null(target))
    if target in FLOATS:
        y = x.try_cast("double").cast(SPARK[target])
        return F.when(x.rlike(JSON_NUMBER) & (F.abs(y) != float("inf")), y).otherwise(null(target))
    if target == L.EID:
        return F.when(x.rlike("^[0-9a-f]{32}$"), F.unhex(x)).otherwise(null(target))
    part = lambda i: F.regexp_extract(x, TIME, i)
    base = F.concat(part(1), F.lit("T"), part(2), F.lit("."), F.rpad(part(3), 3, "0"), F.lit("Z")).try_cast("timestamp")
    offset = F.when(part(4) == "", F.lit(0)).otherwise((part(5).try_cast("int") * 60 + part(6).try_cast("int")) * F.when(part(4) == "-", F.lit(-1)).otherwise(F.lit(1)))
    return F.when(x.rlike(TIME) & base.isNotNull(), F.timestamp_micros(F.unix_micros(base) - offset.cast("long") * 60_000_000)).otherwise(null(target))


def to_text(x: Column, source: Logical) -> Column:
    if source == L.UTF8:
        return x
    if source in FLOATS:
        return (float32_text if source == L.FLOAT32 else float64_text)(x)
    if source == L.DATETIME:
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if source == L.EID:
        return F.lower(F.hex(x))
    return x.cast("string")


def quoted(x: Column) -> Column:
    """A JSON string."""
    text = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def from_json(x: Column, target: Logical) -> Column:
    """x: JSON text of any kind.  It is bound to a variable, as the many branches would each evaluate it anew."""
    return F.get(F.transform(F.array(F.trim(x)), lambda text: from_json_text(text, target)), F.lit(0))


def from_json_text(text: Column, target: Logical) -> Column:
    """The first character tells the kind."""
    first = F.substring(text, 1, 1)
    string = F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")
    unwrapped = F.when(first == '"', from_text(string, target))
    if target == L.BOOL:
        return unwrapped.when(text == "true", F.lit(True)).when(text == "false", F.lit(False)).otherwise(null(target))
    if target == L.UTF8:
        return unwrapped.when(text.isin("true", "false"), text).otherwise(null(target))
    if target not in NUMERIC:
        return unwrapped.otherwise(null(target))
    is_whole = text.rlike(r"^-?[0-9]{1,20}$")
    exact = F.when(is_whole, text.try_cast("decimal(20,0)"))
    known = is_whole & (exact >= whole(-(2**63))) & (exact <= whole(2**64 - 1))
    by_float = numeric(F.when(text.rlike(JSON_NUMBER), text.try_cast("double")), L.FLOAT64, target)
    signed = numeric(F.when(exact < whole(2**63), exact.cast("long")), L.INT64, target)
    unsigned = numeric(exact, L.UINT64, target)
    number = F.when(known & (exact < whole(2**63)), signed).when(known, unsigned).otherwise(by_float)
    return unwrapped.when(first.rlike("[-0-9]"), number).otherwise(null(target))


def convert(x: Column, source: Logical, target: Logical) -> Column:
    """The counterpart of x, null if it has none."""
    if source == target:
        return x
    if source == L.JSON:
        return from_json(x, target)
    if target == L.JSON:
        return quoted(to_text(x, source)) if source in (L.UTF8, L.DATETIME, L.EID) else to_text(x, source)
    if target == L.UTF8:
        return to_text(x, source)
    if source == L.UTF8:
        return from_text(x, target)
    return numeric(x, source, target)


def strict(x: Column, source: Logical, target: Logical) -> Column:
    """As convert, but a value without a counterpart fails the query; JSON null is null."""
    if source == target:
        return x
    out = convert(x, source, target)
    absent = x.isNull() | (F.trim(x) == "null") if source == L.JSON else x.isNull()
    return F.when(absent, null(target)).when(out.isNull(), failing(CAST, target)).otherwise(out)


def member(rest: Column, key: str) -> Column:
    """JSON text of a top-level member of an object's JSON text: null if absent, ``null`` if JSON null."""
    path = "$[" + ("'" + key + "'" if "'" not in key else json.dumps(key, ensure_ascii=False)) + "]"
    if "'" in key and ('"' in key or "\\" in key):
        return odd_member(rest, F.lit(key))
    if not key:
        return odd_member(rest, F.lit(key))
    return F.to_json(F.try_variant_get(F.try_parse_json(rest), path, "variant"))


@F.pandas_udf(StringType())
def odd_member(rest: pd.Series, key: pd.Series) -> pd.Series:
    """For keys that no variant path can spell."""

    def one(text, k):
        found = json.loads(text) if text is not None else {}
        return json.dumps(found[k], ensure_ascii=False, separators=(",", ":")) if k in found else None

    return pd.Series([one(t, k) for t, k in zip(rest, key, strict=True)], dtype=object)


def has_member(rest: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(rest), key), F.lit(False))
