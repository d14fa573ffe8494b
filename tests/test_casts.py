"""Casts and checked arithmetic against a plain model."""

import math
import struct
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.engine import Engine
from sedimenta.errors import EngineError
from sedimenta.functions.casts import convert, spell_float
from sedimenta.lang.constants import nearest_float32, truncated
from sedimenta.lang.times import parse_instant, spell_instant
from sedimenta.sources.bindings import bind
from sedimenta.types import FLOATS, INTEGERS, SPARK, Logical, as_float32

L = Logical
VALUES = {
    L.INT32: [0, 1, -1, 2**31 - 1, -(2**31), 16777217],
    L.INT64: [0, -5, 2**53, 2**53 + 1, 2**63 - 1, -(2**63), 2**62, 4294967296],
    L.UINT32: [0, 4294967295, 16777217],
    L.UINT64: [0, 2**64 - 1, 2**63, 2**53 + 1, 2**64 - 2048],
    L.FLOAT32: [0.0, 1.5, -2.0, as_float32(0.1), as_float32(3e38), 16777216.0],
    L.FLOAT64: [0.0, -0.0, 1.5, 0.1, 1e300, -(2.0**63), 2.0**63, 2.0**64, 2.0**53, 3.0, -1.0, 1e-7, 1e20],
}


def model(v, source, target):
    x = Fraction(v)
    if target in INTEGERS:
        low, high = INTEGERS[target]
        return int(x) if x.denominator == 1 and low <= x <= high else None
    y = float(v) if target == L.FLOAT64 else as_float32(float(v)) if source in FLOATS else nearest_float32(x)
    return y if math.isfinite(y) and Fraction(y) == x else None


def test_numeric_casts(spark):
    for source, values in VALUES.items():
        rows = [(Decimal(v) if source == L.UINT64 else v,) for v in values]
        df = spark.createDataFrame(rows, f"x {SPARK[source].simpleString()}")
        targets = list(VALUES)
        for row, v in zip(df.select("x", *[convert(F.col("x"), source, t).alias(t.value) for t in targets]).collect(), values, strict=True):
            for t in targets:
                if t != source:
                    want, got = model(v, source, t), row[t.value]
                    assert (got is None) == (want is None) and (got is None or float(got) == float(want) and (t not in INTEGERS or int(got) == want)), (source, t, v, got, want)


TEXTS = {
    "12": {L.INT32: 12, L.UINT64: 12, L.FLOAT64: 12.0}, "-12": {L.INT32: -12, L.INT64: -12, L.FLOAT64: -12.0}, "+12": {}, " 12": {}, "1.5": {L.FLOAT64: 1.5}, "1e3": {L.FLOAT64: 1000.0},
    "007": {L.INT32: 7, L.UINT64: 7}, "18446744073709551615": {L.UINT64: 2**64 - 1, L.FLOAT64: 1.8446744073709552e19}, "9223372036854775808": {L.UINT64: 2**63, L.FLOAT64: 2.0**63}, "NaN": {}, "1d": {}, ".5": {}, "1e999": {},
    "true": {L.BOOL: True}, "True": {}, "t": {}, "": {}, "00000000000000000000000000000000000000000001": {L.INT32: 1, L.UINT64: 1},
}


def test_text_casts(spark):
    df = spark.createDataFrame([(k,) for k in TEXTS], "x string")
    kinds = [L.BOOL, L.INT32, L.INT64, L.UINT64, L.FLOAT64]
    for row in df.select("x", *[convert(F.col("x"), L.UTF8, t).alias(t.value) for t in kinds]).collect():
        want = TEXTS[row["x"]]
        for t in kinds:
            expected = want.get(t, want.get(L.INT32) if t == L.INT64 else None)
            got = row[t.value]
            assert got == expected if got is None or expected is None else float(got) == float(expected), (row["x"], t, got)


def test_time_text(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01t00:00:00.123z", "2024-01-01T00:00:00.1234Z", "2024-01-01T00:00:00.1230000Z", "2024-01-01T23:30:00+23:30", "2024-01-01T00:00:00-05:00", "2024-01-01", "2024-1-1T00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00+24:00"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", F.unix_millis(convert(F.col("x"), L.UTF8, L.DATETIME)).alias("ms")).collect():
        assert row["ms"] == parse_instant(row["x"]), row["x"]
    assert spell_instant(parse_instant("2024-01-01T02:00:00.5+01:00")) == "2024-01-01T01:00:00.500Z"


def test_json_casts(spark):
    cases = [("null", {}), ('"12"', {L.INT64: 12, L.UTF8: "12", L.FLOAT64: 12.0}), ("12", {L.INT64: 12, L.FLOAT64: 12.0}), ("1.0", {L.INT64: 1, L.FLOAT64: 1.0}), ("1.5", {L.FLOAT64: 1.5}), ("true", {L.BOOL: True, L.UTF8: "true"}), ('"true"', {L.BOOL: True, L.UTF8: "true"}), ("[1]", {}), ('{"a":1}', {}), ("9007199254740993", {L.INT64: 9007199254740993}), ('"\\u00e9\\n"', {L.UTF8: "é\n"})]
    df = spark.createDataFrame([(c,) for c, _ in cases], "x string")
    kinds = [L.BOOL, L.INT64, L.FLOAT64, L.UTF8]
    for row, (text, want) in zip(df.select(*[convert(F.col("x"), L.JSON, t).alias(t.value) for t in kinds]).collect(), cases, strict=True):
        for t in kinds:
            assert row[t.value] == want.get(t), (text, t)


def test_to_json(spark):
    row = spark.createDataFrame([('a"\n', 1.5, True)], "s string, d double, b boolean").select(convert(F.col("s"), L.UTF8, L.JSON), convert(F.col("d"), L.FLOAT64, L.JSON), convert(F.col("b"), L.BOOL, L.JSON)).first()
    assert tuple(row) == ('"a\\"\\n"', "1.5", "true")


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_spelling_reads_back(x):
    text = spell_float(x)
    assert float(text) == x and ("e" in text or "." in text)


def test_float_spellings():
    cases = {1.0: "1.0", 1e20: "1e20", 1e-7: "1e-7", 1.5e300: "1.5e300", 0.00001: "0.00001", 123456789.125: "123456789.125", 1e15: "1000000000000000.0", 1e16: "1e16", -2.5: "-2.5", 0.0: "0.0", 1.2e-6: "1.2e-6"}
    assert {k: spell_float(k) for k in cases} == cases


@given(st.fractions(min_value=Fraction(-(10**30)), max_value=Fraction(10**30)))
def test_float32_is_the_nearest(x):
    got = nearest_float32(x)
    bits = struct.unpack("<i", struct.pack("<f", got))[0]
    for other in (bits - 1, bits + 1):
        if -(2**31) <= other < 2**31:
            y = struct.unpack("<f", struct.pack("<i", other))[0]
            if math.isfinite(y):
                assert abs(Fraction(got) - x) <= abs(Fraction(y) - x)


@given(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1).filter(bool))
def test_division_truncates(a, b):
    assert truncated(a, b) == int(Fraction(a, b))


@pytest.fixture(scope="module")
def numbers(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t, 2147483647 AS i, 9223372036854775807L AS l, 1.0e308D AS d, CAST(0 AS DOUBLE) AS z, CAST(3e38 AS FLOAT) AS f, CAST(NULL AS INT) AS n, 'x' AS s")
    engine = Engine(spark)
    engine.bind(bind("numbers", df, "t"))
    return engine


@pytest.mark.parametrize("text", ["i + 1", "i * i", "l + 1", "-l - 2", "i / 0", "l / (l - l)", "d * 10.0", "d / z", "f * f", "cast(i as uint32) - cast(l as uint32)", "uint32(1) - cast(i as uint32)", "cast(l as uint64) * uint64(3)", "uint64(0) - cast(i as uint64)"])
def test_arithmetic_fails(numbers, text):
    with pytest.raises(EngineError) as error:
        numbers.query(f"source numbers | project x = {text}", "2023-01-01T00:00:00Z", "2025-01-01T00:00:00Z")
    assert error.value.code in ("QUERY_EVALUATION_FAILED", "QUERY_CAST_FAILED")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("-7 / int64(2)", "-3"), ("(0 - l) / 2", "-4611686018427387903"), ("n + 1", None), ("i == null or n == null", True), ("cast(l as uint64) * uint64(2)", "18446744073709551614"), ("cast(l as uint64) / uint64(2)", "4611686018427387903"),
        ("f / f", 1.0), ("true and n == 1", None), ("false and n == 1", False), ("n == 1 or true", True), ("not (n == 1)", None), ("cast(s as json)", "x"), ('try_cast("2024-01-01T00:00:00.000Z" as datetime)', "2024-01-01T00:00:00.000Z"), ("cast(f as utf8)", "3e38"), ("i + f", 2147483647 + as_float32(3e38)),
    ],
)
def test_values(numbers, text, want):
    assert numbers.query(f"source numbers | project x = {text}", "2023-01-01T00:00:00Z", "2025-01-01T00:00:00Z").rows == [[want]]
