"""The five stages as DataFrame operations.

A relation's columns are called c0, c1, … in the order of its fields, since the language tells names apart by case and Spark doesn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.scalar import expression
from ..lang import ir
from ..types import Field

MOST_LIMIT = 2**31 - 1


def resolver(fields: tuple[Field, ...]):
    places = {f.name: f"c{i}" for i, f in enumerate(fields)}
    return lambda field: F.col(places[field.name])


def numbered(columns: list[Column]) -> list[Column]:
    return [c.alias(f"c{i}") for i, c in enumerate(columns)]


def filtered(df: DataFrame, fields, s: ir.FilterStage) -> DataFrame:
    return df.filter(expression(s.predicate, resolver(fields)))


def projected(df: DataFrame, fields, s: ir.ProjectStage) -> DataFrame:
    return df.select(*numbered([expression(v, resolver(fields)) for v in s.values]))


def ordered(df: DataFrame, fields, s: ir.SortStage) -> DataFrame:
    at = resolver(fields)
    return df.orderBy(*[at(f).desc_nulls_last() if down else at(f).asc_nulls_last() for f, down in s.items])


def limited(df: DataFrame, fields, s: ir.TakeStage) -> DataFrame:
    """A limit beyond Spark's largest is none: it would take a relation of over 2**31 rows to tell."""
    return df.limit(s.count) if s.count <= MOST_LIMIT else df


def summarized(df: DataFrame, fields, s: ir.SummarizeStage) -> DataFrame:
    at = resolver(fields)
    keys = [at(k).alias(f"k{i}") for i, k in enumerate(s.keys)]
    measures = [aggregate(m, at(m.argument) if m.argument else None).alias(f"m{i}") for i, m in enumerate(s.measures)]
    out = df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)
    return out.toDF(*[f"c{i}" for i in range(len(keys) + len(measures))])


STAGES = {ir.FilterStage: filtered, ir.ProjectStage: projected, ir.SortStage: ordered, ir.TakeStage: limited, ir.SummarizeStage: summarized}


def apply(df: DataFrame, fields: tuple[Field, ...], stages: tuple) -> DataFrame:
    """df: columns c0, c1, … of the fields."""

    def step(state, s):
        relation, names = state
        return STAGES[type(s)](relation, names, s), s.output

    return reduce(step, stages, (df, fields))[0]
