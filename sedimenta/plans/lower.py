"""A typed pipeline over a source relation as one DataFrame plan; Catalyst does the rest."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..lang.ir import Pipeline
from ..lang.times import EPOCH
from ..operators.stages import apply
from ..types import SPARK


def check_session(spark: SparkSession) -> None:
    """The rules for overflow and time rely on two settings."""
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise EngineError("QUERY_EXECUTION_FAILED", "spark.sql.ansi.enabled must be true")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise EngineError("QUERY_EXECUTION_FAILED", "spark.sql.session.timeZone must be UTC")


def in_time(column: Column, start: int, end: int) -> Column:
    at = lambda ms: F.lit(EPOCH + timedelta(milliseconds=ms))
    return (column >= at(start)) & (column < at(end))


def lower(pipeline: Pipeline, relation: DataFrame) -> DataFrame:
    """relation: columns c0, c1, … of the source's fields, within the pipeline's time range.  Gives columns named as the output's."""
    out = apply(relation, pipeline.fields, pipeline.stages)
    kinds = [f.dataType for f in out.schema.fields]
    expected = [SPARK[f.type] for f in pipeline.output]
    if kinds != expected:
        raise AssertionError(f"lowering gave {kinds}, analysis {expected}")
    return out.toDF(*[f.name for f in pipeline.output])
