"""Typed expressions and pipelines: what analysis makes and lowering reads."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..types import Field, Logical


@dataclass(frozen=True)
class Value:
    """A constant; value is None, bool, int, float, str, milliseconds for datetime, bytes for eid."""

    type: Logical
    value: Any

    @property
    def nullable(self) -> bool:
        return self.value is None


@dataclass(frozen=True)
class Column:
    field: Field

    @property
    def type(self) -> Logical:
        return self.field.type

    @property
    def nullable(self) -> bool:
        return self.field.nullable


@dataclass(frozen=True)
class Apply:
    """op: + - * / neg not and or == != < <= > >= is_null is_not_null"""

    op: str
    args: tuple
    type: Logical
    nullable: bool


@dataclass(frozen=True)
class Convert:
    """mode: strict, try or widen"""

    mode: str
    arg: Any
    type: Logical
    nullable: bool


@dataclass(frozen=True)
class Remainder:
    exists: bool
    key: str
    rest: Field
    type: Logical
    nullable: bool


@dataclass(frozen=True)
class Measure:
    name: str
    function: str
    argument: Field | None
    type: Logical
    nullable: bool


@dataclass(frozen=True)
class FilterStage:
    predicate: Any
    output: tuple[Field, ...]


@dataclass(frozen=True)
class ProjectStage:
    values: tuple
    output: tuple[Field, ...]


@dataclass(frozen=True)
class SortStage:
    """items: (field, descending)"""

    items: tuple
    output: tuple[Field, ...]


@dataclass(frozen=True)
class TakeStage:
    count: int
    output: tuple[Field, ...]


@dataclass(frozen=True)
class SummarizeStage:
    keys: tuple[Field, ...]
    measures: tuple[Measure, ...]
    output: tuple[Field, ...]


@dataclass(frozen=True)
class Pipeline:
    """start, end: milliseconds of the half-open range of event times."""

    source: str
    fields: tuple[Field, ...]
    start: int
    end: int
    stages: tuple

    @property
    def output(self) -> tuple[Field, ...]:
        return self.stages[-1].output if self.stages else self.fields
