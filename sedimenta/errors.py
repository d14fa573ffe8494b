"""Failures with stable codes, and diagnostics with spans of query text."""

from __future__ import annotations

from dataclasses import dataclass

#: The closed set of diagnostic codes.
DIAGNOSTICS = (
    "QUERY_SYNTAX_ERROR",
    "QUERY_SOURCE_NOT_FOUND",
    "QUERY_FIELD_NOT_FOUND",
    "QUERY_TIME_EXPRESSION_INVALID",
    "QUERY_TIME_BOUND_UNRESOLVED",
    "QUERY_TIME_RANGE_INVALID",
    "QUERY_LITERAL_INVALID",
    "QUERY_FUNCTION_ARITY_INVALID",
    "QUERY_FUNCTION_ARGUMENT_TYPE_INVALID",
    "QUERY_CAST_INVALID",
    "QUERY_PROJECTION_ALIAS_REQUIRED",
    "QUERY_AGGREGATE_ALIAS_REQUIRED",
    "QUERY_DUPLICATE_OUTPUT_FIELD",
    "QUERY_STAGE_ORDER_INVALID",
    "QUERY_TAKE_INVALID",
    "QUERY_TYPE_MISMATCH",
    "QUERY_CONSTANT_EVALUATION_FAILED",
)


@dataclass(frozen=True, order=True)
class Span:
    """Half-open range of UTF-8 bytes."""

    start: int
    end: int

    def to(self, other: Span) -> Span:
        return Span(self.start, other.end)


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    span: Span
    severity: str = "ERROR"

    def place(self, text: str) -> tuple[int, int]:
        """Line and column, both from one, the column in code points."""
        before = text.encode()[: self.span.start].decode(errors="ignore")
        line = before.count("\n") + 1
        return line, len(before) - (before.rfind("\n") + 1) + 1


class EngineError(Exception):
    """A failure with a stable code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message = code, message


class QueryError(EngineError):
    """A query that can't be parsed (QUERY_SYNTAX_ERROR) or analysed (QUERY_SEMANTIC_ERROR)."""

    def __init__(self, diagnostics: list[Diagnostic]):
        syntax = diagnostics[0].code == "QUERY_SYNTAX_ERROR"
        super().__init__("QUERY_SYNTAX_ERROR" if syntax else "QUERY_SEMANTIC_ERROR", diagnostics[0].message)
        self.diagnostics = sorted(diagnostics, key=lambda d: (d.span, d.severity, d.code))


def fail(code: str, message: str, span: Span):
    if code not in DIAGNOSTICS:
        raise AssertionError(code)
    raise QueryError([Diagnostic(code, message, span)])
