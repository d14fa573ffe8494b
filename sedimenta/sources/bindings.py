"""Sources over given DataFrames: a time column and typed columns stand for events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lower import in_time
from ..types import SPARK, Field, Logical, with_system


@dataclass
class BoundSource:
    """columns: Spark columns of the user fields, in the order of ``fields``; rest: JSON text or None."""

    name: str
    df: DataFrame
    time: str
    user_fields: list[Field]
    columns: list[Column]
    rest: Column | None = None
    event_id: Column | None = None
    fields: list[Field] = field(init=False)

    def __post_init__(self):
        self.fields = with_system(self.user_fields)

    def relation(self, start: int, end: int) -> DataFrame:
        """The range is tested on the raw column, so that it reaches the scan; as bounds are whole milliseconds, that is the same as
        testing the truncated time."""
        raw = F.col(self.time)
        if dict(self.df.dtypes)[self.time] == "timestamp_ntz":
            # bounds of the column's own type, else the cast would keep the range from the scan
            low, high = (F.lit(ms).cast("long") for ms in (start, end))
            ntz = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
            rows = self.df.filter((raw >= ntz(low)) & (raw < ntz(high)))
        else:
            rows = self.df.filter(in_time(raw, start, end))
        time = F.date_trunc("millisecond", raw.cast("timestamp"))
        eid = self.event_id if self.event_id is not None else F.lit(None).cast("binary")
        rest = self.rest if self.rest is not None else F.lit(None).cast("string")
        columns = [time, F.lit(0).cast("timestamp"), eid, *self.columns, rest]
        return rows.select(*[c.cast(SPARK[f.type]).alias(f"c{i}") for i, (c, f) in enumerate(zip(columns, self.fields, strict=True))])


def bind(name: str, df: DataFrame, time: str, rest: str | None = None, numbered_by: str | None = None) -> BoundSource:
    """A source of all columns of df whose types are logical ones, under their own names."""
    kinds = {"boolean": Logical.BOOL, "int": Logical.INT32, "bigint": Logical.INT64, "float": Logical.FLOAT32, "double": Logical.FLOAT64, "string": Logical.UTF8, "timestamp": Logical.DATETIME, "timestamp_ntz": Logical.DATETIME}
    own = [(c, kinds[t]) for c, t in df.dtypes if t in kinds and c not in (time, rest)]
    eid = F.unhex(F.lpad(F.hex(F.col(numbered_by)), 32, "0")) if numbered_by else None
    return BoundSource(name, df, time, [Field(c, t, True) for c, t in own], [F.col(c) for c, _ in own], F.col(rest) if rest else None, eid)
