"""The store: manifest versions, immutable segments, snapshots and their adaptation to the active schema.

A manifest version is one immutable JSON file; the next one is created whole under the next number, so that of two writers one has to
try again on the new state.  A reader takes one version and never sees half of a change.
"""

from __future__ import annotations

import copy
import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..errors import EngineError
from ..functions.casts import from_json
from ..functions.guards import engine_error
from ..plans.lower import in_time
from ..types import REST, SPARK, Field, Logical
from . import catalog, pointer
from .catalog import Schema, SourceDefinition
from .files import Files

DAY = 86_400_000
#: Segments of a query, and object checks at a time.
MOST_SEGMENTS, CHECKS = 10_000, 16
#: Rows of a row group at most, a fixed value.
GROUP_ROWS = 8192
EMPTY = {"version": 0, "sources": {}, "segments": [], "batches": {}, "dead_letters": [], "runs": []}


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def segment_key(segment: dict) -> str:
    return f"segments/{segment['id']}/{segment['object']}.parquet"


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def dead_letter_key(entry: dict) -> str:
    return f"dead-letters/{entry['batch']}/{entry['object']}.ndjson"


def columns_of(schema: Schema) -> StructType:
    """Columns of a segment's file are named by field identity, which never changes."""
    out = StructType()
    for f in schema.all_fields:
        out.add(f.id, SPARK[f.type], True)
    return out


@dataclass(frozen=True)
class Snapshot:
    """What a query reads: the definition and the exact segments of one manifest version."""

    version: int
    source: SourceDefinition
    segments: tuple[dict, ...]

    @property
    def bytes(self) -> int:
        return sum(s["bytes"] for s in self.segments)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    # manifest versions

    def state(self) -> dict:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if not names:
            return copy.deepcopy(EMPTY)
        try:
            return json.loads(self.files.read(f"manifest/{names[-1]}"))
        except ValueError as error:
            raise EngineError("CATALOG_CORRUPT", str(error)) from error

    def change(self, step: Callable[[dict], object], tries: int = 20):
        """Applies step to the newest state and publishes it; tries again if another writer came first.  step may run more than once."""
        for _ in range(tries):
            state = self.state()
            before = json.dumps(state, sort_keys=True)
            out = step(state)
            if json.dumps(state, sort_keys=True) == before:
                return out
            state["version"] += 1
            check_invariants(state)
            if self.files.write_new(f"manifest/{state['version']:012d}.json", json.dumps(state).encode()):
                return out
        raise EngineError("CAPACITY_EXHAUSTED", "the manifest changes too often")

    # catalog

    def apply_catalog(self, text: str) -> tuple[SourceDefinition, str]:
        new = catalog.read_manifest(text)

        def step(state: dict):
            old = state["sources"].get(new.name)
            definition, outcome = catalog.applied(new, catalog.from_plain(old) if old else None)
            state["sources"][new.name] = catalog.to_plain(definition)
            return definition, outcome

        return self.change(step)

    def sources(self, state: dict | None = None) -> dict[str, SourceDefinition]:
        return {k: catalog.from_plain(v) for k, v in (state or self.state())["sources"].items()}

    # snapshots

    def snapshot(self, state: dict, source: SourceDefinition, start: int, end: int) -> Snapshot:
        found = [s for s in state["segments"] if s["state"] == "ACTIVE" and s["source"] == source.id and s["max"] >= start and s["min"] < end]
        found.sort(key=lambda s: (s["day"], s["id"], s["object"]))
        return Snapshot(state["version"], source, tuple(found))

    def check(self, snapshot: Snapshot, most_bytes: int | None = None) -> None:
        """Before any row: bounds, and that each object is there in its size and with the footer it was published with, which holds its
        schema, its rows and the place and statistics of every column."""
        if len(snapshot.segments) > MOST_SEGMENTS:
            raise EngineError("QUERY_RESOURCE_LIMIT_EXCEEDED", f"over {MOST_SEGMENTS} segments")
        if most_bytes is not None and snapshot.bytes > most_bytes:
            raise EngineError("QUERY_RESOURCE_LIMIT_EXCEEDED", f"{snapshot.bytes} bytes to scan")

        def one(s: dict) -> None:
            size = self.files.size(segment_key(s))
            if size is None:
                raise EngineError("PUBLISHED_OBJECT_MISSING", segment_key(s))
            if size != s["bytes"]:
                raise EngineError("PUBLISHED_OBJECT_CORRUPT", f"{segment_key(s)} has {size} bytes, not {s['bytes']}")
            try:
                footer = digest(self.files.footer(segment_key(s)))
            except Py4JJavaError as error:
                raise engine_error(error) from error
            if s.get("footer") not in (None, footer):
                raise EngineError("PUBLISHED_OBJECT_CORRUPT", f"{segment_key(s)} has another footer")

        with ThreadPoolExecutor(CHECKS) as pool:
            list(pool.map(one, snapshot.segments))

    def contradictions(self, segments: list[dict], source: SourceDefinition) -> DataFrame:
        """file, rows, min, max as stored, where they are not what the manifest says; Parquet statistics answer most of it."""
        parts = []
        for version in sorted({s["schema"] for s in segments}):
            own = [s for s in segments if s["schema"] == version]
            schema = source.schema(version)
            stamp = F.col(f"`{schema.all_fields[0].id}`")
            found = self.stored(schema, own).groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1).alias("object")).agg(F.count(F.lit(1)).alias("rows"), F.unix_millis(F.min(stamp)).alias("min"), F.unix_millis(F.max(stamp)).alias("max"))
            said = self.spark.createDataFrame([(s["object"], s["rows"], s["min"], s["max"]) for s in own], "object string, said_rows long, said_min long, said_max long")
            parts.append(said.join(found, "object", "left").filter("NOT (rows <=> said_rows AND min <=> said_min AND max <=> said_max)"))
        return reduce(DataFrame.unionByName, parts)

    def stored(self, schema: Schema, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema(columns_of(schema)).parquet(*[self.files.at(segment_key(s)) for s in segments])

    def relation(self, snapshot: Snapshot, start: int, end: int) -> DataFrame:
        """Columns c0, c1, … of the active schema: one scan for each stored schema, adapted, and their union."""
        active = snapshot.source.schema()
        parts = []
        for version in sorted({s["schema"] for s in snapshot.segments}):
            stored = snapshot.source.schema(version)
            rows = self.stored(stored, [s for s in snapshot.segments if s["schema"] == version])
            rows = rows.filter(in_time(F.col(f"`{stored.all_fields[0].id}`"), start, end))
            parts.append(rows.select(*[c.alias(f"c{i}") for i, c in enumerate(adapted(stored, active))]))
        if parts:
            return reduce(DataFrame.unionByName, parts)
        empty = StructType()
        for i, f in enumerate(active.all_fields):
            empty.add(f"c{i}", SPARK[f.type], True)
        return self.spark.createDataFrame([], empty)

    def conversion_failures(self, snapshot: Snapshot, start: int, end: int) -> DataFrame:
        """field, type, failures: historical values that are there but don't convert, which read as null."""
        active, parts = snapshot.source.schema(), []
        for version in sorted({s["schema"] for s in snapshot.segments}):
            stored = snapshot.source.schema(version)
            known = {f.id for f in stored.fields}
            old = [f for f in active.fields if f.id not in known and f.pointer is not None]
            if old:
                rows = self.stored(stored, [s for s in snapshot.segments if s["schema"] == version]).filter(in_time(F.col(f"`{stored.all_fields[0].id}`"), start, end))
                for f in old:
                    text = history_text(F.col(f"`{REST.id}`"), f.pointer)
                    failed = text.isNotNull() & (text != "null") & history_value(text, f.type).isNull()
                    parts.append(rows.agg(F.lit(f.name).alias("field"), F.lit(f.type.value).alias("type"), F.count_if(failed).alias("failures")))
        if not parts:
            return self.spark.createDataFrame([], "field string, type string, failures long")
        return reduce(DataFrame.unionByName, parts).groupBy("field", "type").agg(F.sum("failures").alias("failures"))

    # segments

    def write_segments(self, rows: DataFrame, source: SourceDefinition, schema: Schema, most_rows: int) -> list[dict]:
        """Writes rows (columns day, size and the fields by identity) as files sorted by event time and id, one day each, and moves them
        to their keys.  The entries are for the caller to publish."""
        staging = f"staging/{uuid.uuid4()}"
        stamp, eid = (f"`{f.id}`" for f in (schema.all_fields[0], schema.all_fields[2]))
        ordered = rows.sortWithinPartitions("day", stamp, eid)
        with micros(self.spark):
            ordered.write.option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS).option("maxRecordsPerFile", most_rows).partitionBy("day").parquet(self.files.at(staging))
        return self.adopt(staging, source, schema)

    def adopt(self, staging: str, source: SourceDefinition, schema: Schema) -> list[dict]:
        days = [n for n in self.files.names(staging) if n.startswith("day=")]
        if not days:
            self.files.delete(staging, True)
            return []
        stamp = F.col(f"`{schema.all_fields[0].id}`")
        columns = StructType([*columns_of(schema).fields]).add("size", "long")
        written = self.spark.read.schema(columns).parquet(*[self.files.at(f"{staging}/{d}") for d in days])
        facts = written.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.unix_millis(F.min(stamp)).alias("min"), F.unix_millis(F.max(stamp)).alias("max"), F.sum("size").alias("estimated")).collect()

        def one(r) -> dict:
            s = {"id": str(uuid.uuid4()), "object": str(uuid.uuid4()), "source": source.id, "schema": schema.version, "day": r["min"] // DAY, "rows": r["rows"], "min": r["min"], "max": r["max"], "estimated": r["estimated"], "state": "ACTIVE"}
            self.files.move(r["file"], segment_key(s))
            return s | {"bytes": self.files.size(segment_key(s)), "footer": digest(self.files.footer(segment_key(s)))}

        with ThreadPoolExecutor(CHECKS) as pool:
            out = list(pool.map(one, facts))
        self.files.delete(staging, True)
        return out


_writers, _lock = {"n": 0, "old": None}, threading.Lock()


@contextmanager
def micros(spark: SparkSession):
    """Times are written in microseconds; the session's own setting comes back when the last of several writers at a time is done."""
    kind = "spark.sql.parquet.outputTimestampType"
    with _lock:
        if not _writers["n"]:
            _writers["old"] = spark.conf.get(kind)
            spark.conf.set(kind, "TIMESTAMP_MICROS")
        _writers["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(kind, _writers["old"])


def check_invariants(state: dict) -> None:
    """What must hold of every published version."""
    ids = [s["id"] for s in state["segments"]]
    if len(set(ids)) != len(ids):
        raise EngineError("CATALOG_CORRUPT", "a segment is there twice")
    for s in state["segments"]:
        inside = s["day"] * DAY <= s["min"] <= s["max"] < (s["day"] + 1) * DAY
        if not inside or s["rows"] < 1 or (s["state"] in ("SUPERSEDED", "EXPIRED")) != (s.get("reclaim_after") is not None):
            raise EngineError("CATALOG_CORRUPT", f"segment {s['id']} contradicts itself")


def adapted(stored: Schema, active: Schema) -> list[Column]:
    """The active schema's fields from a stored one: the same field, else its past value in @rest, else null."""
    known = {f.id: f for f in stored.all_fields}
    out = []
    for f in active.all_fields:
        if f.id in known:
            if known[f.id].type != f.type:
                raise EngineError("CATALOG_CORRUPT", f"field {f.name} changed its type")
            out.append(F.col(f"`{f.id}`"))
        elif not f.nullable:
            raise EngineError("CATALOG_CORRUPT", f"field {f.name} is required but was never stored")
        elif f.pointer is not None:
            out.append(history_value(history_text(F.col(f"`{REST.id}`"), f.pointer), f.type))
        else:
            out.append(F.lit(None).cast(SPARK[f.type]))
    return out


@F.pandas_udf(StringType())
def pointed(rest: pd.Series, at: pd.Series) -> pd.Series:
    from .normalize import parse_json, spell

    def one(text, steps):
        if text is None:
            return None
        found = pointer.resolve(parse_json(text), steps)
        return None if found is pointer.ABSENT else spell(found)

    steps = pointer.tokens(at.iloc[0]) if len(at) else ()
    return pd.Series([one(t, steps) for t in rest], dtype=object)


def history_text(rest: Column, at: str) -> Column:
    """JSON text of what a pointer leads to; null if absent."""
    steps = pointer.tokens(at)
    plain = all(s and "'" not in s and '"' not in s and "\\" not in s and not s.isdigit() for s in steps)
    if steps and plain:  # members only, which a variant path can spell
        return F.to_json(F.try_variant_get(F.try_parse_json(rest), "$" + "".join(f"['{s}']" for s in steps), "variant"))
    return pointed(rest, F.lit(at))


def history_value(text: Column, kind: Logical) -> Column:
    """As at ingestion, strings and numbers are not converted to each other; times are in RFC 3339."""
    first = F.substring(F.trim(text), 1, 1)
    is_text = first == '"'
    wants_text = kind in (Logical.UTF8, Logical.DATETIME)
    value = from_json(text, kind)
    allowed = is_text if wants_text else first.isin("t", "f") if kind == Logical.BOOL else first.rlike("[-0-9]")
    if kind in (Logical.INT32, Logical.INT64, Logical.UINT32, Logical.UINT64):
        allowed = allowed & F.trim(text).rlike("^-?[0-9]+$")
    if kind == Logical.FLOAT32:  # one rounding is enough here, exactness isn't asked for
        number = F.when(allowed, F.trim(text).try_cast("float"))
        return F.when(F.abs(number) != float("inf"), number)
    if kind == Logical.FLOAT64:
        number = F.when(allowed, F.trim(text).try_cast("double"))
        return F.when(F.abs(number) != float("inf"), number)
    return F.when(allowed, value).otherwise(F.lit(None).cast(SPARK[kind]))


def user_fields(fields: list[Field]) -> list[Field]:
    return [f for f in fields if not f.system]
