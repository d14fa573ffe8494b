"""Ingestion: bodies are kept first, then read into segments and dead letters.

An acknowledged body is an immutable file of the spool, or one that landed, named in the manifest with its digest and the profile it was
admitted under.  Processing
reads any number of waiting bodies as one Spark job; segments, dead letters and the end of the wait are published by one manifest
version, so that a body counts once, however often a job is tried.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.guards import engine_error
from ..types import EVENT_ID, Logical
from .catalog import SourceDefinition
from .normalize import Accepted, Normalizer
from .store import CHECKS, Store, columns_of, dead_letter_key, digest, now_ms

#: Records and rows of a segment at most.
MOST_RECORDS, SEGMENT_ROWS = 100_000, 50_000
#: Bodies of a job, and bytes of rows that one task writes, about.
JOB_BATCHES, TASK_BYTES = 1_000, 64 << 20
#: Names the batch of a file.
NAMES = uuid.UUID("6f1d7c1e-36c1-4a58-9a1c-0f3c2f2d9b11")
ARROW = {
    Logical.BOOL: pa.bool_(), Logical.INT32: pa.int32(), Logical.INT64: pa.int64(), Logical.UINT32: pa.int64(), Logical.UINT64: pa.decimal128(20, 0),
    Logical.FLOAT32: pa.float32(), Logical.FLOAT64: pa.float64(), Logical.UTF8: pa.string(), Logical.DATETIME: pa.timestamp("us", "UTC"), Logical.EID: pa.binary(), Logical.JSON: pa.string(),
}


def spool_key(batch: str) -> str:
    return f"spool/{batch}.ndjson"


def framed(body: bytes) -> int:
    """Records of a body, blank ones included."""
    return body.count(b"\n") + (bool(body) and not body.endswith(b"\n"))


def admit(store: Store, source: str, input_name: str, body: bytes, most_bytes: int = 64 << 20, at: int | None = None) -> dict:
    """Keeps a body and names it in the manifest.  What a batch reads by is pinned now."""
    if len(body) > most_bytes or framed(body) > MOST_RECORDS:
        raise EngineError("INGESTION_BATCH_LIMIT_EXCEEDED")
    definition = store.sources().get(source)
    if definition is None:
        raise EngineError("SOURCE_NOT_FOUND", source)
    entry = definition.input(input_name)
    batch = str(uuid.uuid4())
    if not store.files.write_new(spool_key(batch), body):
        raise EngineError("CAPACITY_EXHAUSTED", "the body couldn't be kept")
    row = {"source": definition.name, "input": entry.name, "revision": entry.active, "schema": entry.profile().target, "time": now_ms() if at is None else at, "bytes": len(body), "digest": digest(body), "state": "DURABLY_QUEUED"}
    store.change(lambda state: state["batches"].__setitem__(batch, row))
    return {"batch_id": batch, "ingestion_time": row["time"], "body_bytes": len(body), "state": row["state"]}


def admit_files(store: Store, source: str, input_name: str, files: DataFrame) -> int:
    """Names finished files (columns path and content, as Spark's binaryFile has them) as batches; the number of new ones.

    Executors read the files; only paths, lengths and digests come here, and one manifest version names them all.  The files stay where
    they are and must not change: processing holds them against the digest.  A file's batch is named by its path, so that a file that
    comes again is known already."""
    entry = store.sources()[source].input(input_name)
    rows = files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("digest")).collect()
    at = now_ms()

    def step(state: dict) -> int:
        seen, n = state.setdefault("landed", {}), 0
        for r in rows:
            batch = str(uuid.uuid5(NAMES, f"{source}/{input_name}/{r['path']}"))
            if batch not in seen:
                seen[batch], n = at, n + 1
                state["batches"][batch] = {"source": source, "input": input_name, "revision": entry.active, "schema": entry.profile().target, "time": at, "bytes": r["bytes"], "digest": r["digest"], "path": r["path"], "state": "DURABLY_QUEUED"}
        return n

    return store.change(step)


def unglobbed(path: str) -> str:
    """A path as Spark's readers take it, which read some characters as patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def process(store: Store, data_ttl: int | None = None) -> dict:
    """Reads all waiting bodies.  data_ttl: milliseconds after which what they hold expires."""
    state = store.state()
    waiting = [(k, v) for k, v in sorted(state["batches"].items()) if v["state"] == "DURABLY_QUEUED"]
    done = {"batches": 0, "accepted": 0, "rejected": 0, "segments": 0}
    groups: dict[tuple, list[str]] = {}
    for batch, row in waiting:
        groups.setdefault((row["source"], row["input"], row["revision"]), []).append(batch)
    for (source, input_name, revision), batches in groups.items():
        for i in range(0, len(batches), JOB_BATCHES):
            part = {b: state["batches"][b] for b in batches[i : i + JOB_BATCHES]}
            for k, v in process_some(store, store.sources(state)[source], input_name, revision, part, data_ttl).items():
                done[k] += v
    return done


def process_some(store: Store, source: SourceDefinition, input_name: str, revision: int, batches: dict[str, dict], data_ttl: int | None) -> dict:
    spark = store.spark
    profile = source.input(input_name).profile(revision)
    schema = source.schema(profile.target)
    fields = schema.all_fields
    times, digests = ({b: r.get(k) for b, r in batches.items()} for k in ("time", "digest"))
    landed = {r["path"]: b for b, r in batches.items() if "path" in r}
    names = ["batch", "letter", "day", "size", *(f.id for f in fields)]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *(ARROW[f.type] for f in fields)]
    kinds = [None] * 4 + [f.type for f in fields]

    def column(values: tuple, kind: Logical | None, type_: pa.DataType) -> pa.Array:
        if kind == Logical.DATETIME:  # milliseconds, below 2^53
            return pa.array([None if v is None else 1000 * v for v in values], pa.int64()).cast(type_)
        if kind == Logical.UINT64:
            from decimal import Decimal

            return pa.array([None if v is None else Decimal(v) for v in values], type_)
        return pa.array(values, type_)

    def read(parts):
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                batch = landed.get(path) or path.rsplit("/", 1)[1].removesuffix(".ndjson")
                body = content.as_py()
                if digests[batch] not in (None, digest(body)):
                    raise EngineError("PUBLISHED_OBJECT_CORRUPT", f"{path} is not the body that was admitted")
                normalizer = Normalizer(schema, profile, uuid.UUID(batch).bytes)
                rows: list[tuple] = []
                for r in normalizer.records(body):
                    if isinstance(r, Accepted):
                        rows.append((batch, None, r.day, r.size, r.time, times[batch], r.id, *r.values, r.rest))  # as with_system has them
                    else:
                        rows.append((batch, json.dumps(r.entry(batch), ensure_ascii=False), None, None, *[None] * len(fields)))
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([column(c, k, t) for c, k, t in zip(zip(*rows, strict=True), kinds, types, strict=True)], names=names)

    out_schema = columns_of(schema)
    out_schema.fields = [*spark.createDataFrame([], "batch string, letter string, day long, size long").schema.fields, *out_schema.fields]
    out_schema.names = [f.name for f in out_schema.fields]
    bodies = spark.read.format("binaryFile").load([unglobbed(r["path"]) if "path" in r else store.files.at(spool_key(b)) for b, r in batches.items()]).select("path", "content")
    # written once, so that accepted and rejected records come from the same reading
    normal = f"staging/{uuid.uuid4()}"
    try:
        bodies.mapInArrow(read, out_schema).withColumn("rejected", F.col("letter").isNotNull()).write.partitionBy("rejected").parquet(store.files.at(normal))
    except Exception as error:  # all bodies wait on
        store.files.delete(normal, True)
        raise engine_error(error) from error
    found = store.files.names(normal)
    entries, letters, accepted, rejected = [], [], 0, 0
    if "rejected=false" in found:
        rows = spark.read.schema(out_schema).parquet(store.files.at(f"{normal}/rejected=false")).drop("batch", "letter")
        total = rows.agg(F.sum("size")).first()[0]
        # a busy day is dealt over as many tasks as its rows ask for
        salt = F.pmod(F.xxhash64(F.col(f"`{EVENT_ID.id}`")), F.lit(max(1, total // TASK_BYTES)))
        entries = store.write_segments(rows.repartition(F.col("day"), salt), source, schema, SEGMENT_ROWS)
        accepted = sum(s["rows"] for s in entries)
    if "rejected=true" in found:
        dead = spark.read.schema(out_schema).parquet(store.files.at(f"{normal}/rejected=true")).select("batch", "letter")
        at = F.get_json_object("letter", "$.position").cast("long")
        texts = f"staging/{uuid.uuid4()}"
        dead.withColumn("at", at).repartition("batch").sortWithinPartitions("batch", "at").select("batch", "letter").write.partitionBy("batch").text(store.files.at(texts))
        rejected = dead.count()

        def adopted(folder: str) -> dict:
            (name,) = store.files.names(f"{texts}/{folder}")
            entry = {"batch": folder.removeprefix("batch="), "object": str(uuid.uuid4()), "source": source.id, "published_at": now_ms()}
            store.files.move(store.files.at(f"{texts}/{folder}/{name}"), dead_letter_key(entry))
            return entry | {"bytes": store.files.size(dead_letter_key(entry))}

        with ThreadPoolExecutor(CHECKS) as pool:
            letters = list(pool.map(adopted, store.files.names(texts)))
        store.files.delete(texts, True)
    store.files.delete(normal, True)
    at = now_ms()

    def publish(state: dict) -> bool:
        if any(state["batches"].get(b, {}).get("state") != "DURABLY_QUEUED" for b in batches):
            return False  # another job was faster
        for s in entries:
            state["segments"].append(s | {"published_at": at, "expires_at": None if data_ttl is None else at + data_ttl})
        state["dead_letters"] += [e | {"expires_at": None if data_ttl is None else at + data_ttl} for e in letters]
        for b in batches:
            del state["batches"][b]
        return True

    if not store.change(publish):
        return {}
    for b, r in batches.items():
        if "path" not in r:  # files that landed are their owner's
            store.files.delete(spool_key(b))
    return {"batches": len(batches), "accepted": accepted, "rejected": rejected, "segments": len(entries)}
