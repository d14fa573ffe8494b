"""The engine: catalog, ingestion, queries and maintenance over one store."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from . import maintenance
from .errors import EngineError
from .functions.guards import engine_error
from .lang.analysis import TimeContext, analyze
from .lang.ir import Pipeline
from .lang.times import instant_of
from .plans.lower import check_session, lower
from .results import Result, collect
from .sources import ingest
from .sources.bindings import BoundSource
from .sources.store import Snapshot, Store, dead_letter_key, now_ms


@dataclass(frozen=True)
class Limits:
    rows: int = 10_000
    bytes: int = 16 << 20
    scan_bytes: int = 100 << 30
    seconds: float = 30.0


@dataclass
class Planned:
    pipeline: Pipeline
    df: DataFrame
    snapshot: Snapshot | None


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, history: int = 100):
        self.spark = spark
        self.store = Store(spark, root) if root else None
        self.bound: dict[str, BoundSource] = {}
        self._history: deque[dict] = deque(maxlen=history)

    # sources

    def bind(self, source: BoundSource) -> None:
        """Makes a DataFrame queryable under a name, beside the sources of the catalog."""
        self.bound[source.name] = source

    def apply_catalog(self, manifest: str) -> str:
        """CREATED, UPDATED or UNCHANGED."""
        return self.store.apply_catalog(manifest)[1]

    def sources(self) -> list[str]:
        return sorted({*self.bound, *(self.store.sources() if self.store else {})})

    # ingestion

    def ingest(self, source: str, input_name: str, body: bytes, **more) -> dict:
        return ingest.admit(self.store, source, input_name, body, **more)

    def process(self, data_ttl: int | None = None) -> dict:
        return ingest.process(self.store, data_ttl)

    # queries

    def plan(self, text: str, start=None, end=None, now=None, limits: Limits = Limits()) -> Planned:
        """The query as a DataFrame over an exact snapshot.  start, end, now: times, milliseconds or RFC 3339 text."""
        check_session(self.spark)
        ms = lambda t: None if t is None else instant_of(t)
        times = TimeContext(now_ms() if now is None else ms(now), ms(start), ms(end))
        state = self.store.state() if self.store else None
        known = self.store.sources(state) if self.store else {}
        fields = {**{k: d.schema().all_fields for k, d in known.items()}, **{k: b.fields for k, b in self.bound.items()}}
        pipeline = analyze(text, fields, times)
        if pipeline.source in self.bound:
            return Planned(pipeline, lower(pipeline, self.bound[pipeline.source].relation(pipeline.start, pipeline.end)), None)
        snapshot = self.store.snapshot(state, known[pipeline.source], pipeline.start, pipeline.end)
        self.store.check(snapshot, limits.scan_bytes)
        return Planned(pipeline, lower(pipeline, self.store.relation(snapshot, pipeline.start, pipeline.end)), snapshot)

    def query(self, text: str, start=None, end=None, now=None, limits: Limits = Limits(), cancelled: threading.Event | None = None) -> Result:
        """Runs a query to a bounded result.  Beyond its time, or once ``cancelled`` is set, its jobs are stopped."""
        entry = {"id": str(uuid.uuid4()), "text": text, "state": "RUNNING", "started_at": now_ms()}
        self._history.append(entry)
        began = time.monotonic()
        try:
            out = self._run(text, start, end, now, limits, cancelled)
        except Exception as error:
            failure = engine_error(error)
            entry |= {"state": "FAILED", "code": failure.code}
            raise failure from error
        out.elapsed_ms = int(1000 * (time.monotonic() - began))
        entry |= {"state": out.state, "rows": len(out.rows), "elapsed_ms": out.elapsed_ms}
        return out

    def _run(self, text, start, end, now, limits: Limits, cancelled: threading.Event | None) -> Result:
        if cancelled is not None and cancelled.is_set():
            raise EngineError("QUERY_CANCELLED")
        until = time.monotonic() + limits.seconds
        plan = self.plan(text, start, end, now, limits)
        tag = f"query-{uuid.uuid4()}"
        ended, why = threading.Event(), []

        def watch() -> None:
            while not ended.wait(0.02):
                if cancelled is not None and cancelled.is_set():
                    why.append("QUERY_CANCELLED")
                elif time.monotonic() > until:
                    why.append("QUERY_TIMEOUT")
                else:
                    continue
                while not ended.wait(0.1):
                    self.spark.sparkContext.cancelJobsWithTag(tag)
                return

        if time.monotonic() > until:
            raise EngineError("QUERY_TIMEOUT")
        self.spark.sparkContext.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            out = collect(plan.df, plan.pipeline.output, limits.rows, limits.bytes)
        except Exception as error:
            raise EngineError(why[0]) if why else error from error
        finally:
            ended.set()
            watcher.join()
            self.spark.sparkContext.removeJobTag(tag)
        if plan.snapshot:
            out.segments, out.scanned_bytes = len(plan.snapshot.segments), plan.snapshot.bytes
        return out

    def conversion_failures(self, text: str, start=None, end=None, now=None) -> DataFrame:
        """Historical values of the query's source and range that don't convert."""
        plan = self.plan(text, start, end, now)
        return self.store.conversion_failures(plan.snapshot, plan.pipeline.start, plan.pipeline.end)

    def history(self, newest: int = 50) -> list[dict]:
        return list(self._history)[::-1][:newest]

    # inspection

    def segments(self) -> DataFrame:
        return self._frame("segments", "id string, source string, schema int, day long, rows long, min long, max long, bytes long, estimated long, state string, published_at long, expires_at long, reclaim_after long, run string")

    def dead_letters(self) -> DataFrame:
        return self._frame("dead_letters", "batch string, object string, source string, bytes long, published_at long, expires_at long")

    def dead_letter_entries(self, batch: str | None = None, most: int | None = 100) -> DataFrame:
        """Entries of one batch or all, in the order of position; limited as the reader of an object is, or all of them."""
        schema = "batch_id string, line long, position long, code string, message string, payload_bytes long, payload_digest string, payload struct<content:string,encoding:string,extent:string>"
        found = [e for e in self.store.state()["dead_letters"] if batch in (None, e["batch"])]
        if not found:
            return self.spark.createDataFrame([], schema)
        entries = self.spark.read.schema(schema).json([self.store.files.at(dead_letter_key(e)) for e in found]).orderBy("batch_id", "position")
        return entries if most is None else entries.limit(most)

    def verify(self, source: str) -> DataFrame:
        """Segments of a source whose rows or times contradict the manifest."""
        state = self.store.state()
        definition = self.store.sources(state)[source]
        own = [s for s in state["segments"] if s["source"] == definition.id and s["state"] == "ACTIVE"]
        return self.store.contradictions(own, definition) if own else self.spark.createDataFrame([], "object string, rows long, min long, max long")

    def _frame(self, kind: str, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        rows = [tuple(x.get(n) for n in names) for x in self.store.state()[kind]]
        return self.spark.createDataFrame(rows, schema)

    def status(self) -> dict:
        state = self.store.state()
        waiting = list(state["batches"].values())
        return {"version": state["version"], "sources": len(state["sources"]), "segments": sum(s["state"] == "ACTIVE" for s in state["segments"]), "waiting_batches": len(waiting), "waiting_bytes": sum(b["bytes"] for b in waiting), "oldest_waiting": min((b["time"] for b in waiting), default=None), "at": datetime.now().isoformat()}

    # maintenance

    def maintain(self, targets: maintenance.Targets = maintenance.Targets(), now: int | None = None) -> dict:
        return maintenance.maintain(self.store, targets, now)
