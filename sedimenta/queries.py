"""The engine's queries over the test tables, as pipe text, with equivalent DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .lang.analysis import TimeContext, analyze
from .lang.times import parse_instant
from .maintenance import Targets, compact, compact_all, expire, reclaim, recover
from .plans.lower import check_session, lower
from .sources.bindings import BoundSource, bind
from .sources.ingest import admit_files
from .sources.store import now_ms

NOW = parse_instant("2024-01-10T12:34:56.789Z")
FIRST, LAST = parse_instant("1990-01-01T00:00:00Z"), parse_instant("2030-01-01T00:00:00Z")


def sources(spark: SparkSession, sf_dir: str, name: str) -> BoundSource:
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "events":
        return bind("events", read("events"), "ts", rest="props", numbered_by="event_id")
    if name == "orders":
        return bind("orders", read("orders"), "o_orderdate", numbered_by="o_orderkey")
    return bind("lineitem", read("lineitem"), "l_shipdate")


def pipe(spark: SparkSession, source: BoundSource, text: str, now: int = NOW, start: int | None = FIRST, end: int | None = LAST) -> DataFrame:
    """The result of a query over one bound source."""
    check_session(spark)
    pipeline = analyze(text, {source.name: source.fields}, TimeContext(now, start, end))
    return lower(pipeline, source.relation(pipeline.start, pipeline.end))


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as DuckDB has them."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`") for f in df.schema.fields])


@dataclass(frozen=True)
class PipeQuery:
    source: str
    text: str
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        source = sources(spark, sf_dir, self.source)
        return plain(pipe(spark, source, f"source {self.source} {self.text}"))


EV = "events"
QUERIES: dict[str, PipeQuery] = {
    "flagship": PipeQuery(EV, "| filter value > 10.0 | summarize n = count(), total = sum(value), hi = max(value) by event_type | sort -n | take 5",
        "SELECT event_type, count(*) AS n, sum(value) AS total, max(value) AS hi FROM events WHERE value > 10.0 GROUP BY event_type ORDER BY n DESC NULLS LAST LIMIT 5"),
    "scan_range": PipeQuery(EV, 'start_inclusive=datetime("2024-01-05T00:00:00Z") end_exclusive=datetime("2024-01-06T00:00:00Z") | project event_id, value',
        "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'"),
    "scan_relative": PipeQuery(EV, "start_inclusive=-1d@h end_exclusive=@h | project event_id, at = @event_time",
        "SELECT event_id, date_trunc('millisecond', ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-09 12:00:00' AND ts < TIMESTAMP '2024-01-10 12:00:00'"),
    "scan_shifts": PipeQuery(EV, "start_inclusive=@d-2d+90m@h end_exclusive=now | project event_id",
        "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08 01:00:00' AND ts < TIMESTAMP '2024-01-10 12:34:56.789'"),
    "filter_cmp": PipeQuery(EV, '| filter value >= 10.0 and event_type != "view" | project event_id, user_id, event_type, value',
        "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 10.0 AND event_type <> 'view'"),
    "filter_not_or": PipeQuery(EV, '| filter not (event_type == "click") or value < 1.0 | project event_id, event_type',
        "SELECT event_id, event_type FROM events WHERE NOT (event_type = 'click') OR value < 1.0"),
    "filter_null": PipeQuery(EV, '| filter rest("k") != null and rest("absent") == null | project event_id',
        "SELECT event_id FROM events WHERE (props->'$.k') IS NOT NULL AND (props->'$.absent') IS NULL"),
    "filter_text_order": PipeQuery(EV, '| filter event_type >= "l" and event_type < "s" | project event_id, event_type',
        "SELECT event_id, event_type FROM events WHERE event_type >= 'l' AND event_type < 's'"),
    "filter_eid": PipeQuery(EV, '| filter @event_id < eid("00000000000000000000000000000100") | project event_id, id = cast(@event_id as utf8)',
        "SELECT event_id, lower(lpad(format('{:x}', event_id), 32, '0')) AS id FROM events WHERE event_id < 256"),
    "filter_datetime": PipeQuery(EV, '| filter @event_time >= datetime("2024-01-20T00:00:00+02:00") | project event_id',
        "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-19 22:00:00'"),
    "project_arith": PipeQuery("orders", "| project o_orderkey, x = o_totalprice * 2.0 - 1.0, y = o_totalprice / 4.0, z = -o_totalprice + 1.0",
        "SELECT o_orderkey, o_totalprice * 2.0 - 1.0 AS x, o_totalprice / 4.0 AS y, -o_totalprice + 1.0 AS z FROM orders"),
    "project_intdiv": PipeQuery(EV, "| project event_id, q = (event_id - 5000) / 7, n = -user_id, p = user_id * 3 + 1",
        "SELECT event_id, (CASE WHEN event_id >= 5000 THEN (event_id - 5000) // 7 ELSE -((5000 - event_id) // 7) END)::BIGINT AS q, -user_id AS n, user_id * 3 + 1 AS p FROM events"),
    "project_literals_all": PipeQuery(EV, '| project event_id, a = 12, b = int32(-7), c = 1 + 2 * 3, d = 0.5, e = "té", f = true and null, g = float32(1.5), h = uint32(7) | summarize n = count(), a = max(a), b = min(b), c = max(c), d = max(d), e = min(e), f = count(f), g = max(g), h = max(h)',
        "SELECT count(*) AS n, max(12)::BIGINT AS a, min(-7)::INTEGER AS b, max(7)::BIGINT AS c, max(0.5::DOUBLE) AS d, min('té') AS e, 0::BIGINT AS f, max(1.5::FLOAT) AS g, max(7)::BIGINT AS h FROM events"),
    "project_widen": PipeQuery("lineitem", "| project l_orderkey, a = l_linenumber + 1, b = l_linenumber * l_orderkey, c = l_linenumber * l_quantity",
        "SELECT l_orderkey, l_linenumber + 1 AS a, l_linenumber::BIGINT * l_orderkey AS b, l_linenumber::DOUBLE * l_quantity AS c FROM lineitem"),
    "project_bool": PipeQuery(EV, '| project event_id, a = value > 50.0, b = event_type == "click" or value > 50.0, c = not (value > 50.0)',
        "SELECT event_id, value > 50.0 AS a, event_type = 'click' OR value > 50.0 AS b, NOT (value > 50.0) AS c FROM events"),
    "cast_to_text": PipeQuery(EV, "| project event_id, a = cast(user_id as utf8), b = cast(@event_time as utf8), c = cast(value > 1.0 as utf8)",
        "SELECT event_id, user_id::VARCHAR AS a, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS b, (value > 1.0)::VARCHAR AS c FROM events"),
    "cast_try_text_int": PipeQuery(EV, '| project event_id, a = try_cast(event_type as int64), b = try_cast("0042" as int32), c = try_cast(" 1" as int64), d = try_cast("-5" as uint32)',
        "SELECT event_id, NULL::BIGINT AS a, 42::INTEGER AS b, NULL::BIGINT AS c, NULL::BIGINT AS d FROM events"),
    "cast_float_to_int": PipeQuery(EV, "| project event_id, a = try_cast(value as int64), b = try_cast(value * 100.0 as int32)",
        "SELECT event_id, CASE WHEN floor(value) = value THEN value::BIGINT END AS a, CASE WHEN floor(value * 100.0) = value * 100.0 THEN (value * 100.0)::INTEGER END AS b FROM events"),
    "cast_int_to_float_all": PipeQuery(EV, "| project event_id, a = cast(user_id as float64), b = try_cast(9007199254740993 + event_id as float64)",
        "SELECT event_id, user_id::DOUBLE AS a, CASE WHEN (9007199254740993 + event_id)::DOUBLE::HUGEINT = 9007199254740993 + event_id THEN (9007199254740993 + event_id)::DOUBLE END AS b FROM events"),
    "cast_text_to_float": PipeQuery(EV, "| project event_id, a = cast(cast(value as utf8) as float64), b = cast(cast(user_id as utf8) as float64), c = try_cast(event_type as float64)",
        "SELECT event_id, value AS a, user_id::DOUBLE AS b, TRY_CAST(event_type AS DOUBLE) AS c FROM events"),
    "cast_text_to_int": PipeQuery(EV, "| project event_id, a = cast(cast(user_id as utf8) as int32), b = cast(cast(user_id as utf8) as uint32), c = try_cast(cast(event_id - 5000 as utf8) as uint64), d = cast(cast(event_id - 5000 as utf8) as int64)",
        "SELECT event_id, user_id::INTEGER AS a, user_id AS b, CASE WHEN event_id >= 5000 THEN (event_id - 5000)::DECIMAL(20,0) END AS c, event_id - 5000 AS d FROM events"),
    "cast_text_to_datetime": PipeQuery(EV, "| project event_id, a = cast(cast(@event_time as utf8) as datetime), b = try_cast(event_type as datetime)",
        "SELECT event_id, date_trunc('millisecond', ts) AS a, TRY_CAST(event_type AS TIMESTAMP) AS b FROM events"),
    "cast_text_to_eid": PipeQuery(EV, "| project event_id, a = cast(cast(cast(@event_id as utf8) as eid) as utf8), b = cast(@event_id as utf8) == event_type",
        "SELECT event_id, lower(lpad(format('{:x}', event_id), 32, '0')) AS a, lower(lpad(format('{:x}', event_id), 32, '0')) = event_type AS b FROM events"),
    "cast_text_to_bool": PipeQuery(EV, "| project event_id, a = cast(cast(value > 50.0 as utf8) as bool), b = try_cast(event_type as bool)",
        "SELECT event_id, value > 50.0 AS a, CASE event_type WHEN 'true' THEN true WHEN 'false' THEN false END AS b FROM events"),
    "cast_float_to_text": PipeQuery("lineitem", "| project l_orderkey, l_linenumber, a = cast(l_extendedprice as utf8), b = cast(l_discount as utf8), c = cast(-l_quantity as utf8)",
        "SELECT l_orderkey, l_linenumber, l_extendedprice::VARCHAR AS a, l_discount::VARCHAR AS b, (-l_quantity)::VARCHAR AS c FROM lineitem"),
    "cast_to_json": PipeQuery(EV, "| project event_id, a = cast(event_type as json), b = cast(user_id as json), c = cast(value > 50.0 as json), d = cast(@event_time as json)",
        "SELECT event_id, to_json(event_type)::VARCHAR AS a, user_id::VARCHAR AS b, (value > 50.0)::VARCHAR AS c, '\"' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') || '\"' AS d FROM events"),
    "cast_json_to": PipeQuery(EV, '| project event_id, a = cast(rest("k") as float64), b = cast(rest("k") as uint32), c = cast(rest("k") as uint64), d = cast(rest("k") as int32), e = cast(rest("k") as float32), f = cast(cast(event_type as json) as utf8), g = cast(cast(value > 50.0 as json) as bool), h = try_cast(rest("k") as bool)',
        "SELECT event_id, k::DOUBLE AS a, k AS b, k::DECIMAL(20,0) AS c, k::INTEGER AS d, k::FLOAT AS e, event_type AS f, value > 50.0 AS g, NULL::BOOLEAN AS h FROM (SELECT *, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events)"),
    "float32_arith": PipeQuery(EV, "| project event_id, f = cast(user_id as float32) | project event_id, a = f * float32(0.5), b = f + float32(1.5), c = f / float32(4.0), d = -f, e = cast(f as float64), g = f >= float32(100.0)",
        "SELECT event_id, f * 0.5::FLOAT AS a, f + 1.5::FLOAT AS b, (f / 4.0::FLOAT)::FLOAT AS c, -f AS d, f::DOUBLE AS e, f >= 100 AS g FROM (SELECT event_id, user_id::FLOAT AS f FROM events)"),
    "uint_arith": PipeQuery(EV, "| project event_id, u = cast(user_id as uint32), w = cast(event_id as uint64) | project event_id, a = u + uint32(1), b = u * uint32(3), c = u / uint32(7), d = w + uint64(18446744073700000000), e = w * uint64(3), f = w / uint64(7), g = u + w, h = w >= uint64(5000)",
        "SELECT event_id, user_id + 1 AS a, user_id * 3 AS b, user_id // 7 AS c, (event_id + 18446744073700000000::HUGEINT)::DECIMAL(20,0) AS d, (event_id * 3)::DECIMAL(20,0) AS e, (event_id // 7)::DECIMAL(20,0) AS f, (user_id + event_id)::DECIMAL(20,0) AS g, event_id >= 5000 AS h FROM events"),
    "agg_float32": PipeQuery(EV, "| project event_type, f = cast(user_id as float32) | summarize n = count(f), lo = min(f), hi = max(f), mean = avg(f) by event_type",
        "SELECT event_type, count(f) AS n, min(f) AS lo, max(f) AS hi, avg(f) AS mean FROM (SELECT event_type, user_id::FLOAT AS f FROM events) GROUP BY event_type"),
    "rest_value": PipeQuery(EV, '| project event_id, k = try_cast(rest("k") as int64)',
        "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "rest_exists": PipeQuery(EV, '| project event_id, has = rest_exists("k"), hasnt = rest_exists("absent")',
        "SELECT event_id, list_contains(json_keys(props), 'k') AS has, list_contains(json_keys(props), 'absent') AS hasnt FROM events"),
    "sort_multi_all": PipeQuery(EV, "| sort by event_type, -value, event_id | project event_id, event_type, value",
        "SELECT event_id, event_type, value FROM events ORDER BY event_type NULLS LAST, value DESC NULLS LAST, event_id NULLS LAST"),
    "sort_nulls_all": PipeQuery(EV, "| project event_id, v = try_cast(value * 10.0 as int64) | sort -v, event_id",
        "SELECT event_id, CASE WHEN floor(value * 10.0) = value * 10.0 THEN (value * 10.0)::BIGINT END AS v FROM events ORDER BY v DESC NULLS LAST, event_id"),
    "take_zero": PipeQuery(EV, "| project event_id, value | take 0", "SELECT event_id, value FROM events LIMIT 0"),
    "topk": PipeQuery("orders", "| sort -o_totalprice, o_orderkey | take 10 | project o_orderkey, o_totalprice",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10"),
    "agg_global": PipeQuery(EV, "| summarize n = count(), users = count(user_id), total = sum(user_id), mean = avg(user_id), lo = min(value), hi = max(value)",
        "SELECT count(*) AS n, count(user_id) AS users, sum(user_id)::BIGINT AS total, avg(user_id) AS mean, min(value) AS lo, max(value) AS hi FROM events"),
    "agg_global_empty": PipeQuery(EV, "start_inclusive=datetime(\"1999-01-01T00:00:00Z\") end_exclusive=datetime(\"1999-01-02T00:00:00Z\") | summarize n = count(), total = sum(user_id), mean = avg(value), lo = min(event_type)",
        "SELECT 0::BIGINT AS n, NULL::BIGINT AS total, NULL::DOUBLE AS mean, NULL::VARCHAR AS lo"),
    "agg_group_one": PipeQuery(EV, "| summarize n = count(), total = sum(user_id), hi = max(value) by event_type",
        "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS total, max(value) AS hi FROM events GROUP BY event_type"),
    "agg_group_multi": PipeQuery("lineitem", "| summarize n = count(), lines = sum(l_linenumber), most = max(l_quantity), least = min(l_extendedprice) by l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, max(l_quantity) AS most, min(l_extendedprice) AS least FROM lineitem GROUP BY ALL"),
    "agg_group_empty": PipeQuery(EV, "| filter value < -1.0e9 | summarize n = count(), hi = max(value) by event_type",
        "SELECT event_type, count(*) AS n, max(value) AS hi FROM events WHERE value < -1.0e9 GROUP BY event_type"),
    "agg_null_key": PipeQuery(EV, "| project event_id, k = try_cast(value as int64) | summarize n = count(), present = count(k), last = max(event_id) by k",
        "SELECT k, count(*) AS n, count(k) AS present, max(event_id) AS last FROM (SELECT event_id, CASE WHEN floor(value) = value THEN value::BIGINT END AS k FROM events) GROUP BY k"),
    "agg_minmax_types": PipeQuery(EV, "| summarize a = min(event_type), b = max(event_type), c = min(@event_time), d = max(@event_time) by user_id",
        "SELECT user_id, min(event_type) AS a, max(event_type) AS b, min(date_trunc('millisecond', ts)) AS c, max(date_trunc('millisecond', ts)) AS d FROM events GROUP BY user_id"),
    "agg_unsigned": PipeQuery(EV, "| project user_id, u = cast(user_id as uint32), w = cast(event_id as uint64) | summarize su = sum(u), sw = sum(w), mu = max(u), aw = avg(w) by user_id",
        "SELECT user_id, sum(user_id)::DECIMAL(20,0) AS su, sum(event_id)::DECIMAL(20,0) AS sw, max(user_id) AS mu, avg(event_id) AS aw FROM events GROUP BY user_id"),
    "agg_after_project": PipeQuery("lineitem", 'start_inclusive=datetime("1996-01-01T00:00:00Z") end_exclusive=datetime("1997-01-01T00:00:00Z") | filter l_discount >= 0.05 and l_discount <= 0.07 and l_quantity < 24.0 | project r = l_extendedprice * l_discount, l_returnflag | summarize n = count(), revenue = max(r) by l_returnflag',
        "SELECT l_returnflag, count(*) AS n, max(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24.0 GROUP BY l_returnflag"),
    "agg_float_sum": PipeQuery("lineitem", "| summarize n = count(), qty = sum(l_quantity), mean = avg(l_quantity) by l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL"),
}


# Queries over stored events: the events table goes through ingestion first.

EVENTS_CATALOG = """
format_version: 1
source:
  name: events
  active_schema_version: 2
  schemas:
    - version: 1
      fields:
        - {name: event_id, logical_type: int64, nullability: NON_NULL}
        - {name: user_id, logical_type: int64, nullability: NULLABLE}
        - {name: event_type, logical_type: utf8, nullability: NULLABLE}
        - {name: value, logical_type: float64, nullability: NULLABLE}
    - version: 2
      fields:
        - {name: event_id, logical_type: int64, nullability: NON_NULL}
        - {name: user_id, logical_type: int64, nullability: NULLABLE}
        - {name: event_type, logical_type: utf8, nullability: NULLABLE}
        - {name: value, logical_type: float64, nullability: NULLABLE}
        - {name: k, logical_type: int64, nullability: NULLABLE, historical_remainder_pointer: /props/k}
  inputs:
    - name: old
      active_ingestion_profile_revision: 1
      ingestion_profile_revisions:
        - revision: 1
          target_schema_version: 1
          maximum_record_bytes: 1048576
          event_time: {json_pointer: /ts, format: UNIX_MILLISECONDS}
          mappings:
            - {target_field: event_id, json_pointer: /event_id}
            - {target_field: user_id, json_pointer: /user_id}
            - {target_field: event_type, json_pointer: /event_type}
            - {target_field: value, json_pointer: /value}
    - name: new
      active_ingestion_profile_revision: 1
      ingestion_profile_revisions:
        - revision: 1
          target_schema_version: 2
          maximum_record_bytes: 1048576
          event_time: {json_pointer: /ts, format: UNIX_MILLISECONDS}
          mappings:
            - {target_field: event_id, json_pointer: /event_id}
            - {target_field: user_id, json_pointer: /user_id}
            - {target_field: event_type, json_pointer: /event_type}
            - {target_field: value, json_pointer: /value}
            - {target_field: k, json_pointer: /props/k}
"""
#: Records of a body.
BODY = 20_000
#: Damaged records in place of those of ids with these remainders by 16, and why they are rejected.
DAMAGED = {
    1: ('{"ts":"x","event_id":', "}", "RECORD_EVENT_TIME_INVALID"),
    2: ('{"ts":1,"event_id":"', '"}', "RECORD_CONVERSION_FAILED"),
    3: ('{"ts":1,"user_id":', "}", "RECORD_FIELD_MISSING"),
    4: ('{"ts":1,"event_id":null,"user_id":', "}", "RECORD_FIELD_NULL"),
    5: ('{"ts":1,"ts":', "}", "RECORD_PARSE_FAILED"),
    6: ("[", "]", "RECORD_PARSE_FAILED"),
    7: ('{"ts":1.5,"event_id":', "}", "RECORD_EVENT_TIME_INVALID"),
}


def stored_events(spark: SparkSession, sf_dir: str, damaged: bool = False, old_ttl: int | None = None, times: int = 1) -> Engine:
    """A new store that holds the events table: those of odd ids came under the old schema, those of even ids under the new one.

    Executors write the bodies and read them again.  old_ttl: milliseconds after which those of odd ids expire.  times: how often each
    file is offered."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = scratch(spark)
    engine = Engine(spark, root)
    engine.apply_catalog(EVENTS_CATALOG)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    record = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")))
    if damaged:
        case = F.when(F.lit(False), F.lit(""))
        for rest, (before, after, _) in DAMAGED.items():
            case = case.when(F.col("event_id") % 16 == rest, F.concat(F.lit(before), F.col("event_id").cast("string"), F.lit(after)))
        record = case.otherwise(record)
    for name, odd, ttl in (("old", 1, old_ttl), ("new", 0, None)):
        folder = f"{root}-landing/{name}"
        rows.filter(F.col("event_id") % 2 == odd).select(record.alias("value")).write.option("maxRecordsPerFile", BODY).text(folder)
        files = spark.read.format("binaryFile").load(folder)
        for _ in range(times):
            admit_files(engine.store, "events", name, files)
            engine.process(ttl)
    return engine


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/sedimenta-stores"
    return f"{base.rstrip('/')}/store-{uuid.uuid4()}"


def stored_query(text: str, compacted: bool = False, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = stored_events(spark, sf_dir, **more)
        if compacted:
            compact_all(engine.store, Targets(margin=0))
        return plain(engine.plan(f"source events {text}", FIRST, LAST).df)

    return run


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = stored_events(spark, sf_dir, damaged=True)
    return engine.dead_letter_entries(most=None).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"))


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the events of odd ids have expired and their objects are gone."""
    engine = stored_events(spark, sf_dir, old_ttl=1000)
    later = now_ms() + 10_000_000
    expire(engine.store, 0, later)
    reclaim(engine.store, later)
    return plain(engine.plan("source events | summarize n = count(), last = max(event_id), hi = max(value) by event_type", FIRST, LAST).df)


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a compaction that claimed all segments and then died, and one that came after the recovery."""
    engine = stored_events(spark, sf_dir)
    run = str(uuid.uuid4())

    def claim(state: dict) -> None:
        for s in state["segments"]:
            s["run"] = run
        state["runs"].append({"id": run, "inputs": [s["id"] for s in state["segments"]], "state": "RUNNING", "started_at": 0})

    engine.store.change(claim)
    assert compact(engine.store, Targets(margin=0)) is None and recover(engine.store, 1) == 1
    compact_all(engine.store, Targets(margin=0))
    reclaim(engine.store, now_ms() + 10_000_000)
    return plain(engine.plan("source events | project event_id, user_id, value, at = @event_time", FIRST, LAST).df)


def dead_letter_sql() -> str:
    parts = [f"SELECT '{code}' AS code, octet_length(encode('{before}' || event_id || '{after}')) AS b FROM events WHERE event_id % 16 = {rest}" for rest, (before, after, code) in DAMAGED.items()]
    return f"SELECT code, count(*) AS n, sum(b)::BIGINT AS bytes FROM ({' UNION ALL '.join(parts)}) GROUP BY code"


STORED = {
    "ingest_roundtrip": (stored_query("| project event_id, user_id, event_type, value, k, at = @event_time"),
        "SELECT event_id, user_id, event_type, value, TRY_CAST(props->>'$.k' AS BIGINT) AS k, date_trunc('millisecond', ts) AS at FROM events"),
    "ingest_damaged": (stored_query("| project event_id, value", damaged=True),
        "SELECT event_id, value FROM events WHERE event_id % 16 NOT BETWEEN 1 AND 7"),
    "ingest_replay": (stored_query("| summarize n = count(), last = max(event_id), total = sum(event_id) by event_type", times=2),
        "SELECT event_type, count(*) AS n, max(event_id) AS last, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type"),
    "schema_adapt": (stored_query("| filter k != null | summarize n = count(), most = max(k), total = sum(k) by event_type"),
        "SELECT event_type, count(*) AS n, max(k) AS most, sum(k)::BIGINT AS total FROM (SELECT event_type, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events) WHERE k IS NOT NULL GROUP BY event_type"),
    "compaction_equiv": (stored_query("| summarize n = count(), hi = max(value), last = max(@event_time) by event_type", compacted=True),
        "SELECT event_type, count(*) AS n, max(value) AS hi, max(date_trunc('millisecond', ts)) AS last FROM events GROUP BY event_type"),
    "compaction_recovery": (recovered,
        "SELECT event_id, user_id, value, date_trunc('millisecond', ts) AS at FROM events"),
    "retention": (retained,
        "SELECT event_type, count(*) AS n, max(event_id) AS last, max(value) AS hi FROM events WHERE event_id % 2 = 0 GROUP BY event_type"),
    "dead_letters": (dead_letters, dead_letter_sql()),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **{k: q for k, (q, _) in STORED.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: q.sql for k, q in QUERIES.items() if q.sql}, **{k: sql for k, (_, sql) in STORED.items() if sql}}
