"""The engine end to end: catalog, ingestion, schema adaptation, snapshots, limits, failures and maintenance."""

import json
import threading
import uuid

import pytest

from sedimenta.engine import Engine, Limits
from sedimenta.errors import EngineError
from sedimenta.maintenance import Targets, candidates, compact, recover
from sedimenta.sources.blake3 import blake3

V1 = """
format_version: 1
source:
  name: logs
  display_name: Logs
  active_schema_version: 1
  schemas:
    - version: 1
      fields:
        - {name: message, logical_type: utf8, nullability: NON_NULL}
        - {name: attempts, logical_type: int64, nullability: NON_NULL}
  inputs:
    - name: http
      active_ingestion_profile_revision: 1
      ingestion_profile_revisions:
        - revision: 1
          target_schema_version: 1
          maximum_record_bytes: 4000000
          event_time: {json_pointer: /t, format: RFC3339}
          mappings:
            - {target_field: message, json_pointer: /message}
            - {target_field: attempts, json_pointer: /attempts}
"""
V2 = V1.replace("active_schema_version: 1", "active_schema_version: 2").replace(
    "  inputs:",
    """    - version: 2
      fields:
        - {name: message, logical_type: utf8, nullability: NON_NULL}
        - {name: attempts, logical_type: int64, nullability: NON_NULL}
        - {name: region, logical_type: utf8, nullability: NULLABLE, historical_remainder_pointer: /region}
  inputs:""",
).replace("active_ingestion_profile_revision: 1", "active_ingestion_profile_revision: 2") + """        - revision: 2
          target_schema_version: 2
          maximum_record_bytes: 4000000
          event_time: {json_pointer: /t, format: RFC3339}
          mappings:
            - {target_field: message, json_pointer: /message}
            - {target_field: attempts, json_pointer: /attempts}
            - {target_field: region, json_pointer: /region}
"""


def at(clock):
    return f"2026-08-20T{clock}:00Z"


def event(clock, message, attempts, **more):
    return json.dumps({"t": at(clock), "message": message, "attempts": attempts, **more})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert e.apply_catalog(V1) == "CREATED"
    assert e.apply_catalog(V1) == "UNCHANGED"
    old = [event("10:00", "outside-range", 9223372036854775807, region="outside"), event("11:00", "historical", 2, region="eu"), event("11:30", "invalid", 3, region=42)]
    e.ingest("logs", "http", "\n".join(old).encode())
    assert e.process() == {"batches": 1, "accepted": 3, "rejected": 0, "segments": 1}
    assert e.apply_catalog(V2) == "UPDATED"
    e.ingest("logs", "http", (event("11:45", "selected", 4, region="us") + "\n" + event("12:30", "x" * 1_048_576, 4, region="oversized")).encode())
    assert e.process()["accepted"] == 2
    return e


def ask(engine, tail, start="10:30", end="12:00", **more):
    return engine.query("source logs " + tail, at(start), at(end), **more)


def failing(engine, code, tail, *args, **more):
    with pytest.raises(EngineError) as error:
        ask(engine, tail, *args, **more)
    assert error.value.code == code


def test_adaptation(engine):
    out = ask(engine, "| project message, region | sort message")
    assert out.rows == [["historical", "eu"], ["invalid", None], ["selected", "us"]]
    failures = engine.conversion_failures("source logs", at("10:30"), at("12:00")).collect()
    assert [(r["field"], r["failures"]) for r in failures] == [("region", 1)]
    assert out.segments == 2 and out.scanned_bytes > 0


def test_filter_project_sort_take(engine):
    out = ask(engine, "| filter attempts + 1 >= 3 and region != null | project message, adjusted = attempts + 1, region, half = attempts / 2 | sort -adjusted | take 2")
    assert out.rows == [["selected", "5", "us", "2"], ["historical", "3", "eu", "1"]]


def test_summarize(engine):
    out = ask(engine, "| summarize n = count(), known = count(region), total = sum(attempts), mean = avg(attempts), lo = min(message), hi = max(@event_time) by region | sort region")
    assert out.rows == [["eu", "1", "1", "2", 2.0, "historical", "2026-08-20T11:00:00.000Z"], ["us", "1", "1", "4", 4.0, "selected", "2026-08-20T11:45:00.000Z"], [None, "1", "0", "3", 3.0, "invalid", "2026-08-20T11:30:00.000Z"]]


def test_empty_global(engine):
    assert ask(engine, "| summarize n = count(), s = sum(attempts), m = avg(attempts)", "08:00", "09:00").rows == [["0", None, None]]


def test_failures(engine):
    failing(engine, "QUERY_CAST_FAILED", '| project r = cast(rest("region") as utf8)')
    failing(engine, "QUERY_EVALUATION_FAILED", "| project x = attempts + 1", "09:30", "10:30")
    failing(engine, "QUERY_EVALUATION_FAILED", "| summarize s = sum(attempts)", "09:30", "11:15")
    failing(engine, "QUERY_RESOURCE_LIMIT_EXCEEDED", "", limits=Limits(scan_bytes=1))
    failing(engine, "QUERY_RESOURCE_LIMIT_EXCEEDED", "", "12:15", "12:45")
    failing(engine, "QUERY_TIMEOUT", "", limits=Limits(seconds=1e-9))
    gone = threading.Event()
    gone.set()
    failing(engine, "QUERY_CANCELLED", "", cancelled=gone)
    assert engine.history()[0]["code"] == "QUERY_CANCELLED"


def test_truncation(engine):
    out = ask(engine, "| project message", limits=Limits(rows=1))
    assert (out.state, out.reason, len(out.rows)) == ("TRUNCATED", "OUTPUT_ROWS", 1)
    out = ask(engine, "| project message", limits=Limits(bytes=2))
    assert (out.state, out.reason, out.rows) == ("TRUNCATED", "OUTPUT_BYTES", [])


def test_encoding_and_remainder(engine):
    out = ask(engine, '| filter message == "historical" | project @event_time, @event_id, attempts, @rest, has = rest_exists("region"), none = rest_exists("x"), id = cast(@event_id as utf8), j = rest("region")')
    time, eid, attempts, rest, has, none, text, j = out.rows[0]
    assert (time, attempts, rest, has, none, j) == ("2026-08-20T11:00:00.000Z", "2", {"region": "eu"}, True, False, "eu")
    assert eid == text and len(eid) == 32
    assert ask(engine, f'| filter @event_id == eid("{eid}") | project message').rows == [["historical"]]


def test_catalog_conflicts(engine):
    for broken, code in ((V2.replace("logical_type: int64", "logical_type: int32"), "CATALOG_DEFINITION_CONFLICT"), (V1, "CATALOG_DEFINITION_CONFLICT"), (V2.replace("nullability: NULLABLE", "nullability: NON_NULL").replace(", historical_remainder_pointer: /region", ""), "CATALOG_SCHEMA_INCOMPATIBLE"), (V1 + "extra: 1\n", "CATALOG_MANIFEST_INVALID"), (V1.replace("name: logs", "name: logs\n  name: logs"), "CATALOG_MANIFEST_INVALID"), (V1.replace("/message", "message"), "CATALOG_MANIFEST_INVALID"), (V1.replace("            - {target_field: message, json_pointer: /message}\n", ""), "CATALOG_PROFILE_INVALID")):
        with pytest.raises(EngineError) as error:
            engine.apply_catalog(broken)
        assert error.value.code == code


def test_dead_letters(engine):
    bad = b'{"t":"nope","message":"a","attempts":1}\n{"t":"2026-08-21T00:00:00Z","message":"a","attempts":"1"}\n\xff\n[1]\n{"t":"2026-08-21T00:00:00Z","message":"ok","attempts":1}\r\n \n'
    batch = engine.ingest("logs", "http", bad)["batch_id"]
    done = engine.process()
    assert (done["accepted"], done["rejected"]) == (1, 4)
    entries = engine.dead_letter_entries(batch).collect()
    assert [(e["line"], e["code"]) for e in entries] == [(1, "RECORD_EVENT_TIME_INVALID"), (2, "RECORD_CONVERSION_FAILED"), (3, "RECORD_INVALID_UTF8"), (4, "RECORD_PARSE_FAILED")]
    assert entries[2]["payload"]["encoding"] == "BASE64" and entries[2]["payload_digest"] == blake3(b"\xff").hex()
    assert engine.process()["batches"] == 0


def test_missing_and_corrupt_objects(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    e.ingest("logs", "http", event("11:00", "a", 1).encode())
    e.process()
    (path,) = list(tmp_path.glob("segments/*/*.parquet"))
    data = path.read_bytes()
    assert e.verify("logs").count() == 0
    path.write_bytes(data + b"x")
    failing(e, "PUBLISHED_OBJECT_CORRUPT", "")
    path.write_bytes(data[:-40] + b"y" * 40)
    failing(e, "PUBLISHED_OBJECT_CORRUPT", "")
    path.write_bytes(data)
    e.store.change(lambda state: state["segments"][0].__setitem__("rows", 7))
    assert e.verify("logs").count() == 1
    path.unlink()
    failing(e, "PUBLISHED_OBJECT_MISSING", "")


def test_compaction_retention_and_reclamation(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    for batch in range(3):
        e.ingest("logs", "http", "\n".join(event(f"11:{10 + 3 * i + batch}", f"event-{3 * i + batch}", i) for i in range(3)).encode())
        e.process(data_ttl=10 * 86_400_000)
    before = ask(e, "| project @event_id, message, attempts | sort message").rows
    snapshot = e.plan("source logs | summarize n = count()", at("10:00"), at("13:00"))
    targets = Targets(rows=5, grace=1000, margin=0)
    assert candidates(e.store.state()["segments"], Targets(rows=3), 0) is None
    done = compact(e.store, targets)
    assert (done["inputs"], done["outputs"], done["rows"]) == (3, 2, 9)
    assert compact(e.store, targets) is None
    assert ask(e, "| project @event_id, message, attempts | sort message").rows == before
    assert ask(e, "| summarize n = count()").segments == 2
    states = {r["state"]: r["count"] for r in e.segments().groupBy("state").count().collect()}
    assert states == {"ACTIVE": 2, "SUPERSEDED": 3}
    assert snapshot.df.collect()[0][0] == 9  # the retired segments are still there
    later = e.store.state()["segments"][-1]["published_at"] + 5000
    assert e.maintain(targets, now=later)["reclaimed_segments"] == 3
    assert len(list(tmp_path.glob("segments/*/*.parquet"))) == 2
    e.maintain(targets, now=later + 20 * 86_400_000)
    assert ask(e, "| summarize n = count()").rows == [["0"]]
    e.maintain(targets, now=later + 21 * 86_400_000)
    assert not list(tmp_path.glob("segments/*/*.parquet"))


def test_failed_run_frees_its_claims(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    for i in range(2):
        e.ingest("logs", "http", event("11:00", f"m{i}", i).encode())
        e.process()
    for p in tmp_path.glob("segments/*/*.parquet"):
        p.write_bytes(b"broken")
    with pytest.raises(EngineError):
        compact(e.store, Targets(margin=0))
    state = e.store.state()
    assert state["runs"][-1]["state"] == "FAILED" and not any(s.get("run") for s in state["segments"])

    def stuck(s):
        s["runs"].append({"id": "r", "inputs": [], "state": "RUNNING", "started_at": 1})

    e.store.change(stuck)
    assert recover(e.store, 2) == 1


def test_two_writers(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    a.apply_catalog(V1)
    tries = []

    def step(state):
        if not tries:
            b.ingest("logs", "http", b"{}")
        tries.append(state["version"])
        state["runs"].append({"id": str(uuid.uuid4()), "state": "FAILED", "inputs": [], "started_at": 0})

    a.store.change(step)
    assert len(tries) == 2 and len(a.store.state()["batches"]) == 1


def test_landing_stream(spark, tmp_path):
    from sedimenta.streaming.landing import start

    e = Engine(spark, str(tmp_path / "store"))
    e.apply_catalog(V1)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.ndjson").write_text(event("11:00", f"m{i}", i))
        start(e, "logs", "http", str(folder), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert ask(e, "| summarize n = count(), s = sum(attempts)").rows == [["3", "3"]]


def test_a_landed_file_must_not_change(spark, tmp_path):
    from sedimenta.sources.ingest import admit_files

    e = Engine(spark, str(tmp_path / "store"))
    e.apply_catalog(V1)
    folder = tmp_path / "in [1]{a}"
    folder.mkdir()
    (folder / "a*b.ndjson").write_text(event("11:00", "m", 1))
    (folder / "axb.ndjson").write_text(event("11:00", "n", 2))
    files = spark.read.format("binaryFile").load(str(tmp_path / "in ?1??a?"))
    assert admit_files(e.store, "logs", "http", files) == 2 and admit_files(e.store, "logs", "http", files) == 0
    (folder / "axb.ndjson").write_text(event("11:00", "n", 3))
    with pytest.raises(EngineError) as error:
        e.process()
    assert error.value.code == "PUBLISHED_OBJECT_CORRUPT" and ask(e, "| summarize n = count()").rows == [["0"]]
    (folder / "axb.ndjson").write_text(event("11:00", "n", 2))
    assert e.process()["accepted"] == 2 and len(list(folder.iterdir())) == 2
    assert ask(e, "| summarize n = count(), s = sum(attempts)").rows == [["2", "3"]]


def test_a_spooled_body_is_held_against_its_digest(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    e.ingest("logs", "http", event("11:00", "m", 1).encode())
    (path,) = list(tmp_path.glob("spool/*.ndjson"))
    data = path.read_bytes()
    path.write_bytes(data[:-3])
    (tmp_path / "spool" / f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.raises(EngineError) as error:
        e.process()
    assert error.value.code == "PUBLISHED_OBJECT_CORRUPT"
    path.write_bytes(data)
    assert e.process()["accepted"] == 1


def test_segments_have_small_row_groups_and_are_told_by_their_footer(spark, tmp_path):
    import pyarrow.parquet as pq

    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    e.ingest("logs", "http", "\n".join(event("11:00", f"m{i}", i) for i in range(20_000)).encode())
    e.process()
    (path,) = list(tmp_path.glob("segments/*/*.parquet"))
    meta = pq.read_metadata(path)
    assert meta.num_rows == 20_000 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 8192
    data = bytearray(path.read_bytes())
    at = data.rindex(b"PAR1") - 4 - int.from_bytes(data[-8:-4], "little")
    place = data.index(b"parquet-mr", at)  # a swapped file of the same length
    data[place : place + 7] = b"another"
    path.write_bytes(data)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    failing(e, "PUBLISHED_OBJECT_CORRUPT", "")


def test_command_line(spark, tmp_path, capsys):
    from sedimenta.__main__ import main

    root = str(tmp_path / "store")
    (tmp_path / "c.yaml").write_text(V1)
    (tmp_path / "e.ndjson").write_text(event("11:00", "m", 1))
    assert main([root, "catalog", str(tmp_path / "c.yaml")]) == 0
    assert main([root, "submit", "logs", "http", str(tmp_path / "e.ndjson")]) == 0 and main([root, "process"]) == 0
    assert main([root, "query", "source logs | summarize n = count()", at("10:00"), at("12:00")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"] == [["1"]]
    assert main([root, "query", "source logs | take -1", at("10:00"), at("12:00")]) == 1
    assert json.loads(capsys.readouterr().err.splitlines()[-1])["diagnostics"][0]["column"] == 20
    assert main([root, "maintain"]) == 0 and main([root, "status"]) == 0


@pytest.mark.parametrize("text", ["a: &x 1\nb: *x\n", "!!str a", "%YAML 1.1\n---\na: 1\n", "a: 1\n---\nb: 1\n", "format_version: 2\nsource: {}\n", "- 1\n", "a: [\n"])
def test_yaml_is_read_strictly(text):
    from sedimenta.sources.catalog import read_manifest

    with pytest.raises(EngineError) as error:
        read_manifest(text)
    assert error.value.code == "CATALOG_MANIFEST_INVALID"


def test_a_file_is_named_once(spark, tmp_path):
    """Also for a writer that saw no file before it wrote its own."""
    from sedimenta.sources.files import Files

    files = Files(spark, str(tmp_path / "root"))
    assert files.write_new("a/one", b"first") and not files.write_new("a/one", b"second")
    late = files._path(f"{files.at('a')}/.late")
    out = files._fs.create(late, False)
    out.write(b"late")
    out.close()
    assert not files._named(late, files.path("a/one")) and files.read("a/one") == b"first"
    assert files.names("a") == ["one"]


def test_compactions_of_several_days_run_at_a_time(spark, tmp_path, monkeypatch):
    import threading

    from sedimenta import maintenance

    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    for i in range(2):
        e.ingest("logs", "http", "\n".join(event("11:00", f"m{i}{day}", i).replace("2026-08-20", f"2026-08-{day}") for day in (20, 21, 22)).encode())
        e.process()
    together, kind = threading.Barrier(3, timeout=60), "spark.sql.parquet.outputTimestampType"
    write, before = e.store.write_segments, spark.conf.get(kind)
    monkeypatch.setattr(e.store, "write_segments", lambda *a: (together.wait(), write(*a))[1])
    assert maintenance.compact_all(e.store, Targets(margin=0)) == 3 and spark.conf.get(kind) == before
    active = [s for s in e.store.state()["segments"] if s["state"] == "ACTIVE"]
    assert sorted(s["rows"] for s in active) == [2, 2, 2] and len({s["day"] for s in active}) == 3
    assert maintenance.compact_all(e.store, Targets(margin=0)) == 0


def test_all_dead_letters_are_not_brought_to_one_task(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.apply_catalog(V1)
    e.ingest("logs", "http", b"x\n[]\n" * 3)
    e.process()
    entries = e.dead_letter_entries(most=None)
    assert "Limit" not in entries.groupBy("code").count()._jdf.queryExecution().optimizedPlan().toString()
    assert entries.count() == 6 and e.dead_letter_entries(most=2).count() == 2
