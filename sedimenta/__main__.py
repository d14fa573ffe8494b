"""Command line: python -m sedimenta ROOT (catalog FILE | submit SOURCE INPUT FILE | process | query TEXT [START [END]] | maintain | status)."""

from __future__ import annotations

import dataclasses
import json
import sys

from .engine import Engine
from .errors import EngineError, QueryError


def run(engine: Engine, command: str, args: list[str]) -> dict:
    if command == "catalog":
        with open(args[0]) as f:
            return {"outcome": engine.apply_catalog(f.read())}
    if command == "submit":
        source, name, path = args
        with open(path, "rb") as f:
            return engine.ingest(source, name, f.read())
    if command == "process":
        return engine.process()
    if command == "query":
        text, start, end = (*args, None, None)[:3]
        return dataclasses.asdict(engine.query(text, start, end))
    if command == "maintain":
        return engine.maintain()
    if command == "status":
        return engine.status()
    raise SystemExit(__doc__)


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        raise SystemExit(__doc__)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(Engine(spark, argv[0]), argv[1], argv[2:]), ensure_ascii=False))
    except QueryError as error:
        text = argv[2]
        print(json.dumps({"code": error.code, "diagnostics": [{**dataclasses.asdict(d), "line": d.place(text)[0], "column": d.place(text)[1]} for d in error.diagnostics]}), file=sys.stderr)
        return 1
    except EngineError as error:
        print(json.dumps({"code": error.code, "message": error.message}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
