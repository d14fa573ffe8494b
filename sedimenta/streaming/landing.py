"""Ingestion from a landing folder as a stream: each new file is a body.

The stream's checkpoint remembers which files were taken; a body's batch is named by its file, so that a batch tried again after a
crash finds its body admitted already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources import ingest


def start(engine: Engine, source: str, input_name: str, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """trigger: arguments of DataStreamWriter.trigger, {"availableNow": True} if None.

    Executors read the bodies; the driver has their paths, lengths and digests only.  Files must be finished when they appear."""
    spark = engine.spark
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 100).load(folder)

    def take(batch: DataFrame, number: int) -> None:
        ingest.admit_files(engine.store, source, input_name, batch)
        engine.process()

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
