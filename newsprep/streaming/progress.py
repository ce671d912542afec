"""What a stream has done so far, as tables (STM-4)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from newsprep.session import located

from .news import Tap

PROGRESS = "kind string, query string, run_id string, batch_id bigint, at string, rows bigint, duration_ms bigint, counts map<string,bigint>, error string"


def _append(path: str, row: dict) -> None:
    """One small file per event, named by what it reports, so that a replayed batch replaces its own."""
    system, folder = located(path)
    system.create_dir(folder)
    name = f"{row['kind']}-{row['query']}-{row['batch_id']}" if row["kind"] == "counts" else f"{row['kind']}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{folder}/{name}.json") as out:
        out.write(json.dumps(row).encode() + b"\n")


def counts_tap(path: str, query: str) -> Tap:
    """A ``tap`` for ``news_stream`` that appends the counts of every batch."""

    def tap(batch_id: int, counts: dict) -> None:
        _append(path, {"kind": "counts", "query": query, "batch_id": batch_id, "counts": counts})

    return tap


class ProgressLog(StreamingQueryListener):
    """Appends the progress and the end of every stream of a session: ``spark.streams.addListener(ProgressLog(path))``."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        _append(self.path, {"kind": "started", "query": event.name, "run_id": str(event.runId), "batch_id": None, "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        _append(self.path, {
            "kind": "progress", "query": p.name, "run_id": str(p.runId), "batch_id": p.batchId, "at": p.timestamp, "rows": p.numInputRows,
            "duration_ms": p.batchDuration,
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        _append(self.path, {"kind": "ended", "query": None, "run_id": str(event.runId), "batch_id": None, "error": event.exception})


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)
