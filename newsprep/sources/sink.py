"""The transactional writer of the collection, as a Python data source (SNK-3, STM-3).

Tasks write Parquet files below a folder of their attempt; the driver then adds one entry to the
manifest. Only what the manifest names exists for readers, so a failed or half-written batch shows
nothing, and a second attempt of a batch takes the place of the first at one moment.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from newsprep.session import located

#: Bytes of rows that a task holds before it writes them as one row group, and rows of a batch that it copies at once.
GROUP, PIECE = 8 << 20, 1 << 10
#: Of zstd; a tenth smaller than level 1 for a little more time.
LEVEL = 6
STATES = ("ok", "reject")


def attempt_folder(run_id: str, batch_id: int, attempt: str) -> str:
    """Below the collection; the names read back as partition columns."""
    return f"log/run_id={quote(run_id, safe='')}/batch_id={batch_id}/attempt={attempt}"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Views of at most ``PIECE`` rows."""
    for x in batches:
        for at in range(0, len(x), PIECE):
            yield x.slice(at, PIECE)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: rows by state and the buckets of the accepted ones."""

    rows: dict[str, int] = field(default_factory=dict)
    buckets: list[int] = field(default_factory=list)


class CollectionSink(DataSource):
    """Options: ``path`` of the collection, ``run_id``, ``batch_id``, ``attempt``.

    Rows carry ``state``, ``ok`` or ``reject``, and their ``bucket``; both are left out of the files.
    """

    @classmethod
    def name(cls) -> str:
        return "newsprep_collection"

    def writer(self, schema, overwrite: bool) -> "CollectionWriter":
        return CollectionWriter(dict(self.options))


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.run_id, self.batch_id, self.attempt = options["run_id"], int(options["batch_id"]), options["attempt"]
        self.folder = attempt_folder(self.run_id, self.batch_id, self.attempt)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        root = f"{root}/{self.folder}"  # appended as it stands, not read as part of a URI
        context = TaskContext.get()
        # Retried and speculative tasks have names of their own; the files of those that lose are in no manifest.
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        done, buckets = Written({s: 0 for s in STATES}), set()
        held: dict[str, list[pa.RecordBatch]] = {s: [] for s in STATES}
        writers: dict[str, pq.ParquetWriter] = {}

        def flush(state: str) -> None:
            if held[state]:
                table = pa.Table.from_batches(held[state])
                if state not in writers:
                    system.create_dir(f"{root}/state={state}")
                    writers[state] = pq.ParquetWriter(
                        f"{root}/state={state}/{name}", table.schema, filesystem=system, compression="zstd", compression_level=LEVEL
                    )
                writers[state].write_table(table)
                held[state].clear()

        try:
            for x in pieces(iterator):
                for state in STATES:
                    some = x.filter(pc.equal(x.column("state"), state))  # a copy, so that no batch is held
                    if len(some):
                        done.rows[state] += len(some)
                        if state == "ok":
                            buckets.update(pc.unique(some.column("bucket")).to_pylist())
                        held[state].append(some.drop_columns(["state", "bucket"]))
                        if sum(b.nbytes for b in held[state]) >= GROUP:
                            flush(state)
            for state in STATES:
                flush(state)
        finally:
            for writer in writers.values():
                writer.close()
        done.buckets = sorted(buckets)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """One entry makes the attempt visible; files of earlier attempts of the batch are then garbage."""
        parts = [m for m in messages if m is not None]
        entry = {
            "run_id": self.run_id, "batch_id": self.batch_id, "attempt": self.attempt, "seq": time.time_ns(), "folder": self.folder,
            "rows": sum(m.rows["ok"] for m in parts), "rejects": sum(m.rows["reject"] for m in parts),
            "buckets": sorted({b for m in parts for b in m.buckets}),
        }
        system, root = located(self.path)
        system.create_dir(f"{root}/manifest")
        final = f"{root}/manifest/{entry['seq']:020d}-{self.attempt}.json"
        hidden = f"{root}/manifest/_{self.attempt}"
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps(entry).encode() + b"\n")
        system.move(hidden, final)
        batch = f"{root}/{self.folder.rsplit('/', 1)[0]}"
        for info in system.get_file_info(fs.FileSelector(batch, allow_not_found=True)):
            if info.type == fs.FileType.Directory and info.base_name != f"attempt={self.attempt}":
                system.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.folder}")
