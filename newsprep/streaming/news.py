"""The live news stream into the collection (STM-1..5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsprep.functions.tokens import MakeCount
from newsprep.operators.encode import MakePredict
from newsprep.operators.parse import explode_messages, good_rows, reject_rows, validate
from newsprep.plans.ingest import news_points
from newsprep.session import spread
from newsprep.sources.collection import ensure_collection, upsert
from newsprep.sources.landing import landing_stream

#: Rows that go to a Python worker at once; a chunk carries its article's summary, which may be long.
ARROW_ROWS = 2000
#: Called after each batch with its number and its counts.
Tap = Callable[[int, dict], None]


def ingest_frames(
    frames: DataFrame, dst: str, run_id: str, batch_id: int,
    make_predict_fn: MakePredict | None = None, dim: int = 384, max_tokens: int = 384,
    make_count: MakeCount | None = None,
) -> dict:
    """STM-2: one table of raw frames into the collection; returns its counts.

    Writing the same batch again replaces what it wrote before, rejects included: they are written
    in a second pass over the frames, even if there are none. A few large files are dealt out to all cores.
    """
    frames = spread(frames)
    validated = validate(explode_messages(frames))
    seen = Observation(f"batch-{run_id}-{batch_id}")
    counted = validated.observe(
        seen,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("reason").isNull() & ~F.col("is_control")).alias("articles"),
        F.count_if(F.col("reason").isNotNull()).alias("rejects"),
    )
    upsert(news_points(good_rows(counted), make_predict_fn, dim, max_tokens, make_count), dst, run_id, batch_id)
    counts = seen.get
    reject_rows(validated).write.mode("overwrite").parquet(f"{dst}/message_rejects/run_id={run_id}/batch_id={batch_id}")
    return counts


def news_stream(
    spark: SparkSession,
    src: str | DataFrame,
    dst: str,
    checkpoint: str,
    run_id: str,
    make_predict_fn: MakePredict | None = None,
    dim: int = 384,
    max_tokens: int = 384,
    make_count: MakeCount | None = None,
    max_files: int | None = None,
    trigger: dict | None = None,
    tap: Tap | None = None,
    sample: int = 0,
) -> StreamingQuery:
    """STM-1: frames landing in the folder ``src``, or a stream with ``value``, into the collection ``dst``.

    It runs until stopped; ``trigger={"availableNow": True}`` ends it after what has landed.

    Delivery is at least once; a replayed batch replaces its own partition, and ids are content
    hashes, so the latest view does not change (STM-3). The stream holds no state. ``tap`` is the
    debug hook (STM-4); counts come from the job itself (STM-5). ``sample`` frames of each batch are kept beside
    the collection for a look at them.
    """
    ensure_collection(spark, dst, dim)

    def write(frames: DataFrame, batch_id: int) -> None:
        frames.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)  # the stream has a session of its own
        if sample:
            frames.select("value").limit(sample).write.mode("overwrite").parquet(f"{dst}/frame_sample/run_id={run_id}/batch_id={batch_id}")
        counts = ingest_frames(frames, dst, run_id, batch_id, make_predict_fn, dim, max_tokens, make_count)
        if tap is not None:
            tap(batch_id, counts)

    return (
        (src if isinstance(src, DataFrame) else landing_stream(spark, src, max_files))
        .writeStream.queryName(f"news-{run_id}")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
