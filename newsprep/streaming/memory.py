"""The live memory of conversations: their last question/answer pairs, kept as state (WIN-1, UDF-5).

The batch form is ``operators.history``. Here turns arrive in micro-batches; a conversation's state is
its last ``k`` pairs, the turn it ends with, and nothing else, and it goes when the conversation has
been silent for ``expire``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsprep.operators.history import chat_lines
from newsprep.operators.latest import latest

_PAIR = T.StructType([T.StructField("turn", T.LongType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
_TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds in a unit of ``expire``.
UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(interval: str) -> int:
    """``2 hours`` and the like."""
    number, unit = interval.split()
    return int(number) * UNITS[unit.rstrip("s")]


class LastPairs(StatefulProcessor):
    """Turns to the pairs of their conversation. A turn not after the last one seen is late and changes nothing."""

    def __init__(self, k: int, expire_ms: int | None, user: str, assistant: str):
        self.k, self.expire_ms, self.user, self.assistant = k, expire_ms, user, assistant

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getListState("pairs", _PAIR)
        self.last = handle.getValueState("last", _TURN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(p) for p in self.pairs.get()] if self.pairs.exists() else []
        last = tuple(self.last.get()) if self.last.exists() else None
        late = 0
        for turn, role, text in sorted(((r.turn, r.role or "", r.text) for r in rows), key=lambda r: r[0]):
            if last is not None and turn <= last[0]:
                late += 1
                continue
            if last is not None and last[1] == self.user and role == self.assistant:
                held = [*held, (last[0], last[2], text)][-self.k :]
            last = turn, role, text
        if late == 0 or last is not None:
            self.pairs.put(held) if held else self.pairs.clear()
            self.last.update(last)
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield Row(conv_id=key[0], last_turn=last[0], pairs=[Row(turn=t, question=q, answer=a) for t, q, a in held], late=late, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()
        self.pairs.clear()
        self.last.clear()
        yield Row(conv_id=key[0], last_turn=last[0], pairs=[], late=0, expired=True)

    def close(self) -> None:
        pass


def last_pairs(turns: DataFrame, k: int = 3, expire: str | None = "1 day", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """``conv_id, last_turn, pairs, late, expired`` of every conversation that a micro-batch touches, from a stream of ``conv_id, turn, role, text``.

    Turns of a conversation may stand in any order within a micro-batch and come in ascending order over
    them; ``late`` counts those that did not. An expired conversation is sent once more, empty; without ``expire`` none expires.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("last_turn", T.LongType()), T.StructField("pairs", T.ArrayType(_PAIR)),
        T.StructField("late", T.LongType()), T.StructField("expired", T.BooleanType()),
    ])
    narrow = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return narrow.groupBy("conv_id").transformWithState(
        LastPairs(k, expire and millis(expire), user, assistant), schema, "Update", "ProcessingTime" if expire else "None"
    )


def memory_stream(
    turns: DataFrame, dst: str, checkpoint: str, k: int = 3, expire: str | None = "1 day", trigger: dict | None = None, **roles: str
) -> StreamingQuery:
    """Keeps the memory of every conversation in the table ``dst``; a replayed micro-batch replaces its own folder.

    With ``expire`` the stream wakes for its timers and runs until it is stopped.
    """
    if expire and trigger and trigger.get("availableNow"):
        raise ValueError("a stream with timers does not end: set expire to None, or another trigger")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{dst}/batch_id={batch_id}")

    return (
        last_pairs(turns, k, expire, **roles).writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id, pairs, chat_history`` of the conversations that hold a pair, as ``operators.history`` gives them."""
    now = latest(spark.read.parquet(path), "conv_id", ("batch_id",)).where(F.size("pairs") > 0)
    return now.select("conv_id", "pairs").withColumn("chat_history", chat_lines("pairs"))
