"""The live memory against the batch history."""

import random

import pytest
from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep.streaming.memory import memory_stream, millis, read_memory

KIND = "conv_id long, turn long, role string, text string"


def turns_of(seed, conversations=12):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, 14)):
            turn += rng.randint(1, 2)
            out.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None]), f"{conv}-{turn}"))
    return out


def run(spark, tmp_path, batches, name, **options):
    """Each list of turns is a file, and a file is a micro-batch."""
    src, dst, state = (f"{tmp_path}/{name}-{x}" for x in ("src", "dst", "state"))
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(src)
        memory_stream(stream, dst, state, expire=None, trigger={"availableNow": True}, **options).awaitTermination()
    return dst


def pairs(df):
    return {r["conv_id"]: ([(p["turn"], p["question"], p["answer"]) for p in r["pairs"]], r["chat_history"]) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 3])
def test_any_split_equals_the_batch_history(spark, tmp_path, n):
    rows = turns_of(n)
    rng = random.Random(7)
    cut = {conv: sorted(rng.randint(0, 30) for _ in range(n - 1)) for conv in range(12)}
    batches = [[] for _ in range(n)]
    for row in rows:
        batches[sum(row[1] > c for c in cut[row[0]])].append(row)
    for b in batches:
        rng.shuffle(b)
    dst = run(spark, tmp_path, [b for b in batches if b], "m", k=3)
    wanted = pairs(op.history(spark.createDataFrame(rows, KIND), 3))
    assert wanted and pairs(read_memory(spark, dst)) == wanted


def test_late_turns_are_counted_and_change_nothing(spark, tmp_path):
    dst = run(spark, tmp_path, [[(1, 5, "user", "q"), (1, 6, "assistant", "a")], [(1, 2, "user", "late"), (1, 7, "user", "open"), (2, 1, "user", "x")]], "late")
    assert pairs(read_memory(spark, dst)) == {1: ([(5, "q", "a")], "Human: q\nAI: a")}
    assert spark.read.parquet(dst).agg(F.sum("late")).first()[0] == 1


def test_a_silent_conversation_is_forgotten(spark, tmp_path):
    import time

    src, dst, state = (f"{tmp_path}/silent-{x}" for x in ("src", "dst", "state"))
    with pytest.raises(ValueError):
        memory_stream(spark.readStream.schema(KIND).json(str(tmp_path)), dst, state, trigger={"availableNow": True})
    spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "a")], KIND).coalesce(1).write.json(src)
    stream = spark.readStream.schema(KIND).json(src)
    query = memory_stream(stream, dst, state, expire="1 second", trigger={"processingTime": "1 second"})
    try:
        for _ in range(40):
            time.sleep(1)
            if query.lastProgress and spark.read.schema("expired boolean").option("recursiveFileLookup", True).parquet(dst).where("expired").count():
                break
    finally:
        query.stop()
    assert pairs(read_memory(spark, dst)) == {}


def test_intervals():
    assert millis("1 day") == 86_400_000 and millis("2 hours") == 7_200_000
