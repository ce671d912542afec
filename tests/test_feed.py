"""The live feed, source links, and progress tables."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsprep.sources import feed_stream, link_sources, read_collection, read_sources
from newsprep.streaming import news_stream

from .test_collection import article


def land(folder, name, *articles):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.txt").write_text("\n".join(json.dumps([a]) for a in articles) + "\n")


def test_restart_without_loss_or_repeat(spark, tmp_path):
    folder, dst = tmp_path / "feed", f"{tmp_path}/c"
    counts = []

    def run(symbols=None):
        stream = feed_stream(spark, "tests.feed:open_feed", symbols, splits=3, folder=str(folder))
        news_stream(spark, stream, dst, f"{tmp_path}/state", "live", dim=8, max_tokens=8, trigger={"availableNow": True}, sample=2,
                    tap=lambda n, c: counts.append((n, c["articles"]))).awaitTermination()

    land(folder, "0", *[article(i, f"text {i}") for i in range(5)])
    run()
    land(folder, "1", *[article(i, f"text {i}") for i in range(5, 12)])
    run()
    run()  # nothing new
    assert [c for _, c in counts] == [5, 7]
    asked = [int(x) for x in (folder / "asked.log").read_text().split()]
    assert set(asked) == set(range(12)) and not any(p < 5 for p in asked[asked.index(max(asked)) :])
    assert {r["payload"]["text"] for r in read_collection(spark, dst).collect()} >= {f"text {i}" for i in range(12)}
    assert spark.read.parquet(f"{dst}/frame_sample").groupBy("batch_id").count().agg(F.max("count")).first()[0] == 2


def test_symbols_are_passed_on(spark, tmp_path):
    folder = tmp_path / "feed"
    land(folder, "0", article(1, "a", symbols=["X", "Y"]), article(2, "b", symbols=["Z"]), article(3, "c", symbols=["Y"]))
    out = f"{tmp_path}/out"
    stream = feed_stream(spark, "tests.feed:open_feed", ["Y"], start=1, folder=str(folder))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    rows = {r["position"]: json.loads(r["value"]) for r in spark.read.parquet(out).collect()}
    assert set(rows) == {1, 2} and rows[1] == [] and rows[2][0]["id"] == 3


def test_links_keep_the_last_write_of_each_pair(spark, tmp_path):
    path = f"{tmp_path}/c"
    assert read_sources(spark, path).collect() == []

    def put(batch, *rows):
        made = [(c, a, d, datetime(2024, 1, day)) for c, a, d, day in rows]
        link_sources(spark.createDataFrame(made, "chunk_id string, article_id long, doc_id string, updated_at timestamp"), path, "r", batch)

    put(0, ("c", 1, "d1", 1), ("c", 2, "d2", 1), ("c", 1, "d0", 2))
    put(1, ("c", 1, "d3", 1), ("e", 1, "d3", 1))
    now = lambda: sorted((r["chunk_id"], r["article_id"], r["doc_id"]) for r in read_sources(spark, path).collect())
    assert now() == [("c", 1, "d0"), ("c", 2, "d2"), ("e", 1, "d3")]
    put(0, ("c", 2, "d2", 1))
    assert now() == [("c", 1, "d3"), ("c", 2, "d2"), ("e", 1, "d3")]


def test_a_feed_that_sends_other_positions_fails(spark):
    from newsprep.sources.feed import FeedReader, Range

    class Wrong(FeedReader):
        def _feed(self):
            return type("F", (), {"frames": lambda self, a, b: [(b, "x")]})()

    with pytest.raises(ValueError, match="position 4"):
        list(Wrong({}).read(Range(1, 4)))
