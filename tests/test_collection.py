"""The collection, the paged source and the stream."""

import json
from datetime import datetime

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from newsprep import plans
from newsprep.operators import latest
from newsprep.sources import (
    compact, ensure_collection, landing_batch, parse_pages, read_collection, read_pages, read_rejects, upsert,
)
from newsprep.sources import folder_pages
from newsprep.sources.collection import POINT_SCHEMA
from newsprep.sources.paged import PagedNewsReader
from newsprep.streaming import ingest_frames, news_stream


def points(spark, *rows):
    """Rows of (chunk_id, day, summary, vector)."""
    made = [
        (i, v, None, ("h", s, None, ["X"], "a", datetime(2024, 1, day), i), datetime(2024, 1, day), day, 0, 0)
        for i, day, s, v in rows
    ]
    return spark.createDataFrame(made, POINT_SCHEMA)


def summaries(spark, path):
    return {r["chunk_id"]: r["payload"]["summary"] for r in read_collection(spark, path).collect()}


@pytest.fixture
def path(spark, tmp_path):
    ensure_collection(spark, f"{tmp_path}/c", 2)
    return f"{tmp_path}/c"


def test_last_by_data_not_by_arrival(spark, path):
    upsert(points(spark, ("x", 2, "new", [1.0, 0.0]), ("y", 1, "y", [0.0, 1.0])), path, "r", 0)
    upsert(points(spark, ("x", 1, "old", [1.0, 0.0])), path, "r", 1)
    assert summaries(spark, path) == {"x": "new", "y": "y"}
    compact(spark, path)
    upsert(points(spark, ("x", 1, "old", [1.0, 0.0])), path, "s", 0)
    assert summaries(spark, path) == {"x": "new", "y": "y"}


def test_replay_replaces_its_own_batch(spark, path):
    for _ in range(2):
        upsert(points(spark, ("x", 1, "x", [1.0, 0.0]), ("x", 2, "x2", [1.0, 0.0])), path, "r", 0)
    assert summaries(spark, path) == {"x": "x2"}
    assert spark.read.parquet(f"{path}/log").count() == 2


def test_wrong_sizes_are_rejected(spark, path):
    upsert(points(spark, ("a", 1, "a", [1.0]), ("b", 1, "b", []), ("c", 1, "c", [1.0, 2.0])), path, "r", 0)
    assert set(summaries(spark, path)) == {"c"}
    assert {r["chunk_id"]: r["error"] for r in read_rejects(spark, path).collect()} == {"a": "wrong vector size", "b": "wrong vector size"}
    assert read_collection(spark, path).first()["norm"] == pytest.approx(5 ** 0.5)


def test_collection_is_created_once(spark, path):
    ensure_collection(spark, path, 2)
    with pytest.raises(ValueError):
        ensure_collection(spark, path, 3)
    with pytest.raises(ValueError):
        ensure_collection(spark, path + "2", 3, "dot")
    with pytest.raises(ValueError):
        upsert(points(spark), path + "2", "r", 0)
    assert summaries(spark, path) == {}


def test_compaction_switches_versions(spark, path):
    upsert(points(spark, ("x", 1, "1", [1.0, 0.0])), path, "r", 0)
    assert compact(spark, path) == 1
    upsert(points(spark, ("x", 2, "2", [1.0, 0.0]), ("y", 1, "y", [1.0, 0.0])), path, "r", 1)
    assert summaries(spark, path) == {"x": "2", "y": "y"}
    assert compact(spark, path) == 2 and summaries(spark, path) == {"x": "2", "y": "y"}
    # An unfinished compaction has no pointer and is not read.
    spark.read.parquet(f"{path}/versions/v=2/points").limit(0).write.parquet(f"{path}/versions/v=3/points")
    assert summaries(spark, path) == {"x": "2", "y": "y"}


def test_one_id_on_a_third_of_all_rows(spark, plan):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("chunk_id"), F.col("id").alias("updated_at"))
    one = latest(rows.repartition(8), recency=("updated_at",))
    assert "row_number(), 1, Partial" in plan(one)
    assert one.count() == 20_001 and one.where("chunk_id = 'hot'").first()["updated_at"] == 29_997


def test_pages_go_on_after_an_empty_one(spark):
    pages = read_pages(spark, "2024-01-01T00:00:00Z", "2024-01-01T00:00:04Z", 2, "tests.pages:open_pages")
    assert pages.count() == 6
    good, rejects = parse_pages(pages)
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3] and rejects.count() == 0


def test_a_failed_page_names_its_token(spark):
    pages = read_pages(spark, "2024-01-01T00:00:00Z", "2024-01-01T00:00:04Z", 1, "tests.pages:open_pages", fail="2")
    with pytest.raises(Exception, match="token 2.*status 500"):
        pages.collect()


def article(i, text, day=1, **other):
    stamp = f"2024-01-{day:02d}T00:00:00Z"
    return {"T": "n", "id": i, "headline": f"Report {i}", "summary": f"summary {i}", "author": "a", "created_at": stamp,
            "updated_at": stamp, "url": None, "content": f"<p>{text}</p>", "symbols": ["X"], "source": "w", **other}


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "0.txt").write_text(json.dumps([{"T": "success", "msg": "connected"}]) + "\n" + json.dumps([article(1, "same text"), article(2, "other text")]))
    (folder / "1.txt").write_text("{broken\n" + json.dumps([article(3, "same text", 3), {"T": "n", "id": 9}]))
    (folder / "2.txt").write_text(json.dumps([article(1, "same text")]) + "\n[]")
    return str(folder)


def view(spark, path):
    return sorted((r["chunk_id"], r["article_id"], r["payload"]["summary"], r["payload"]["text"], tuple(r["vector"])) for r in read_collection(spark, path).collect())


def test_stream_equals_batch_and_survives_replay(spark, landing, tmp_path):
    batch, stream, seen = f"{tmp_path}/batch", f"{tmp_path}/stream", []
    ensure_collection(spark, batch, 16)
    counts = ingest_frames(landing_batch(spark, landing), batch, "b", 0, dim=16, max_tokens=4)
    assert counts == {"messages": 7, "articles": 4, "rejects": 2}

    def run(state):
        news_stream(spark, landing, stream, f"{tmp_path}/{state}", "s", dim=16, max_tokens=4, max_files=1, trigger={"availableNow": True},
                    tap=lambda n, c: seen.append((n, c))).awaitTermination()

    run("state")
    assert view(spark, stream) == view(spark, batch) and len(view(spark, stream)) == 8
    assert [n for n, _ in seen] == [0, 1, 2] and sum(c["articles"] for _, c in seen) == 4
    assert {r["reason"] for r in spark.read.parquet(f"{stream}/message_rejects").collect()} == {"invalid json", "missing headline"}
    run("state")  # nothing new
    assert len(seen) == 3
    run("fresh-state")  # the whole input again
    assert view(spark, stream) == view(spark, batch)


def test_same_text_in_two_articles_keeps_the_later_payload(spark, landing, tmp_path):
    ensure_collection(spark, f"{tmp_path}/c", 16)
    ingest_frames(landing_batch(spark, landing), f"{tmp_path}/c", "b", 0, dim=16, max_tokens=4)
    owner = {text: number for _, number, _, text, _ in view(spark, f"{tmp_path}/c")}
    assert owner["same text"] == 3 and owner["other text"] == 2


def test_dedup_before_embedding_does_not_change_the_view(spark, landing, tmp_path):
    from newsprep.operators import parse_messages
    from newsprep.sources import latest_points

    good, _ = parse_messages(landing_batch(spark, landing))
    with_, without = (plans.news_points(good, dim=16, max_tokens=4, dedup=d) for d in (True, False))
    key = ("chunk_id", "article_id", "part", "pos")
    assert sorted(with_.select(*key).collect()) == sorted(latest_points(without).select(*key).collect())
    assert without.count() > with_.count()


def test_late_and_rewritten_batches_survive_a_compaction(spark, tmp_path):
    path = f"{tmp_path}/late"
    ensure_collection(spark, path, 1)
    kind = ("chunk_id string, vector array<float>, payload struct<headline: string, summary: string, url: string, symbols: array<string>, "
            "author: string, created_at: timestamp, text: string>, updated_at timestamp, article_id bigint, part int, pos int")

    def put(batch, *rows):
        made = [(i, [1.0], None, datetime(2024, 1, day), day, 0, 0) for i, day in rows]
        upsert(spark.createDataFrame(made, kind), path, "r", batch)

    def now():
        return {r["chunk_id"]: r["article_id"] for r in read_collection(spark, path).collect()}

    put(1, ("x", 2))
    compact(spark, path)
    put(0, ("y", 1))
    put(1, ("x", 3), ("z", 1))
    assert now() == {"x": 3, "y": 1, "z": 1}
    compact(spark, path)
    assert now() == {"x": 3, "y": 1, "z": 1}


def test_bad_rows_of_a_shared_second_count_once(spark):
    """Two intervals meet within a second, and both are sent the bad article of that second."""
    value = json.dumps([{"id": 1, "created_at": "2024-01-01T00:00:01.200000Z"}])
    at = lambda micros: datetime(2024, 1, 1, 0, 0, 1, micros)
    pages = spark.createDataFrame(
        [(0, datetime(2024, 1, 1), at(500_000), 0, value), (1, at(500_000), datetime(2024, 1, 1, 0, 0, 2), 0, value)],
        "interval bigint, interval_start timestamp, interval_end timestamp, page bigint, value string")
    good, rejects = parse_pages(pages)
    assert good.count() == 0 and [r["reason"] for r in rejects.collect()] == ["missing headline"]


def test_a_batch_holds_one_page():
    reader = PagedNewsReader({"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T00:00:04Z", "fetcher": "tests.pages:open_pages"})
    batches = list(reader.read(reader.partitions()[0]))
    assert [type(b) for b in batches] == [pa.RecordBatch] * 3 and [b.num_rows for b in batches] == [1, 1, 1]


def test_pages_list_the_folder_once_and_read_an_hour_once(tmp_path, monkeypatch):
    for hour in (473352, 473353, 473360):
        (tmp_path / f"hour={hour}").mkdir()
        rows = [{"id": str(hour * 10 + i), "created_at": f"2024-01-01T{hour - 473352:02d}:0{i}:00Z"} for i in range(5)]
        (tmp_path / f"hour={hour}" / "a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    listed, loaded, selector = [], [], fs.FileSelector
    fetch = folder_pages.open_pages({"folder": f"file://{tmp_path}"})
    monkeypatch.setattr(folder_pages.fs, "FileSelector", lambda path, *a, **k: listed.append(path) or selector(path, *a, **k))
    loads = json.loads
    monkeypatch.setattr(folder_pages.json, "loads", lambda x: loaded.append(x) or loads(x))
    token, ids = None, []
    while True:
        page = fetch("2024-01-01T00:02:00Z", "2024-01-01T08:01:00Z", 2, token)
        ids += [int(r["id"]) for r in page["news"]]
        token = page["next_page_token"]
        if token is None:
            break
    assert ids == [4733522, 4733523, 4733524, *range(4733530, 4733535), 4733600, 4733601]
    assert len(listed) == len(set(listed)) == 4 and len(loaded) == 15
    assert fetch("2024-01-01T03:00:00Z", "2024-01-01T05:00:00Z", 2, None) == {"news": [], "next_page_token": None}


def test_one_file_of_frames_is_dealt_out_to_all_cores(spark, tmp_path):
    dst = str(tmp_path / "points")
    ensure_collection(spark, dst, 16)
    values = [json.dumps([article(i, f"text {i}")]) for i in range(40)] + [f"[{{broken {i}" for i in range(40)]
    frames = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
    counts = ingest_frames(frames, dst, "live", 0, dim=16, max_tokens=8)
    assert (counts["articles"], counts["rejects"]) == (40, 40)
    assert len({r["article_id"] for r in read_collection(spark, dst).collect()}) == 40
    assert len(list((tmp_path / "points" / "message_rejects").rglob("*.parquet"))) > 1
