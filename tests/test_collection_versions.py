"""The collection as a transactional store: rewritten and failed batches, buckets, snapshots, vacuum, data skipping."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsprep.sources import collection, compact, ensure_collection, read_collection, read_rejects, snapshot, upsert, vacuum
from newsprep.sources.collection import POINT_SCHEMA


def points(spark, *rows):
    """Rows of (id, day)."""
    made = [(i, [1.0, 0.0], None, ("h", f"{i}@{day}", None, [], "a", datetime(2024, 1, day), i), datetime(2024, 1, day), day, 0, 0) for i, day in rows]
    return spark.createDataFrame(made, POINT_SCHEMA)


def view(spark, path, **options):
    rows = read_collection(spark, path, **options).collect()
    out = {r["chunk_id"]: r["article_id"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def path(spark, tmp_path):
    ensure_collection(spark, f"{tmp_path}/c", 2, buckets=8)
    return f"{tmp_path}/c"


@pytest.mark.parametrize("between", [False, True])
def test_a_rewritten_batch_replaces_its_rows(spark, path, between):
    upsert(points(spark, ("x", 1), ("y", 1), ("z", 1)), path, "r", 0)
    upsert(points(spark, ("z", 2)), path, "r", 1)
    if between:
        compact(spark, path)
    upsert(points(spark, ("x", 1)), path, "r", 0)
    assert view(spark, path) == {"x": 1, "z": 2}
    compact(spark, path)
    assert view(spark, path) == {"x": 1, "z": 2}
    upsert(points(spark).limit(0), path, "r", 0)  # written again without rows
    assert view(spark, path) == {"z": 2}


@pytest.mark.parametrize("between", [False, True])
def test_what_a_replaced_batch_had_hidden_comes_back(spark, path, between):
    upsert(points(spark, ("x", 1), ("y", 3)), path, "r", 0)
    upsert(points(spark, ("x", 2), ("y", 2)), path, "r", 1)
    if between:
        compact(spark, path)
    assert view(spark, path) == {"x": 2, "y": 3}
    upsert(points(spark, ("w", 1)), path, "r", 1)
    assert view(spark, path) == {"x": 1, "y": 3, "w": 1}
    compact(spark, path)
    assert view(spark, path) == {"x": 1, "y": 3, "w": 1}


def test_a_failed_write_shows_nothing(spark, path):
    upsert(points(spark, ("x", 1)), path, "r", 0)
    fail = F.udf(lambda i: 1 / 0 if i == "bad" else i)
    bad = points(spark, *[(f"n{i}", 2) for i in range(20)], ("bad", 2)).repartition(4).withColumn("chunk_id", fail("chunk_id"))
    for batch in (0, 1):
        with pytest.raises(Exception, match="ZeroDivision"):
            upsert(bad, path, "r", batch)
        assert view(spark, path) == {"x": 1}
        compact(spark, path)
        assert view(spark, path) == {"x": 1}


def test_names_of_runs_may_hold_anything(spark, path):
    for run in ("a/b", "c=d e", "ü%"):
        upsert(points(spark, (run, 1)), path, run, 0)
        upsert(points(spark, (run, 2)), path, run, 0)
    assert view(spark, path) == {"a/b": 2, "c=d e": 2, "ü%": 2}
    compact(spark, path)
    upsert(points(spark, ("new", 2)), path, "a/b", 0)
    assert view(spark, path) == {"new": 2, "c=d e": 2, "ü%": 2}


def bucket_of(spark, i):
    return spark.createDataFrame([(i,)], "chunk_id string").select(collection._bucket(8).alias("b")).first()["b"]


def test_one_bucket_is_read_and_rewritten(spark, path):
    upsert(points(spark, *[(f"i{n}", 1) for n in range(200)]), path, "r", 0)
    compact(spark, path)
    before = {f["folder"] for f in snapshot(spark, path).files}
    assert len({f["bucket"] for f in snapshot(spark, path).files}) == 8
    upsert(points(spark, ("i7", 2)), path, "r", 1)
    mine = bucket_of(spark, "i7")
    state = snapshot(spark, path)
    assert state.touched() == [mine]
    read = collection._writes(spark, path, state, earlier=True).inputFiles()
    assert read and all(f"bucket={mine}/" in f or "/log/" in f for f in read)
    assert compact(spark, path) == 2 and view(spark, path) == {**{f"i{n}": 1 for n in range(200)}, "i7": 2}
    after = {f["folder"] for f in snapshot(spark, path).files}
    assert {f for f in after if "v=1/" in f} == {f for f in before if f"bucket={mine}/" not in f}
    assert {f.split("/")[3] for f in after if "v=2/" in f} == {f"bucket={mine}"}
    assert compact(spark, path) == 2  # nothing new


def test_vacuum_keeps_what_can_be_read(spark, path):
    upsert(points(spark, *[(f"i{n}", 1) for n in range(50)], ), path, "r", 0)
    upsert(points(spark, ("bad", 1)).withColumn("vector", F.array(F.lit(1.0).cast("float"))), path, "r", 9)
    compact(spark, path)
    upsert(points(spark, ("i7", 2)), path, "r", 1)
    compact(spark, path)
    upsert(points(spark, ("i8", 3)), path, "r", 2)
    now, first, second = view(spark, path), view(spark, path, version=1), view(spark, path, version=2)
    assert (first["i7"], second["i7"], now["i8"]) == (1, 2, 3)
    points(spark, ("junk", 1)).write.parquet(f"{path}/versions/v=3/points/bucket=0/live=true")  # compactions and writes that failed
    points(spark, ("junk", 1)).write.parquet(f"{path}/log/run_id=r/batch_id=5/attempt=lost/state=ok")
    assert vacuum(spark, path, keep=2) == []  # all of it is young
    gone = vacuum(spark, path, keep=2, grace=timedelta(0))
    assert "versions/v=3" in gone[0] and "log/run_id=r/batch_id=5/attempt=lost" in gone
    assert (view(spark, path), view(spark, path, version=1), view(spark, path, version=2)) == (now, first, second)
    gone = vacuum(spark, path, keep=1, grace=timedelta(0))
    assert gone and all(g.startswith(f"versions/v=1/points/bucket={bucket_of(spark, 'i7')}/") for g in gone)
    assert (view(spark, path), view(spark, path, version=2)) == (now, second)
    assert [r["chunk_id"] for r in read_rejects(spark, path).collect()] == ["bad"]
    upsert(points(spark, ("i9", 4)), path, "r", 0)  # a batch whose files and entry are gone is written again
    assert view(spark, path) == {"i7": 2, "i8": 3, "i9": 4}


def test_files_outside_the_range_are_not_opened(spark, path, monkeypatch):
    monkeypatch.setattr(collection, "FILE_ROWS", 20)
    ids = [f"i{n}" for n in range(800)]
    upsert(points(spark, *[(i, 1 + n % 28) for n, i in enumerate(ids)]), path, "r", 0)
    compact(spark, path)
    bounds = datetime(2024, 1, 3), datetime(2024, 1, 5)
    found = read_collection(spark, path, *bounds)
    every = read_collection(spark, path).inputFiles()
    assert 0 < len(found.inputFiles()) <= len(every) // 3
    assert view(spark, path, start=bounds[0], end=bounds[1]) == {i: 1 + n % 28 for n, i in enumerate(ids) if 1 + n % 28 in (3, 4)}
    # A later write outside the range hides the one within it, and an earlier one within it shows nothing.
    upsert(points(spark, (ids[2], 20), (ids[9], 4), (ids[3], 5)), path, "r", 1)
    wanted = {i: 1 + n % 28 for n, i in enumerate(ids) if 1 + n % 28 in (3, 4)}
    del wanted[ids[2]], wanted[ids[3]]
    assert view(spark, path, start=bounds[0], end=bounds[1]) == wanted
    assert view(spark, path, end=datetime(2023, 1, 1)) == {}
    assert view(spark, path, start=datetime(2024, 1, 28)) == {i: 28 for n, i in enumerate(ids) if n % 28 == 27}


def test_without_earlier_writes(spark, path):
    upsert(points(spark, ("x", 1), ("y", 1)), path, "r", 0)
    upsert(points(spark, ("x", 2)), path, "r", 1)
    compact(spark, path, keep_earlier=False)
    assert view(spark, path) == {"x": 2, "y": 1} and all(f["live"] for f in snapshot(spark, path).files)
    upsert(points(spark, ("z", 1)), path, "r", 1)
    assert view(spark, path) == {"y": 1, "z": 1}


def test_buckets_are_agreed_on(spark, path):
    ensure_collection(spark, path, 2)
    with pytest.raises(ValueError):
        ensure_collection(spark, path, 2, buckets=9)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_history_against_a_plain_model(spark, path, seed):
    """Batches written, written again, folded in and vacuumed in any order: always the last write of the last attempts."""
    rng = random.Random(seed)
    batches = {}
    for _ in range(14):
        step = rng.random()
        if step < 0.6:
            key = rng.choice("rs"), rng.randrange(3)
            batches[key] = [(f"i{rng.randrange(6)}", rng.randint(1, 28)) for _ in range(rng.randint(0, 4))]
            upsert(points(spark, *batches[key]) if batches[key] else points(spark).limit(0), path, *key)
        elif step < 0.85:
            compact(spark, path)
        else:
            vacuum(spark, path, grace=timedelta(0))
        wanted = {}
        for rows in batches.values():
            for i, day in rows:
                wanted[i] = max(day, wanted.get(i, 0))
        assert view(spark, path) == wanted


def test_large_batches_against_a_plain_model(spark, path, monkeypatch, plan):
    """All rows count as many and all files as large: bits instead of places, files written again where they are read."""
    monkeypatch.setattr(collection, "PLACES", 0)
    monkeypatch.setattr(collection, "APART", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng, batches = random.Random(3), {}
        for step in range(6):
            batches[step % 4] = [(f"i{rng.randrange(300)}", rng.randint(1, 28)) for _ in range(200)]
            upsert(points(spark, *batches[step % 4]), path, "r", step % 4)
            if step in (1, 2, 4):
                compact(spark, path, keep_earlier=True)
            wanted = {}
            for rows in batches.values():
                for i, day in rows:
                    wanted[i] = max(day, wanted.get(i, 0))
            assert view(spark, path) == wanted
        text = plan(read_collection(spark, path))
        assert "SortMergeJoin [_file" not in text and "BroadcastHashJoin [_file" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bits_of_places(spark):
    rows = [("f", r, r % 3 == 0) for r in (0, 1, 3, 7, 8, 9, 32767, 32768, 65537)] + [("g", 6, True)]
    places = spark.createDataFrame(rows, "_file string, _row long, _wins boolean")
    asked = collection._placed(spark.createDataFrame([("f", r) for r in range(65600)] + [("g", 6), ("h", 6)], "_file string, _row long"))
    found = asked.join(collection._bitmaps(places), ["_file", "_part"], "left").select(
        "_file", "_row", collection._bit("_compared").alias("compared"), collection._bit("_winners").alias("wins")
    ).where("compared OR wins").collect()
    assert sorted((r["_file"], r["_row"], r["wins"]) for r in found) == sorted(rows) and all(r["compared"] for r in found)


def test_a_task_of_the_sink_holds_little(spark, path):
    rng = random.Random(5)
    made = points(spark, ("x", 1)).crossJoin(spark.createDataFrame([(rng.randbytes(1000).hex(),) for _ in range(12000)], "noise string").coalesce(1))
    upsert(made.withColumn("chunk_id", F.md5("noise")).withColumn("payload", F.col("payload").withField("text", F.col("noise"))).drop("noise"), path, "r", 0)
    files = list(Path(path).glob("log/*/*/*/state=ok/*.parquet"))
    groups = [m.row_group(g) for f in files for m in [pq.read_metadata(f)] for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12000 and max(g.total_byte_size for g in groups) < 12 << 20


def test_a_large_compaction_goes_in_rounds_and_leaves_whole_files(spark, path, monkeypatch):
    """A round holds some of the rows; a file whose rows are all hidden now is only listed anew."""
    monkeypatch.setattr(collection, "PLACES", 0)
    monkeypatch.setattr(collection, "APART", 1)
    monkeypatch.setattr(collection, "ROUND_ROWS", 100)
    ids = [f"i{n}" for n in range(400)]
    upsert(points(spark, *[(i, 1 + n % 20) for n, i in enumerate(ids)]), path, "r", 0)
    compact(spark, path)
    first = {(f["folder"], f["file"]) for f in snapshot(spark, path).files}
    per_bucket = {}
    for f in snapshot(spark, path).files:
        per_bucket.setdefault(f["bucket"], []).append((f["low"], f["high"]))
    assert all(len(x) == 4 and all(a[1] < b[0] for a, b in zip(sorted(x), sorted(x)[1:])) for x in per_bucket.values())
    upsert(points(spark, *[(i, 3 + n % 20) for n, i in enumerate(ids)]), path, "r", 1)
    compact(spark, path)
    files = snapshot(spark, path).files
    assert {(f["folder"], f["file"]) for f in files if not f["live"]} == first
    assert sum(f["rows"] for f in files if f["live"]) == 400 and not Path(path, "versions/v=2/standing").exists()
    assert sum(pq.read_metadata(f).num_rows for f in Path(path).glob("versions/v=2/points/*/*/*.parquet")) == 400
    assert view(spark, path) == {i: 3 + n % 20 for n, i in enumerate(ids)} and view(spark, path, version=1) == {i: 1 + n % 20 for n, i in enumerate(ids)}
    # Files with rows of both kinds, and of a batch that is written again, are written again.
    upsert(points(spark, *[(i, 28) for i in ids[::3]]), path, "r", 2)
    compact(spark, path)
    wanted = {i: 28 if n % 3 == 0 else 3 + n % 20 for n, i in enumerate(ids)}
    assert view(spark, path) == wanted
    upsert(points(spark, ("i1", 2)), path, "r", 1)
    wanted = {i: 28 if n % 3 == 0 else 1 + n % 20 for n, i in enumerate(ids)} | {"i1": 2}
    assert view(spark, path) == wanted
    compact(spark, path)
    vacuum(spark, path, grace=timedelta(0))
    assert view(spark, path) == wanted
    upsert(points(spark, ("i2", 27)), path, "r", 3)
    compact(spark, path, keep_earlier=False)
    assert view(spark, path) == wanted | {"i2": 27} and all(f["live"] for f in snapshot(spark, path).files if f["bucket"] == bucket_of(spark, "i2"))


@pytest.mark.parametrize("days", [[1], [None], [1, 1, 1, 1, 2, None], list(range(1, 29))])
def test_rounds_part_all_rows(spark, monkeypatch, days):
    monkeypatch.setattr(collection, "ROUND_ROWS", 100)
    rows = [(n, n % 16, (datetime(2024, 1, days[n % len(days)]) if days[n % len(days)] else None,)) for n in range(600)]
    made = spark.createDataFrame(rows, "n int, bucket int, payload struct<created_at timestamp>")
    found = [[r["n"] for r in made.where(part).collect()] for part in collection._rounds(made, 600)]
    assert sorted(sum(found, [])) == list(range(600)) and len(found) >= 6 and max(map(len, found)) <= 300
    assert len(collection._rounds(made, 100)) == 1


def test_latest_of_a_table_is_the_latest(spark, tmp_path, plan):
    rng = random.Random(7)
    rows = [(f"i{rng.randrange(60)}", rng.randint(1, 9)) for _ in range(400)]
    made = points(spark, *rows).unionByName(points(spark, *rows[:50])).withColumn("chunk_id", F.when(F.col("article_id") < 9, F.col("chunk_id")))
    made = made.withColumn("updated_at", F.when(F.col("article_id") % 2 == 0, F.col("updated_at"))).repartition(5)
    found = collection.latest_points_kept(made, f"{tmp_path}/kept")
    key = lambda r: (r["chunk_id"] or "", r["updated_at"], r["article_id"], r["payload"]["created_at"])
    assert found.columns == made.columns
    assert sorted(map(str, map(key, found.collect()))) == sorted(map(str, map(key, collection.latest_points(made).collect())))
    assert "Exchange" not in plan(found).split("BroadcastExchange")[0]  # whole rows are not shuffled
