"""Messages, documents, chunks, intervals, symbols."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsprep import operators as op

GOOD = {
    "T": "n", "id": 7, "headline": "h", "summary": "s", "author": "a", "created_at": "2024-01-01T00:00:00Z",
    "updated_at": "2024-01-01T00:00:00Z", "url": None, "content": "<p>c</p>", "symbols": ["X"], "source": "w",
}


def frames(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_good_control_and_empty_frames(spark):
    df = frames(spark, [GOOD, {**GOOD, "id": "12"}], [{"T": "success", "msg": "connected"}], [])
    good, rejects = op.parse_messages(df)
    assert sorted(r["id"] for r in good.collect()) == [7, 12] and rejects.count() == 0
    assert good.dtypes[0] == ("id", "bigint") and good.first()["url"] is None
    assert op.explode_messages(df).count() == 3


@pytest.mark.parametrize("frame, reason", [
    ("{broken", "invalid json"),
    ([{k: v for k, v in GOOD.items() if k != "summary"}], "missing summary"),
    ([{**GOOD, "symbols": None}], "missing symbols"),
    ([{**GOOD, "symbols": ["X", None]}], "null symbol"),
    ([{**GOOD, "id": "x1"}], "bad id"),
    ([{**GOOD, "updated_at": "soon"}], "bad updated_at"),
])
def test_rejects_keep_the_rest_of_the_frame(spark, frame, reason):
    rest = [GOOD] if isinstance(frame, str) else [*frame, GOOD]
    df = frames(spark, frame, [GOOD]) if isinstance(frame, str) else frames(spark, rest)
    good, rejects = op.parse_messages(df)
    assert good.count() == 1
    row = rejects.first()
    assert row["reason"] == reason and row["raw"]


def test_failfast(spark):
    good, _ = op.parse_messages(frames(spark, [GOOD], "{broken"), "failfast")
    with pytest.raises(Exception, match="bad message: invalid json"):
        good.collect()
    good, _ = op.parse_messages(frames(spark, [GOOD], [{"T": "success"}]), "failfast")
    assert good.count() == 1
    with pytest.raises(ValueError):
        op.parse_messages(frames(spark, [GOOD]), "other")


def test_document_parts_and_payload(spark):
    good, _ = op.parse_messages(frames(spark, [{**GOOD, "headline": " one two ", "summary": "", "content": "<p>x</p><p>y</p>"}]))
    document = op.to_documents(good).first()
    assert document["text"] == ["one two", "", "x y"] and document["metadata"]["headline"] == "one two"
    points = op.to_points(op.chunk(op.to_documents(good), 1)).orderBy("part", "pos").collect()
    assert [(p["part"], p["pos"], p["payload"]["text"]) for p in points] == [
        (0, 0, "one"), (0, 1, "two"), (2, 0, "x"), (2, 1, "y")]


@pytest.mark.parametrize("n, expected", [(0, 0), (1, 1), (3, 1), (4, 2), (7, 3)])
def test_word_chunks(spark, n, expected):
    text = "  ".join(f"w{i}" for i in range(n))
    chunks = spark.createDataFrame([([text],)], "text array<string>").transform(op.chunk, 3).orderBy("pos").collect()
    assert len(chunks) == expected and " ".join(c["chunk"] for c in chunks) == " ".join(text.split())
    assert all(len(c["chunk"].split()) <= 3 for c in chunks)


def test_a_large_budget_and_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(100_000))
    chunks = spark.createDataFrame([([text],)], "text array<string>").transform(op.chunk, 8192).orderBy("pos").collect()
    assert len(chunks) == 13 and " ".join(c["chunk"] for c in chunks) == text


def test_equal_parts_give_equal_chunks(spark):
    points = op.to_points(op.chunk(
        spark.createDataFrame([(["a b", "a b", "a b"],)], "text array<string>").withColumn("metadata", F.struct(F.lit(1).alias("created_at"))), 8))
    assert points.count() == 3 and points.select("chunk_id").distinct().count() == 1


def test_each_text_is_cleaned_once(spark, plan, tmp_path):
    """No copy of the cleaning is pushed below the explode or into the scan."""
    good, _ = op.parse_messages(frames(spark, [GOOD]))
    good.write.parquet(f"{tmp_path}/news")
    chunks = op.to_points(op.chunk(op.to_documents(spark.read.parquet(f"{tmp_path}/news")), 4))
    assert plan(chunks).count("<script") == 1 and "PushedFilters: []" in plan(chunks)


def make_letters():
    return lambda words: [len(w) for w in words]


def greedy(words, budget):
    out, held = [], []
    for w in words:
        if held and sum(map(len, held)) + len(w) > budget:
            out, held = [*out, " ".join(held)], []
        if len(w) > budget:
            out += [w[i:i + budget] for i in range(0, len(w), budget)]
        else:
            held.append(w)
    return [*out, " ".join(held)] if held else out


def test_token_chunks_match_a_plain_loop(spark):
    texts = ["", "abc", "ab cd ef", "abcdefghijklm no p", "a " * 50, "xxxx yyyy zzzzz w", "aaaaaaaaaaa"]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "i int, text array<string>")
    rows = op.chunk(df, 5, make_letters).orderBy("i", "pos").collect()
    for i, text in enumerate(texts):
        assert [r["chunk"] for r in rows if r["i"] == i] == greedy(text.split(), 5)
    assert {r["chunk"] for r in rows if r["hard_split"]} >= {"abcde", "fghij", "klm"}


@pytest.mark.parametrize("n", [1, 3, 7])
def test_intervals_cover_the_range_once(spark, n):
    lo, hi = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1)
    cuts = op.intervals(spark, lo, hi, n).select(
        "interval", F.unix_micros("interval_start").alias("a"), F.unix_micros("interval_end").alias("b")).orderBy("interval").collect()
    assert len(cuts) == n and cuts[0]["a"] == 1704067200_000_000 and cuts[-1]["b"] == 1704067201_000_000
    assert all(x["b"] == y["a"] for x, y in zip(cuts, cuts[1:]))
    edges = sorted({c["a"] + d for c in cuts for d in (-1, 0, 1)} - {cuts[0]["a"] - 1})
    rows = spark.createDataFrame([(e,) for e in edges], "us bigint").withColumn("created_at", F.timestamp_micros("us")).withColumn("id", F.col("us"))
    for row in op.backfill(rows, lo, hi, n).collect():
        cut = cuts[row["interval"]]
        assert cut["a"] <= row["us"] < cut["b"]


def test_empty_range(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, created_at timestamp")
    assert op.backfill(rows, datetime(2024, 1, 1), datetime(2024, 1, 1), 4).count() == 0


def test_range_filter_reaches_the_scan(spark, plan, tmp_path):
    spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, created_at timestamp").write.parquet(f"{tmp_path}/x")
    text = plan(op.backfill(spark.read.parquet(f"{tmp_path}/x"), datetime(2024, 1, 1), datetime(2024, 2, 1), 4))
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text and "Exchange" not in text


def test_symbols(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["C"]), (3, [])], "id int, symbols array<string>")
    assert [r["id"] for r in op.by_symbols(df, ["B", "C"]).orderBy("id").collect()] == [1, 2]
    assert op.by_symbols(df, ["*", "B"]).count() == 3 and op.by_symbols(df, ["Z"]).count() == 0


def test_more_workers_than_symbols_lose_nothing(spark):
    df = spark.createDataFrame([(i, ["HOT"] if i % 3 else ["HOT", f"S{i}"]) for i in range(3000)], "id int, symbols array<string>")
    rows = op.spread_by_symbol(df, 50)
    assert rows.count() == 4000
    assert rows.groupBy("symbol").agg(F.countDistinct("worker").alias("n")).where("n > 1").count() == 0
    sizes = rows.where("symbol = 'HOT'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 3000 / 3


def test_zip_refuses_unequal_arrays(spark):
    df = spark.createDataFrame([(["a", "b"], [[1.0], [2.0]], ["x", "y"]), (["c"], [], ["z"]), (["c"], None, ["z"])], "i array<string>, v array<array<float>>, p array<string>")
    assert [tuple(r) for r in op.zip_points(df, "i", "v", "p").collect()] == [("a", [1.0], "x"), ("b", [2.0], "y")]
    assert op.unequal(df, "i", "v", "p").count() == 2
