"""The registered queries of the subpackage: names, SQL, and the pipeline stage by stage."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsprep.llm import decontaminate, mixing, neardup
from newsprep.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def normal(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    wanted = duck.sql(ORACLES[name])
    columns = sorted(wanted.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    places = [wanted.columns.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in places) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole_table(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_language_is_learned(spark):
    found = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, DATA).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [i for i, r in found.items() if r["held_out"]]
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)


def test_quality_is_learned(spark):
    found = {r["doc_id"]: r for r in QUERIES["op12_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [r for r in labels if found[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(found[r["doc_id"]]["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    ids = {r["doc_id"] for r in docs.collect()}
    kept = {r["doc_id"] for r in neardup.near_duplicates(docs, words=5, threshold=80).where("kept").collect()}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    clean = {r["doc_id"] for r in decontaminate.decontaminate(docs, items).where("found.n_hit = 0").collect()}
    left = docs.where(docs.doc_id.isin(list(kept & clean & ids)))
    times = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix(left).collect()}
    result = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(i for i, n in times.items() for _ in range(n))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_near_duplicates_by_five_words(spark):
    """One document of each group of texts with four fifths of their shingles of five words in common, by brute force."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base), " ".join(base + [f"x{i}" for i in range(40)])]  # 196 of 236 in common
    for i in range(40):  # copies of several bases, from near to far
        words = [f"b{i % 4}x{j}" for j in range(150)] + [f"end{i}x{j}" for j in range(5 * (i // 4))]
        texts.append(" ".join(words))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    name = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(len(sets)):
                if name[b] < name[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    name[a], changed = name[b], True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    left = neardup.without_near_duplicates(docs, words=5, threshold=80)
    assert name[1] == 0 and sorted(r["doc_id"] for r in left.collect()) == sorted(set(name))


def test_language_stage_without_labels(spark):
    """Where no row has a language, only texts without a letter are dropped."""
    rows = [(1, "the house", None), (2, "12 !?", None), (3, None, None), (4, "日本", None), (5, "", None), (6, "x", None)]
    left = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), DATA)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 6]


def test_pipeline_stages_on_nulls_and_nothing(spark):
    """Every stage takes nulls in any column, empty texts, repeated rows and an empty table, and keeps its columns."""
    rows = [(1, "the house stands here", "en", "a"), (1, "the house stands here", "en", "a"), (2, None, None, None), (3, "", "en", None), (None, "one word", None, "a"), (4, "!?", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("size", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        left = stage(spark, docs, DATA)
        if name != "sharding":
            assert left.columns == docs.columns and {r["size"] for r in left.collect()} <= {"mine"}
        else:
            assert left.count() == len(rows)
