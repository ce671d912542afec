"""Question-answer sets, splits, packing, generation, logs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep import plans
from newsprep.schemas import QA_SCHEMA
from newsprep.sources import append_log, prompt_log, read_json, read_qa, write_answers, write_json

RAW = [
    {"about_me": "I am\n40", "context": "c  1", "question": "q1", "response": "\nr1"},
    {"about_me": "x", "context": "c2", "question": "q2", "response": "r2", "chat_history": "h"},
]


def test_array_file_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RAW, indent=4))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in RAW))
    for name, array_file in (("a", True), ("l", False)):
        assert read_json(spark, f"{tmp_path}/{name}.json", QA_SCHEMA, array_file).count() == 2
        samples = {r["question"]: r for r in read_qa(spark, f"{tmp_path}/{name}.json", "training", array_file).collect()}
        assert samples["q1"]["chat_history"] == "" and samples["q2"]["chat_history"] == "h" and samples["q2"]["answer"] == "r2"
    assert {r["answer"] for r in read_qa(spark, f"{tmp_path}/a.json", "inference").collect()} == {""}
    with pytest.raises(ValueError):
        read_qa(spark, f"{tmp_path}/a.json", "other")


def test_write_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, x string")
    write_json(df, f"{tmp_path}/out")
    back = read_json(spark, f"{tmp_path}/out", df.schema, array_file=False)
    assert sorted(back.collect(), key=lambda r: r["id"]) == df.collect()


def test_prompt_table_cleans_and_keeps_two_columns(spark):
    raw = spark.createDataFrame([(r["about_me"], r["context"], r["question"], r["response"], r.get("chat_history")) for r in RAW], QA_SCHEMA)
    table = plans.prompt_table(raw)
    assert table.columns == ["prompt", "payload"]
    first = table.where("payload.question = 'q1'").first()
    assert "### ABOUT ME: I am 40\n\n### LATEST NEWS: c 1\n" in first["prompt"]
    assert first["prompt"].endswith("### RESPONSE: r1 </s>") and first["payload"]["answer"] == "r1"
    asked = plans.prompt_table(raw, "inference").first()["prompt"]
    assert asked.endswith("[/INST]")


@pytest.mark.parametrize("about, rest, question", [("me\nwhy?", "me", "why?"), ("why?", "", "why?"), ("me\nwhy?\n", "me\nwhy?", "")])
def test_split_question(spark, about, rest, question):
    row = op.split_question(spark.createDataFrame([(about,)], "about_me string")).first()
    assert (row["about_me"], row["question"]) == (rest, question)


def make_teacher():
    return lambda prompts: [p.split("# CONTEXT\n")[1].split("\n")[0].upper() for p in prompts]


def test_build_examples_prompts_before_the_split(spark):
    queries = spark.createDataFrame([("me\nwhy?", "rates up")], "about_me string, context string")
    row = plans.build_examples(queries, make_teacher).first()
    assert (row["about_me"], row["question"], row["context"], row["response"]) == ("me", "why?", "rates up", "RATES UP")


@pytest.mark.parametrize("n", [0, 1, 82, 99, 100, 500])
def test_split_first_n(spark, n):
    df = spark.createDataFrame([(i, (i * 37) % 100) for i in range(100)], "id int, place int").repartition(7)
    train, test = op.split_first_n(df, n, ["place"])
    assert sorted(r["place"] for r in train.collect()) == list(range(min(n, 100)))
    assert sorted(r["place"] for r in test.collect()) == list(range(min(n, 100), 100))


def test_small_split_moves_no_rows(spark, plan):
    df = spark.range(1000).selectExpr("id", "id * 2 as v")
    _, test = op.split_first_n(df, 82, ["id"])
    main = plan(test).split("Subquery")[0]
    assert "Exchange" not in main


def test_hash_split(spark):
    df = spark.range(4000).selectExpr("cast(id as string) as key")
    train, test = op.split_by_hash(df, "key", 0.75)
    assert train.count() + test.count() == 4000 and 2850 < train.count() < 3150
    assert train.intersect(test).count() == 0


def test_hash_split_of_small_fractions(spark):
    df = spark.range(200_000).selectExpr("cast(id as string) as key")
    for fraction in (0.00005, 0.99995):
        train, test = op.split_by_hash(df, "key", fraction)
        n = train.count()
        assert abs(n - fraction * 200_000) < 25 and n + test.count() == 200_000 and 0 < n < 200_000


def test_running_total(spark):
    values = np.random.default_rng(0).integers(0, 9, 500).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(6)
    rows = {r["id"]: r["before"] for r in op.running_total(df, ["id"], F.col("v")).collect()}
    assert rows == {i: sum(values[:i]) for i in range(500)}


def plain_pack(samples, length, separator):
    out, at = set(), 0
    for i, tokens in samples:
        n = tokens + separator
        for seq in range(at // length, -(-(at + n) // length)) if n else ():
            out.add((seq, i, max(seq * length - at, 0), min((seq + 1) * length - at, n)))
        at += n
    return out


@pytest.mark.parametrize("length, separator", [(8, 0), (8, 1), (1000, 0)])
def test_pack(spark, length, separator):
    sizes = np.random.default_rng(1).integers(0, 30, 200).tolist() + [0, 8, 100]
    samples = list(enumerate(sizes))
    df = spark.createDataFrame(samples, "sample_id long, tokens long").repartition(5)
    packed = {tuple(r) for r in op.pack(df, length, separator=separator).collect()}
    assert packed == plain_pack(samples, length, separator)
    total = sum(sizes) + separator * len(sizes)
    assert sum(r[3] - r[2] for r in packed) == total


def make_model():
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return [p + "!" for p in prompts]

    return model


def test_generate_isolates_failures(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string").coalesce(1)
    rows = {r["prompt"]: r for r in op.generate(df, make_model).collect()}
    assert rows["a"]["answer"] == "!" and (rows[None]["answer"], rows[None]["error"]) == (None, "no prompt") and rows["a"]["duration_ms"] >= 0
    assert rows["bad"]["answer"] is None and rows["bad"]["error"] == "RuntimeError: refused"
    whole = op.generate(df, make_model, only_new=False).where("prompt = 'a'").first()
    assert whole["answer"] == "a!"


def test_log_and_usage(spark, tmp_path):
    df = spark.createDataFrame([("aaa", "x"), ("bad", "y")], "prompt string, k string").withColumn("payload", F.struct("k"))
    log = prompt_log(op.generate(df, make_model), "demo", "m", "p")
    append_log(log, f"{tmp_path}/log")
    append_log(log, f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    assert stored.count() == 2 and "log_date" in stored.columns
    row = op.usage(stored).first()
    assert (row["project"], row["model"], row["calls"], row["prompt_chars"], row["total_chars"], row["actual_new_chars"]) == ("demo", "m", 2, 6, 8, 2)
    write_answers(op.generate(df, make_model), f"{tmp_path}/answers")
    assert spark.read.schema("prompt string, answer string").json(f"{tmp_path}/answers").count() == 2


def make_words():
    return lambda texts: [len(t.split()) for t in texts]


def test_log_counts_tokens_with_a_tokenizer(spark):
    df = spark.createDataFrame([("a b c", "x")], "prompt string, k string").withColumn("payload", F.struct("k"))
    log = prompt_log(op.generate(df, make_model), "demo", make_count=make_words)
    row = log.first()
    assert (row["prompt_tokens"], row["total_tokens"], row["actual_new_tokens"], row["prompt_chars"]) == (3, 4, 1, 5)
    assert op.usage(log).first()["total_tokens"] == 4


def test_loggable(spark):
    df = spark.createDataFrame([(1, "m"), (2, None)], "id int, metadata string")
    assert [r["id"] for r in op.loggable(df).collect()] == [1] and op.loggable(df, log_prompt=False).count() == 0


def test_perplexity_and_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "g string, nll double")
    assert {r["g"]: round(r["perplexity"], 6) for r in op.perplexity(df, "nll", ["g"]).collect()} == {"a": 7.389056, "b": 1.0}
    counted, seen = op.count_rows(df)
    assert counted.where("g = 'a'").count() == 2 and seen.get["n"] == 3


def test_first_n_by_selection_and_by_ranges(spark, monkeypatch, plan):
    from newsprep.operators import split

    df = spark.createDataFrame([(i * 37 % 501, i) for i in range(501)], "k long, v long").repartition(6)
    for n in (0, 1, 82, 501, 900):
        first, rest = split.split_first_n(df, n, ["k"])
        assert sorted(r["k"] for r in first.collect()) == list(range(min(n, 501))) and rest.count() == 501 - min(n, 501)
    monkeypatch.setattr(split, "SELECTED", 10)
    first, rest = split.split_first_n(df, 82, ["k"])
    assert sorted(r["k"] for r in first.collect()) == list(range(82)) and rest.count() == 419


def test_carried_total(spark, plan):
    """Against a plain loop: negative and null values, many ranges, no row moved but by the ranges."""
    import random

    from newsprep.operators import carried_total

    rng = random.Random(3)
    rows = [(i, rng.randrange(100), rng.choice([None, 0, 3, 7, -2])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, n long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["id"]: (r["sum"], r["n"]) for r in carried_total(df, ["k", "id"], F.col("n"), "sum").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, wanted = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        wanted[i] = (total, n)
        total += n or 0
    assert got == wanted
    assert "Exchange" not in plan(carried_total(df, ["k", "id"], F.lit(1))).replace("BroadcastExchange", "")
    assert carried_total(df.limit(0), ["k", "id"], F.lit(1)).count() == 0
