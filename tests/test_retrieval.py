"""Encoding, search, context, history, answering."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep import plans


def brute(queries, points, k):
    out = []
    for qid, q in queries:
        scored = []
        for pid, p in points:
            a, b = np.array(q, dtype=np.float64), np.array(p, dtype=np.float64)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b / n), 6) if n else 0.0, pid))
        out += [(qid, pid, -s or 0.0, r) for r, (s, pid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frame(spark, rows, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} string, vector array<float>").repartition(5)


def random_rows(seed, n, prefix, dim=8):
    rng = np.random.default_rng(seed)
    return [(f"{prefix}{i:04d}", np.round(rng.normal(size=dim), 3)) for i in range(n)]


def got(df):
    return sorted((r["query_id"], r["chunk_id"], r["score"] or 0.0, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4, 1000])
@pytest.mark.parametrize("blocks", [{}, {"query_block": 7, "point_block": 50}])
def test_search_equals_brute_force(spark, k, blocks):
    queries, points = random_rows(1, 20, "q"), random_rows(2, 200, "p")
    found = op.search(frame(spark, queries, "query_id"), frame(spark, points, "chunk_id"), k, **blocks)
    for a, b in zip(got(found), brute(queries, points, k), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 2e-6


@pytest.mark.parametrize("blocks", [{}, {"query_block": 5, "point_block": 64}])
def test_a_third_of_all_points_tied(spark, blocks):
    """Equal vectors under many ids tie; the smallest ids win, and none is lost."""
    rows = random_rows(3, 200, "p")
    rows += [(f"c{i:04d}", np.arange(8)) for i in range(100)]
    queries = [(f"q{i}", np.arange(8)) for i in range(12)]
    found = op.search(frame(spark, queries, "query_id"), frame(spark, rows, "chunk_id"), 5, **blocks)
    for qid, _ in queries:
        assert [r[1] for r in got(found) if r[0] == qid] == [f"c{i:04d}" for i in range(5)]


def test_zero_vectors_and_empty_sides(spark):
    points = [("a", [0, 0]), ("b", [1, 0]), ("c", [-1, 0])]
    found = op.search(frame(spark, [("q", [1, 0]), ("z", [0, 0])], "query_id"), frame(spark, points, "chunk_id"), 3)
    assert got(found) == [("q", "a", 0.0, 2), ("q", "b", 1.0, 1), ("q", "c", -1.0, 3),
                          ("z", "a", 0.0, 1), ("z", "b", 0.0, 2), ("z", "c", 0.0, 3)]
    none = frame(spark, [("x", [1, 0])], "chunk_id").where("chunk_id = 'y'")
    assert op.search(frame(spark, points, "query_id"), none, 2).count() == 0
    assert op.search(none.withColumnRenamed("chunk_id", "query_id"), frame(spark, points, "chunk_id"), 2).count() == 0


def test_top_k_is_a_prefix_of_top_k_plus_one(spark):
    queries, points = frame(spark, random_rows(4, 10, "q"), "query_id"), frame(spark, random_rows(5, 60, "p"), "chunk_id")
    less, more = got(op.search(queries, points, 3)), got(op.search(queries, points, 4))
    assert less == [r for r in more if r[3] <= 3]


def test_search_plan_has_no_cross_join_and_prunes_before_the_shuffle(spark, plan):
    queries, points = frame(spark, random_rows(1, 20, "q"), "query_id"), frame(spark, random_rows(2, 200, "p"), "chunk_id")
    for blocks in ({}, {"query_block": 7, "point_block": 50}):
        text = plan(op.search(queries, points, 2, **blocks))
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "row_number(), 2, Partial" in text


def test_since(spark):
    points = frame(spark, [("old", [1, 0]), ("new", [0, 1])], "chunk_id").withColumn(
        "payload", F.struct(F.when(F.col("chunk_id") == "new", F.lit(datetime(2024, 1, 2))).otherwise(F.lit(datetime(2023, 1, 1))).alias("created_at")))
    found = op.search(frame(spark, [("q", [1, 0])], "query_id"), points, 5, since="24 hours", as_of=datetime(2024, 1, 2, 12))
    assert [r[1] for r in got(found)] == ["new"]


def test_context(spark):
    matches = spark.createDataFrame([("a", 2, "two", "t2"), ("a", 1, "one", "t1"), ("b", 1, None, "t")], "query_id string, rank int, summary string, text string")
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    assert {r["query_id"]: r["context"] for r in op.context(matches, queries).collect()} == {"a": "one\ntwo\n", "b": "\n", "c": ""}
    assert op.context(matches, queries, "text").where("query_id = 'a'").first()["context"] == "t1\nt2\n"


def make_lengths():
    def predict(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no bad texts")
        return np.array([[len(t), 1.0] for t in texts])

    return predict


def test_embed_isolates_failures(spark):
    df = spark.createDataFrame([("abc",), ("bad",), ("",), (None,)], "chunk string").coalesce(1)
    good, failed = op.split_failures(op.embed(df, make_lengths, batch_size=3), 2)
    assert sorted(r["vector"] for r in good.collect()) == [[0.0, 1.0], [3.0, 1.0]]
    rows = {r["chunk"]: (r["vector"], r["error"]) for r in failed.collect()}
    assert rows == {"bad": ([], "ValueError: no bad texts"), None: (None, "no text")}


def test_one_bad_text_costs_few_calls():
    from newsprep.operators.encode import _predict_rows

    calls = []

    def predict(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0]] * len(texts)

    rows = _predict_rows(predict, ["x"] * 100 + ["bad"] + ["x"] * 155)
    assert sum(r["error"] is not None for r in rows) == 1 and len(rows) == 256 and len(calls) == 17
    assert all(r["error"] for r in _predict_rows(lambda texts: [], ["a", "b"]))


def plain_history(turns, k):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = sorted(t for t in turns if t[0] == conv)
        found = [(a[3], b[3]) for a, b in zip(rows, rows[1:]) if a[2] == "user" and b[2] == "assistant"]
        if found:
            out[conv] = found[-k:]
    return out


def history_of(spark, turns, k, **options):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    return {r["conv_id"]: [(p["question"], p["answer"]) for p in r["pairs"]] for r in op.history(df, k, **options).collect()}


def test_history_edges(spark):
    u, a, s = "user", "assistant", "system"
    turns = [
        (1, 0, s, "s"), (1, 1, u, "q1"), (1, 2, a, "a1"), (1, 3, u, "open"),
        (2, 0, u, "q"), (3, 0, a, "a"), (3, 1, u, "q"),
        (4, 0, u, "q0"), (4, 1, s, "s"), (4, 2, a, "a"),
        *[(5, i, u if i % 2 == 0 else a, f"t{i}") for i in range(10)],
    ]
    assert history_of(spark, turns, 3) == plain_history(turns, 3) == {
        1: [("q1", "a1")], 5: [("t4", "t5"), ("t6", "t7"), ("t8", "t9")]}


@pytest.mark.parametrize("width", [2, 3, 10, 4096])
def test_one_conversation_with_most_turns(spark, width):
    """Gaps, system turns and repeated roles, cut into segments of any width."""
    rng = np.random.default_rng(width)
    turns = []
    for conv, n in ((1, 400), (2, 30), (3, 1)):
        for turn in sorted(rng.choice(n * 3, n, replace=False).tolist()):
            turns.append((conv, turn, ["user", "assistant", "system"][rng.choice(3, p=[.45, .45, .1])], f"{conv}-{turn}"))
    assert history_of(spark, turns, 1000, width=width) == plain_history(turns, 1000)
    assert history_of(spark, turns, 3, width=width) == plain_history(turns, 3)


def test_short_conversations_take_one_shuffle(spark, plan):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert plan(op.history(df, 3)).count("Exchange hashpartitioning") == 1


def make_echo():
    return lambda prompts: [p + " echoed" for p in prompts]


def test_answer_all(spark):
    news = spark.createDataFrame(
        [(1, "Rates", "Rates rise", "a", datetime(2024, 1, 1), datetime(2024, 1, 1), None, "<p>the bank lifts rates</p>", ["B"], "s"),
         (2, "Oil", "Oil falls", "a", datetime(2024, 1, 1), datetime(2024, 1, 1), None, "<p>oil price falls today</p>", ["O"], "s")],
        "id long, headline string, summary string, author string, created_at timestamp, updated_at timestamp, url string, content string, symbols array<string>, source string")
    questions = spark.createDataFrame([("q1", 1, "me", "bank rates?  the bank lifts rates"), ("q2", 2, "me", "oil price falls today")], "query_id string, conv_id long, about_me string, question string")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello")], "conv_id long, turn long, role string, text string")
    answers = {r["query_id"]: r for r in plans.answer_all(questions, plans.news_points(news, dim=64), make_echo, turns, dim=64, include_history=True).collect()}
    assert "### LATEST NEWS: Rates rise\n" in answers["q1"]["prompt"] and "Human: hi AI: hello" in answers["q1"]["prompt"]
    assert "### LATEST NEWS: Oil falls\n" in answers["q2"]["prompt"]
    assert answers["q1"]["answer"] == " echoed" and answers["q1"]["duration_ms"] >= 0 and answers["q1"]["error"] is None
    assert answers["q1"]["payload"]["question"] == "bank rates? the bank lifts rates"


def grouped_rows(seed, n, prefix, dim=24, groups=30):
    """Unit-length directions in tight groups, as encoders make them."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dim))
    return [(f"{prefix}{i:04d}", np.round(centres[rng.integers(groups)] + 0.05 * rng.normal(size=dim), 3)) for i in range(n)]


def word_rows(seed, n, prefix, dim=64):
    """Word counts: most buckets empty, one on every row."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        row = np.bincount(rng.choice(dim, 6, p=np.arange(1, dim + 1)[::-1] / (dim * (dim + 1) / 2)), minlength=dim)
        row[0] += 1
        out.append((f"{prefix}{i:04d}", row))
    return out


@pytest.mark.parametrize("prune, rows", [("clusters", grouped_rows), ("impacts", word_rows), ("clusters", random_rows), ("impacts", random_rows)])
@pytest.mark.parametrize("k, blocks", [(1, {}), (3, {"query_block": 7, "point_block": 150})])
def test_pruned_search_is_exact(spark, prune, rows, k, blocks):
    queries, points = rows(1, 25, "q"), rows(2, 700, "p")
    width = len(points[0][1])
    points += [("zero", np.zeros(width)), ("again", points[5][1]), ("same", points[5][1])]
    queries += [("nought", np.zeros(width)), ("twin", points[5][1])]
    found = got(op.search(frame(spark, queries, "query_id"), frame(spark, points, "chunk_id"), k, prune=prune, **blocks))
    plain = got(op.search(frame(spark, queries, "query_id"), frame(spark, points, "chunk_id"), k))
    assert found == plain and len(found) == k * len(queries)


def test_pruning_skips_most_blocks_of_grouped_points(spark):
    queries, points = frame(spark, grouped_rows(1, 40, "q"), "query_id"), frame(spark, grouped_rows(2, 3000, "p"), "chunk_id")
    matches, report = op.search_report(queries, points, 3, "clusters")
    assert got(matches) == got(op.search(queries, points, 3))
    row = report.first()
    assert row["skipped"] > 0.6 * row["pairs"] > 0
    none, report = op.search_report(queries, points.limit(0), 3, "clusters")
    assert none.count() == 0 and report.first()["pairs"] == 0


def test_bounds_hold():
    from newsprep.operators.pruning import METHODS
    from newsprep.operators.search import scores

    rng = np.random.default_rng(8)
    for name in METHODS:
        vectors, queries = np.concatenate((rng.normal(size=(300, 6)), np.zeros((2, 6)))), np.concatenate((rng.normal(size=(20, 6)), np.zeros((1, 6))))
        blocks = METHODS[name](vectors)
        bounds = blocks.bounds(queries)
        assert sorted(np.concatenate(blocks.members).tolist()) == list(range(302))
        for b, members in enumerate(blocks.members):
            assert (scores(vectors[members], queries).max(axis=0) <= bounds[:, b] + 1e-6).all()


def test_questions_are_encoded_once(spark, tmp_path):
    """However many tasks and blocks there are, each question goes to the encoder once."""
    folder = str(tmp_path)

    def make():
        import uuid

        def predict(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return predict

    asked = spark.createDataFrame([(f"q{i}", "x" * i) for i in range(1, 30)], "query_id string, question string").repartition(3)
    points = frame(spark, [(f"p{i}", [i, 1]) for i in range(40)], "chunk_id")
    found = op.search(plans.question_vectors(asked, make, 2), points, 2, query_block=4, point_block=10)
    assert found.count() == 58
    seen = [t for f in tmp_path.iterdir() for t in f.read_text().split("\n")]
    assert sorted(map(len, seen)) == list(range(1, 30))


def test_a_logged_run_is_replaced_as_a_whole(spark, tmp_path):
    from newsprep.sources import append_log, prompt_log, read_log

    def answers(*texts):
        rows = [(f"p {t}", t, None, 1.0) for t in texts]
        return spark.createDataFrame(rows, "prompt string, answer string, payload string, duration_ms double")

    path = f"{tmp_path}/log"
    assert read_log(spark, path).collect() == []
    for texts in (("a", "b", None), ("a", "c")):
        append_log(prompt_log(answers(*texts), "p", "m"), path, "one")
    append_log(prompt_log(answers("d"), "p", "m"), path, "two")
    append_log(prompt_log(answers("e"), "p", "m"), path, "two", 1)
    assert sorted((r["run_id"], r["output"]) for r in read_log(spark, path).collect()) == [("one", "a"), ("one", "c"), ("two", "d"), ("two", "e")]
    fail = F.udf(lambda x: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        append_log(prompt_log(answers("x").withColumn("answer", fail("answer").cast("string")), "p", "m"), path, "one")
    assert read_log(spark, path).count() == 4


def test_answers_are_generated_once_and_logged(spark, tmp_path):
    from newsprep.sources import read_log

    folder = str(tmp_path / "calls")
    (tmp_path / "calls").mkdir()

    def make():
        import uuid

        def run(prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join("call" for _ in prompts))
            return [p + " yes" for p in prompts]

        return run

    asked = spark.createDataFrame([(f"q{i}", "me", f"word{i}") for i in range(6)], "query_id string, about_me string, question string")
    stored = spark.createDataFrame([("c", [1.0] * 16, ("s",))], "chunk_id string, vector array<float>, payload struct<summary: string>")
    done = plans.answer_all(asked, stored, make, dim=16, instruction="Be brief.", log_path=f"{tmp_path}/log", run_id="r", project="p", model="m")
    assert done.count() == 6 and all(r["prompt"].startswith("[INST] Be brief.") for r in done.collect())
    log = read_log(spark, f"{tmp_path}/log").collect()
    assert {r["output"] for r in log} == {" yes"} and len(log) == 6
    assert sum(len(f.read_text().split()) for f in (tmp_path / "calls").iterdir()) == 6


def test_with_state_runs_the_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        def predict(texts):
            if "bad" in texts:
                raise ValueError("no")
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return [[1.0, 2.0]] * len(texts)

        return predict

    df = spark.createDataFrame([("a",), ("bad",), ("b",), (None,)], "chunk string")
    rows = op.with_state(op.embed(df, make), 2)
    assert rows.where("state = 'ok'").count() == 2 and rows.where("state = 'failed'").count() == 2
    assert sorted(t for f in tmp_path.iterdir() for t in f.read_text().split("\n")) == ["a", "b"]


@pytest.mark.parametrize("prune", [None, "clusters", "impacts"])
def test_near_ties_are_told_apart_in_double_precision(spark, prune):
    """Scores that single precision cannot order, beside many equal vectors; the grid of products does not matter."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=16)
    points = [(f"p{i:04d}", base + 2e-4 * rng.normal(size=16)) for i in range(600)] + [(f"e{i:04d}", base) for i in range(300)]
    points += [("nan", np.full(16, np.nan))]
    queries = [(f"q{i}", base + 1e-3 * i * rng.normal(size=16)) for i in range(6)]
    asked, stored = frame(spark, queries, "query_id"), frame(spark, points, "chunk_id").coalesce(1)
    p = np.array([v for _, v in points[:-1]], np.float32).astype(np.float64)
    q = np.array([v for _, v in queries], np.float32).astype(np.float64)
    exact = np.floor(q @ p.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)) * 1e6 + 0.5) / 1e6
    expected = sorted(
        (queries[i][0], points[j][0], exact[i, j], rank)
        for i in range(len(q)) for rank, j in enumerate(sorted(range(len(p)), key=lambda j: (-exact[i, j], points[j][0]))[:4], 1)
    )
    for blocks in ({}, {"query_block": 2, "point_block": 32}):
        assert got(op.search(asked, stored, 4, prune=prune, **blocks)) == expected


def test_a_task_returns_k_rows_of_a_question_whatever_the_blocks(spark):
    """Small blocks bound a product, not what a task compares: they used to give k rows for each of them."""
    queries, points = frame(spark, random_rows(1, 20, "q"), "query_id"), frame(spark, random_rows(2, 200, "p"), "chunk_id").coalesce(1)
    from newsprep.operators.search import _found

    found = _found(queries.select("query_id", "vector"), points.select("chunk_id", "vector"), 3, 5, 16, None)
    assert found.count() == 60
