"""Collection, search, context, answering."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep import plans
from newsprep.functions.prompts import ABOUT, CLOSE, HISTORY, INSTRUCTION, NEWS, OPEN, QUESTION
from newsprep.operators.history import AI, HUMAN
from newsprep.session import kept, materialize, removed, work_dir
from newsprep.sources import (
    append_log, compact, ensure_collection, prompt_log, read_collection, read_log, read_rejects, upsert, vacuum, write_answers,
)

from .common import (
    NEWS_SQL, chunks_sql, latest_sql, lit, news, query, sql_bucket, sql_clean_ascii, sql_sample, sql_words, table,
)

DIM, WORDS = 384, 64


def dense_points(spark, sf_dir):
    """``embeddings`` as a collection; every vector was made one hour after the one before."""
    number = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        number.alias("chunk_id"), F.col("embedding").alias("vector"),
        F.struct(
            F.timestamp_micros((F.lit(1704067200) + number * 3600) * 1_000_000).alias("created_at"),
            F.concat(F.lit("vector "), number.cast("string")).alias("summary"),
        ).alias("payload"),
    )


def dense_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def dense_sql(k: int, where: str = "true") -> str:
    return f"""v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n,
         label FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, round(list_dot_product(q.e, p.e) / (q.n * p.n), 6) AS score
  FROM v q, v p WHERE {where.replace('vec_id', 'p.vec_id')}),
matches AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
  WHERE rank <= {k})"""


def _ranked(matches):
    return matches.withColumn("rank", F.col("rank").cast("bigint"))


@query("top1_dense_top_k", f"WITH {dense_sql(5)} SELECT query_id, chunk_id, score, rank FROM matches")
def dense_top_k(spark, sf_dir):
    return _ranked(op.search(dense_queries(spark, sf_dir), dense_points(spark, sf_dir), 5))


@query("top1_clusters", f"WITH {dense_sql(5)} SELECT query_id, chunk_id, score, rank FROM matches")
def clusters_top_k(spark, sf_dir):
    """Blocks of points are skipped by the angles to their centres."""
    return _ranked(op.search(dense_queries(spark, sf_dir), dense_points(spark, sf_dir), 5, prune="clusters"))


@query("join1_block_grid", f"WITH {dense_sql(3)} SELECT query_id, chunk_id, score, rank FROM matches")
def block_grid(spark, sf_dir):
    """Chunks of points against blocks of questions, many of both."""
    return _ranked(op.search(
        dense_queries(spark, sf_dir), dense_points(spark, sf_dir), 3, query_block=256, point_block=256
    ))


@query("flt2_recent_only", f"WITH {dense_sql(2, 'vec_id BETWEEN 76 AND 100')} SELECT query_id, chunk_id, score, rank FROM matches")
def recent_only(spark, sf_dir):
    points = dense_points(spark, sf_dir)
    return _ranked(op.search(
        dense_queries(spark, sf_dir), points, 2, since="24 hours", as_of=datetime(2024, 1, 5, 4)
    ))


@query("agg1_context", f"""WITH {dense_sql(3)}
SELECT query_id, string_agg('vector ' || chunk_id || chr(10), '' ORDER BY rank) AS context FROM matches GROUP BY query_id""")
def context(spark, sf_dir):
    points = dense_points(spark, sf_dir)
    queries = dense_queries(spark, sf_dir)
    matches = op.with_payload(op.search(queries, points, 3), points, "summary")
    return op.context(matches, queries.select("query_id"))


def sparse_sql(k: int) -> str:
    """Brute force over the chunks of the documents with the benchmark texts as questions."""
    return f"""{NEWS_SQL}, {chunks_sql(WORDS)}, {latest_sql()},
asked AS (SELECT item_id, {sql_clean_ascii('text')} AS text FROM benchmark),
pw AS (SELECT chunk_id, {sql_bucket('w', DIM)} AS bucket, count(*) AS n
       FROM (SELECT chunk_id, unnest({sql_words('chunk')}) AS w FROM points) GROUP BY ALL),
qw AS (SELECT item_id, {sql_bucket('w', DIM)} AS bucket, count(*) AS n
       FROM (SELECT item_id, unnest({sql_words('text')}) AS w FROM asked) GROUP BY ALL),
pn AS (SELECT chunk_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM pw GROUP BY chunk_id),
qn AS (SELECT item_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM qw GROUP BY item_id),
dots AS (SELECT item_id, chunk_id, CAST(sum(pw.n * qw.n) AS DOUBLE) AS dot FROM pw JOIN qw USING (bucket) GROUP BY ALL),
matches AS (
  SELECT item_id AS query_id, chunk_id, score, rank FROM (
    SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank
    FROM (SELECT item_id, chunk_id, round(dot / (pn.norm * qn.norm), 6) AS score
          FROM dots JOIN pn USING (chunk_id) JOIN qn USING (item_id)))
  WHERE rank <= {k})"""


def questions(spark, sf_dir):
    number = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        number.alias("query_id"), (number % 100).alias("conv_id"),
        F.concat(F.lit("Reader "), number.cast("string")).alias("about_me"), F.col("text").alias("question"),
    )


def points(spark, sf_dir):
    """Checkpointed, because a search reads its points twice: vectors to score, payloads of the matches."""
    return materialize(plans.news_points(news(spark, sf_dir), dim=DIM, max_tokens=WORDS))


@query("top1_sparse_top_k", f"WITH {sparse_sql(3)} SELECT query_id, chunk_id, score, rank FROM matches")
def sparse_top_k(spark, sf_dir):
    return _ranked(op.search(plans.question_vectors(questions(spark, sf_dir), dim=DIM), points(spark, sf_dir), 3))


@query("top1_impacts", f"WITH {sparse_sql(3)} SELECT query_id, chunk_id, score, rank FROM matches")
def impacts_top_k(spark, sf_dir):
    """Blocks of word counts are skipped by the greatest weight of every bucket."""
    asked = plans.question_vectors(questions(spark, sf_dir), dim=DIM)
    return _ranked(op.search(asked, points(spark, sf_dir), 3, prune="impacts"))


CONTEXT_SQL = """contexts AS (
  SELECT query_id, string_agg(coalesce(summary, '') || chr(10), '' ORDER BY rank) AS context
  FROM matches JOIN points USING (chunk_id) GROUP BY query_id)"""


def prompt_sql(history: str | None = None, instruction: str = INSTRUCTION) -> str:
    middle = f" || {lit(HISTORY)} || {history}" if history else ""
    return (
        f"{lit(OPEN + instruction + ABOUT)} || {sql_sample('about_me')} || {lit(NEWS)} || {sql_sample('context')}"
        f"{middle} || {lit(QUESTION)} || {sql_sample('question')} || {lit(CLOSE)}"
    )


@query("flagship_prompts", f"""WITH {sparse_sql(3)}, {CONTEXT_SQL}
SELECT query_id, length(context) AS context_chars, md5({prompt_sql()}) AS prompt_md5
FROM (SELECT item_id AS query_id, 'Reader ' || item_id AS about_me, text AS question, coalesce(context, '') AS context
      FROM benchmark LEFT JOIN contexts ON query_id = item_id)""")
def flagship(spark, sf_dir):
    """Documents to a collection of chunks, questions to prompts with their best context."""
    asked = plans.retrieve(questions(spark, sf_dir), points(spark, sf_dir), 3, dim=DIM)
    built = plans.prompts(asked.withColumn("context_chars", F.length("context").cast("bigint")))
    return built.select("query_id", "context_chars", F.md5("prompt").alias("prompt_md5"))


def count_reply():
    """A stand-in generator that repeats the prompt, as a causal model does, and adds a count."""
    return lambda prompts: [f"{p} -> {len(p)} characters" for p in prompts]


HISTORY_SQL = f"""turns AS (
  SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM turns WHERE role = 'user' AND next_role = 'assistant'),
histories AS (
  SELECT conv_id, string_agg({lit(HUMAN)} || text || chr(10) || {lit(AI)} || next_text, chr(10) ORDER BY turn) AS chat_history,
         count(*) AS n_pairs
  FROM pairs WHERE back <= 3 GROUP BY conv_id)"""


@query("win1_history", f"WITH {HISTORY_SQL} SELECT conv_id, n_pairs, md5(chat_history) AS history_md5 FROM histories")
def history(spark, sf_dir):
    built = op.history(table(spark, sf_dir, "conversations"), 3)
    return built.select("conv_id", F.size("pairs").cast("bigint").alias("n_pairs"), F.md5("chat_history").alias("history_md5"))


@query("win1_history_segmented", f"WITH {HISTORY_SQL} SELECT conv_id, n_pairs, md5(chat_history) AS history_md5 FROM histories")
def history_segmented(spark, sf_dir):
    """The way taken for long conversations, with segments of two turns."""
    built = op.history(table(spark, sf_dir, "conversations"), 3, width=2)
    return built.select("conv_id", F.size("pairs").cast("bigint").alias("n_pairs"), F.md5("chat_history").alias("history_md5"))


@query("udf5_answer_all", f"""WITH {sparse_sql(1)}, {CONTEXT_SQL}, {HISTORY_SQL},
asked_all AS (
  SELECT item_id AS query_id, 'Reader ' || item_id AS about_me, text AS question, coalesce(context, '') AS context,
         coalesce(chat_history, '') AS chat_history
  FROM benchmark LEFT JOIN contexts ON query_id = item_id LEFT JOIN histories ON conv_id = item_id % 100),
prompted AS (SELECT query_id, {prompt_sql(sql_sample('chat_history'))} AS prompt FROM asked_all)
SELECT query_id, md5(prompt) AS prompt_md5, ' -> ' || length(prompt) || ' characters' AS answer FROM prompted""")
def answer_all(spark, sf_dir):
    answers = plans.answer_all(
        questions(spark, sf_dir), points(spark, sf_dir), count_reply, table(spark, sf_dir, "conversations"),
        k=1, include_history=True, dim=DIM,
    )
    return answers.select("query_id", F.md5("prompt").alias("prompt_md5"), "answer")


HOUSE = "Answer in one sentence."


@query("udf5_logged", f"""WITH {sparse_sql(1)}, {CONTEXT_SQL},
asked_all AS (
  SELECT item_id AS query_id, 'Reader ' || item_id AS about_me, text AS question, coalesce(context, '') AS context
  FROM benchmark LEFT JOIN contexts ON query_id = item_id),
prompted AS (SELECT {prompt_sql(instruction=HOUSE)} AS prompt FROM asked_all)
SELECT 'bulk' AS project, 'stub' AS model, 'night' AS run_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars,
       ' -> ' || length(prompt) || ' characters' AS output FROM prompted""")
def logged(spark, sf_dir):
    """A bulk run under an instruction of its own, run twice: its log holds every answer once."""
    path, stored = work_dir(spark, "run-log"), points(spark, sf_dir)
    for _ in range(2):
        plans.answer_all(
            questions(spark, sf_dir), stored, count_reply, k=1, dim=DIM, instruction=HOUSE, log_path=path, run_id="night", project="bulk", model="stub"
        )
    return read_log(spark, path).select("project", "model", "run_id", F.md5("prompt").alias("prompt_md5"), "prompt_chars", "output")


LOG_SQL = """logged AS (
  SELECT 'demo' AS project, text AS prompt, ' -> ' || length(text) || ' characters' AS output FROM documents)"""


def _generated(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("text").alias("prompt"), F.struct("source", "n_chars").alias("payload")
    )
    return op.generate(documents, count_reply)


@query("udf2_generate", """
SELECT doc_id, ' -> ' || length(text) || ' characters' AS answer, false AS failed FROM documents""")
def generate(spark, sf_dir):
    return _generated(spark, sf_dir).select("doc_id", "answer", F.col("error").isNotNull().alias("failed"))


@query("dt4_duration", "SELECT doc_id, true AS timed FROM documents")
def duration(spark, sf_dir):
    return _generated(spark, sf_dir).select("doc_id", (F.col("duration_ms") >= 0).alias("timed"))


@query("snk4_prompt_log", f"""WITH {LOG_SQL}
SELECT project, md5(prompt) AS prompt_md5, output, length(prompt) AS prompt_chars,
       length(prompt) + length(output) AS total_chars, length(output) AS actual_new_chars FROM logged""")
def log(spark, sf_dir):
    """Written as a partitioned table and read back."""
    path = work_dir(spark, "prompt-log")
    append_log(prompt_log(_generated(spark, sf_dir), "demo", "stub"), path)
    return spark.read.parquet(path).select(
        "project", F.md5("prompt").alias("prompt_md5"), "output", "prompt_chars", "total_chars", "actual_new_chars"
    )


@query("snk5_write_answers", """
SELECT md5(text) AS prompt_md5, ' -> ' || length(text) || ' characters' AS answer FROM documents""")
def answers_file(spark, sf_dir):
    path = work_dir(spark, "answers")
    write_answers(_generated(spark, sf_dir), path)
    read = spark.read.schema("prompt string, answer string").json(path)
    return read.select(F.md5("prompt").alias("prompt_md5"), "answer")


@query("agg4_usage", f"""WITH {LOG_SQL}
SELECT 'demo' AS project, 'stub' AS model, count(*) AS calls, CAST(sum(length(prompt)) AS BIGINT) AS prompt_chars,
       CAST(sum(length(prompt) + length(output)) AS BIGINT) AS total_chars,
       CAST(sum(length(output)) AS BIGINT) AS actual_new_chars FROM logged""")
def usage(spark, sf_dir):
    return op.usage(prompt_log(_generated(spark, sf_dir), "demo", "stub"))


@query("flt4_log_if_metadata", """
SELECT doc_id FROM documents JOIN labels USING (doc_id)""")
def log_if_metadata(spark, sf_dir):
    """Documents with a label carry metadata, the others do not."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic").alias("metadata"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return op.loggable(joined).select("doc_id")


def _written(spark, sf_dir):
    """A collection written in two batches of which the first is written twice, then the second compacted.

    What nothing reads any more goes: chunks, points, and the files of a batch that was folded in.
    """
    path = work_dir(spark, "collection")
    ensure_collection(spark, path, DIM)
    chunks, folder = work_dir(spark, "chunks"), work_dir(spark, "points")
    made = kept(plans.news_points(news(spark, sf_dir), dim=DIM, max_tokens=WORDS, folder=chunks).drop("chunk"), folder)
    removed(chunks)
    older = F.col("article_id") % 2 == 0
    upsert(made.where(older), path, "a", 0)
    upsert(made.where(older), path, "a", 0)
    compact(spark, path)
    vacuum(spark, path, grace=timedelta(0))  # nobody else reads it
    upsert(made, path, "b", 0)
    removed(folder)
    return path


POINTS_SQL = f"WITH {NEWS_SQL}, {chunks_sql(WORDS)}, {latest_sql()}"


@query("snk3_upsert_latest", f"""{POINTS_SQL}
SELECT chunk_id, id AS article_id, part, pos, md5(summary) AS summary_md5, len({sql_words('chunk')}) AS words FROM points""")
def upsert_latest(spark, sf_dir):
    stored = read_collection(spark, _written(spark, sf_dir))
    return stored.select(
        "chunk_id", "article_id", F.col("part").cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos"),
        F.md5("payload.summary").alias("summary_md5"),
        F.aggregate("vector", F.lit(0.0), lambda t, x: t + x).cast("bigint").alias("words"),
    )


@query("snk3_compact", f"{POINTS_SQL} SELECT chunk_id, id AS article_id FROM points")
def compacted(spark, sf_dir):
    path = _written(spark, sf_dir)
    compact(spark, path)
    return read_collection(spark, path).select("chunk_id", "article_id")


def _every_chunk(spark, sf_dir):
    """All chunks, equal ones too, so that batches hide each other's rows."""
    return plans.news_points(news(spark, sf_dir), dim=DIM, max_tokens=WORDS, dedup=False)


def _placed(df):
    return df.select("chunk_id", "article_id", F.col("part").cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos"))


@query("snk3_rewrite_after_compact", f"""WITH {NEWS_SQL}, {chunks_sql(WORDS)}, kept AS (SELECT * FROM chunks WHERE id % 4 <> 2), {latest_sql('kept')}
SELECT chunk_id, id AS article_id, part, pos FROM points""")
def rewrite_after_compact(spark, sf_dir):
    """A batch that was folded in is written again with half of its rows; what they hid comes back."""
    path = work_dir(spark, "collection")
    ensure_collection(spark, path, DIM)
    made = materialize(_every_chunk(spark, sf_dir))
    upsert(made.where(F.col("article_id") % 2 == 0), path, "a", 0)
    upsert(made.where(F.col("article_id") % 2 == 1), path, "a", 1)
    compact(spark, path)
    upsert(made.where(F.col("article_id") % 4 == 0), path, "a", 0)
    return _placed(read_collection(spark, path))


@query("snk3_late_batch", f"{POINTS_SQL} SELECT chunk_id, id AS article_id, part, pos FROM points")
def late_batch(spark, sf_dir):
    """Batches arrive in the wrong order, with compactions between them."""
    path = work_dir(spark, "collection")
    ensure_collection(spark, path, DIM)
    made = _every_chunk(spark, sf_dir)  # not kept: a batch computes the chunks of its own articles
    for batch in (2, 0, 1):
        upsert(made.where(F.col("article_id") % 3 == batch), path, "a", batch)
        compact(spark, path)
    return _placed(read_collection(spark, path))


@query("flt1_collection_range", f"""{POINTS_SQL}
SELECT chunk_id, id AS article_id, part, pos FROM points WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00' AND created_at < TIMESTAMP '2024-01-01 02:00:00'""")
def collection_range(spark, sf_dir):
    """One hour of the collection, by the time bounds of its files; a second batch is not folded in."""
    path = work_dir(spark, "collection")
    ensure_collection(spark, path, DIM)
    made = materialize(_every_chunk(spark, sf_dir))
    upsert(made.where(F.col("article_id") % 5 > 0), path, "a", 0)
    compact(spark, path)
    upsert(made.where(F.col("article_id") % 5 == 0), path, "a", 1)
    return _placed(read_collection(spark, path, datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2)))


@query("snk2_reject_wrong_size", """
SELECT vec_id AS article_id, 'wrong vector size' AS error FROM embeddings WHERE label % 2 = 0""")
def reject_wrong_size(spark, sf_dir):
    """Vectors cut short do not fit a collection of 64 dimensions."""
    path = work_dir(spark, "collection")
    ensure_collection(spark, path, 64)
    vectors = table(spark, sf_dir, "embeddings")
    made = vectors.select(
        F.md5(F.col("vec_id").cast("string")).alias("chunk_id"),
        F.when(F.col("label") % 2 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"),
        F.lit(None).cast("struct<headline string, summary string, url string, symbols array<string>, author string, "
                         "created_at timestamp, text string>").alias("payload"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.col("vec_id").alias("article_id"),
        F.lit(0).alias("part"), F.lit(0).alias("pos"),
    )
    upsert(made, path, "a", 0)
    return read_rejects(spark, path).select("article_id", "error")
