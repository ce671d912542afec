"""Question-answer sets: samples, prompts, splits, packing, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep import plans
from newsprep.functions.prompts import (
    ABOUT, CLOSE, END, INSTRUCTION, NEWS, OPEN, QUESTION, RESPONSE, TEACHER_ABOUT, TEACHER_CLOSING, TEACHER_CONTEXT,
    TEACHER_INSTRUCTION,
)
from newsprep.schemas import QA_SCHEMA, SAMPLE_FIELDS
from newsprep.session import work_dir
from newsprep.sources import read_json, read_qa, write_json

from .common import QA_SQL, lit, qa_raw, query, sql_bucket, sql_sample, sql_words, table
from .retrieval import count_reply

SAMPLE_SQL = """sample AS (
  SELECT conv_id, turn, about_me AS user_context, context AS news_context, coalesce(chat_history, '') AS chat_history,
         question, response AS answer FROM qa)"""


def _hashes(df, *columns):
    return df.select("conv_id", "turn", *[F.md5(c).alias(f"{c}_md5") for c in columns])


def _sql_hashes(*columns):
    return ", ".join(f"md5({c}) AS {c}_md5" for c in columns)


@query("prj4_training_samples", f"""WITH {QA_SQL}, {SAMPLE_SQL}
SELECT conv_id, turn, {_sql_hashes(*SAMPLE_FIELDS)} FROM sample""")
def training_samples(spark, sf_dir):
    return _hashes(op.to_samples(qa_raw(spark, sf_dir)), *SAMPLE_FIELDS)


@query("prj4_inference_samples", f"""WITH {QA_SQL}, {SAMPLE_SQL}
SELECT conv_id, turn, md5(question) AS question_md5, '' AS answer FROM sample""")
def inference_samples(spark, sf_dir):
    samples = op.to_samples(qa_raw(spark, sf_dir), "inference")
    return samples.select("conv_id", "turn", F.md5("question").alias("question_md5"), "answer")


_ASKED = (
    f"{lit(OPEN + INSTRUCTION + ABOUT)} || {sql_sample('user_context')} || {lit(NEWS)} || {sql_sample('news_context')}"
    f" || {lit(QUESTION)} || {sql_sample('question')} || {lit(CLOSE)}"
)


@query("str10_training_prompt", f"""WITH {QA_SQL}, {SAMPLE_SQL}
SELECT conv_id, turn, md5({_ASKED} || {lit(RESPONSE)} || {sql_sample('answer')} || {lit(END)}) AS prompt_md5 FROM sample""")
def training_prompt(spark, sf_dir):
    return _hashes(plans.prompt_table(qa_raw(spark, sf_dir)), "prompt")


@query("str11_inference_prompt", f"""WITH {QA_SQL}, {SAMPLE_SQL}
SELECT conv_id, turn, md5({_ASKED}) AS prompt_md5 FROM sample""")
def inference_prompt(spark, sf_dir):
    return _hashes(plans.prompt_table(qa_raw(spark, sf_dir), "inference"), "prompt")


_TEACHER = (
    f"{lit(chr(10) + TEACHER_INSTRUCTION + TEACHER_ABOUT)} || about_me || {lit(TEACHER_CONTEXT)} || context"
    f" || {lit(TEACHER_CLOSING)}"
)


@query("str12_teacher_prompt", f"WITH {QA_SQL} SELECT conv_id, turn, md5({_TEACHER}) AS prompt_md5 FROM qa")
def teacher_prompt(spark, sf_dir):
    return _hashes(op.teacher_prompt(qa_raw(spark, sf_dir)), "prompt")


@query("prj5_prompt_and_payload", f"""WITH {QA_SQL}, {SAMPLE_SQL}
SELECT conv_id, turn, md5({_ASKED}) AS prompt_md5, {sql_sample('chat_history')} AS carried_history FROM sample""")
def prompt_and_payload(spark, sf_dir):
    built = plans.prompt_table(qa_raw(spark, sf_dir), "inference").select("conv_id", "turn", "prompt", "payload")
    return built.select(
        "conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.col("payload.chat_history").alias("carried_history")
    )


@query("prj6_split_question", """
SELECT doc_id, md5(string_split(text, chr(10))[-1]) AS question_md5,
       md5(array_to_string(string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1], chr(10))) AS about_me_md5
FROM documents""")
def split_question(spark, sf_dir):
    split = op.split_question(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("about_me")))
    return split.select("doc_id", F.md5("question").alias("question_md5"), F.md5("about_me").alias("about_me_md5"))


_LABELLED = f"' -> ' || length({_TEACHER}) || ' characters'"


@query("udf3_teacher_label", f"WITH {QA_SQL} SELECT conv_id, turn, {_LABELLED} AS response FROM qa")
def teacher_label(spark, sf_dir):
    queries = qa_raw(spark, sf_dir).drop("question", "response")
    return op.label(op.teacher_prompt(queries), count_reply).select("conv_id", "turn", "response")


@query("prj7_attach_response", f"""WITH {QA_SQL}
SELECT conv_id, turn, md5(string_split(about_me, chr(10))[-1]) AS question_md5, md5(context) AS context_md5,
       {_LABELLED} AS response FROM qa""")
def attach_response(spark, sf_dir):
    built = plans.build_examples(qa_raw(spark, sf_dir).drop("question", "response"), count_reply)
    return built.select("conv_id", "turn", F.md5("question").alias("question_md5"), F.md5("context").alias("context_md5"), "response")


@query("src7_read_json", f"WITH {QA_SQL} SELECT md5(about_me) AS about_me_md5, md5(response) AS response_md5, chat_history FROM qa")
def read_back_json(spark, sf_dir):
    path = work_dir(spark, "qa")
    write_json(qa_raw(spark, sf_dir).select(*QA_SCHEMA.names), path)
    read = read_json(spark, path, QA_SCHEMA, array_file=False)
    return read.select(F.md5("about_me").alias("about_me_md5"), F.md5("response").alias("response_md5"), "chat_history")


@query("snk1_write_json", f"WITH {QA_SQL} SELECT count(*) AS n, count(chat_history) AS with_history FROM qa")
def write_json_lines(spark, sf_dir):
    path = work_dir(spark, "qa")
    write_json(qa_raw(spark, sf_dir), path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.chat_history").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count("h").alias("with_history")
    )


@query("src8_read_qa", f"""WITH {QA_SQL}, {SAMPLE_SQL}
SELECT md5(user_context) AS user_context_md5, chat_history, '' AS answer FROM sample""")
def read_samples(spark, sf_dir):
    path = work_dir(spark, "qa")
    write_json(qa_raw(spark, sf_dir).select(*QA_SCHEMA.names), path)
    samples = read_qa(spark, path, "inference", array_file=False)
    return samples.select(F.md5("user_context").alias("user_context_md5"), "chat_history", "answer")


@query("win3_first_n", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 82 THEN 'train' ELSE 'test' END AS split
FROM documents""")
def first_n(spark, sf_dir):
    """Ordered by falling length, so that file order does not help."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("_key"))
    train, test = op.split_first_n(keyed, 82, ["_key", "doc_id"])
    return _labelled_split(train, test)


@query("win3_first_n_large", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY n_chars DESC, doc_id) <= count(*) OVER () // 5 * 4 THEN 'train' ELSE 'test' END AS split
FROM documents""")
def first_n_large(spark, sf_dir):
    """Four fifths of the table, by the same way as the few."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("_key"))
    return _labelled_split(*op.split_first_n(keyed, keyed.count() // 5 * 4, ["_key", "doc_id"]))


def _labelled_split(train, test):
    return train.select("doc_id", F.lit("train").alias("split")).unionByName(
        test.select("doc_id", F.lit("test").alias("split"))
    )


@query("win3_hash_split", f"""
SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < 3435973837 THEN 'train' ELSE 'test' END AS split FROM documents""")
def hash_split(spark, sf_dir):
    return _labelled_split(*op.split_by_hash(table(spark, sf_dir, "documents"), "doc_id", 0.8))


@query("win4_pack", f"""
WITH sized AS (SELECT doc_id, len({sql_words('text')}) + 1 AS n FROM documents),
placed AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS before FROM sized),
spread AS (SELECT doc_id, n, before, unnest(range(CAST(before // 1024 AS BIGINT), CAST((before + n - 1) // 1024 AS BIGINT) + 1)) AS seq_id FROM placed)
SELECT seq_id, doc_id AS sample_id, CAST(greatest(seq_id * 1024 - before, 0) AS BIGINT) AS token_from,
       CAST(least(seq_id * 1024 + 1024 - before, n) AS BIGINT) AS token_to
FROM spread""")
def pack(spark, sf_dir):
    from newsprep.functions import count_tokens

    sized = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), count_tokens("text").alias("tokens"))
    return op.pack(sized, 1024, separator=1)


@query("agg2_perplexity", """
SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type
UNION ALL SELECT 'all', round(exp(avg(value / 100)), 6) FROM events""")
def perplexity(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("nll"))
    by_type = op.perplexity(scored, "nll", ["event_type"])
    overall = op.perplexity(scored, "nll").select(F.lit("all").alias("event_type"), "perplexity")
    return by_type.unionByName(overall).withColumn("perplexity", F.round("perplexity", 6))


@query("agg3_sizes", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def sizes(spark, sf_dir):
    return op.sizes(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("agg3_counted_on_the_way", "SELECT count(*) AS n FROM documents")
def counted(spark, sf_dir):
    """The count comes from the metrics of a job that had another purpose."""
    path = work_dir(spark, "counted")
    rows, seen = op.count_rows(table(spark, sf_dir, "documents").select("doc_id"), "documents")
    rows.write.parquet(path)
    return spark.range(1).select(F.lit(seen.get["n"]).cast("bigint").alias("n"))
