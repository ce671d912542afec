"""Cleaning, HTML, chunking, ids, dates and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from newsprep import functions as fn
from newsprep import operators as op
from newsprep.functions.text import DOUBLE_QUOTES, SINGLE_QUOTES
from newsprep.sources.collection import latest_points

from .common import (
    NEWS_SQL, chunks_sql, lit, news, query, sql_ascii, sql_bucket, sql_clean, sql_clean_ascii, sql_extra, sql_html,
    sql_paragraphs, sql_quotes, sql_sample, sql_words, table,
)


def _hashed(name, spark_text, sql_text, tbl="documents", key="doc_id"):
    """A query that cleans every text of a table and returns its hash and length."""
    sql = (
        f"SELECT {key}, md5(x) AS text_md5, length(x) AS n_chars FROM (SELECT {key}, {sql_text} AS x FROM {tbl})"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        cleaned = table(spark, sf_dir, tbl).select(key, spark_text().alias("x"))
        return cleaned.select(key, F.md5("x").alias("text_md5"), F.length("x").cast("bigint").alias("n_chars"))


def _padded():
    return F.concat(F.lit("\t \u00a0"), "text", F.lit("\n\u3000 "))


_PADDED = "(chr(9) || ' ' || chr(160) || text || chr(10) || chr(12288) || ' ')"


def _curly():
    return F.translate("text", "aeio", SINGLE_QUOTES[:2] + DOUBLE_QUOTES[:2])


_CURLY = f"translate(text, 'aeio', {lit(SINGLE_QUOTES[:2] + DOUBLE_QUOTES[:2])})"

_hashed("str1_clean", lambda: fn.clean(_padded()), sql_clean(_PADDED))
_hashed("str2_extra_whitespace", lambda: fn.clean_extra_whitespace(_padded()), sql_extra(_PADDED))
_hashed("str3_non_ascii", lambda: fn.strip_non_ascii("text"), sql_ascii("text"))
_hashed("str4_quotes", lambda: fn.replace_quotes(_curly()), sql_quotes(_CURLY))
_hashed("str5_group_paragraphs", lambda: fn.group_paragraphs("text"), sql_paragraphs("text"))
_hashed("str6_html_to_text", lambda: fn.html_to_text("html"), sql_html("html"), "pages", "page_id")
_hashed("str7_clean_question", lambda: fn.clean_question(_curly(), None), sql_clean_ascii(_CURLY))
_hashed("str8_cut_question", lambda: fn.clean_question("text", 384), f"substr({sql_clean_ascii('text')}, 1, 384)")


@query("str9_clean_fields", f"""
SELECT conv_id, turn, {sql_sample('role')} AS role, md5({sql_sample('text')}) AS text_md5 FROM conversations""")
def clean_fields(spark, sf_dir):
    cleaned = fn.clean_fields(table(spark, sf_dir, "conversations"), ["role", "text"])
    return cleaned.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("str13_chunk_words", f"""WITH {NEWS_SQL}, {chunks_sql(64)}
SELECT id, part, pos, md5(chunk) AS chunk_md5 FROM chunks""")
def chunk_words(spark, sf_dir):
    chunks = op.chunk(op.to_documents(news(spark, sf_dir)), 64)
    return chunks.select(
        F.col("article_id").alias("id"), F.col("part").cast("bigint").alias("part"),
        F.col("pos").cast("bigint").alias("pos"), F.md5("chunk").alias("chunk_md5"),
    )


def letters_per_token():
    """A stand-in tokenizer: one token for every four letters of a word."""
    return lambda words: [-(-len(w) // 4) for w in words]


@query("str13_chunk_tokenizer", f"""WITH RECURSIVE {NEWS_SQL}, {chunks_sql(64)},
sized AS (SELECT id, part, words, list_transform(words, lambda w: (len(w) + 3) // 4) AS sizes FROM parts WHERE len(words) > 0),
summed AS (SELECT id, part, words, list_transform(range(1, len(sizes) + 1), lambda i: CAST(list_sum(sizes[1:i]) AS BIGINT)) AS total FROM sized),
cut(id, part, pos, first, after) AS (
  SELECT id, part, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(len(list_filter(total, lambda t: t <= 64)) AS BIGINT) FROM summed
  UNION ALL
  SELECT cut.id, cut.part, cut.pos + 1, cut.after, CAST(len(list_filter(total, lambda t: t <= total[cut.after] + 64)) AS BIGINT)
  FROM cut JOIN summed ON summed.id = cut.id AND summed.part = cut.part WHERE cut.after < len(words))
SELECT cut.id AS article_id, cut.part, cut.pos, false AS hard_split, md5(array_to_string(words[first + 1:after], ' ')) AS chunk_md5
FROM cut JOIN summed ON summed.id = cut.id AND summed.part = cut.part""")
def chunk_tokenizer(spark, sf_dir):
    """Greedy fill by a tokenizer. No word of the tables is over the budget; such words are tested apart."""
    chunks = op.chunk(op.to_documents(news(spark, sf_dir)), 64, letters_per_token)
    return chunks.select("article_id", F.col("part").cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos"), "hard_split", F.md5("chunk").alias("chunk_md5"))


@query("str14_content_ids", "SELECT doc_id, md5(text) AS content_id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.content_id("text").alias("content_id"))


@query("arr1_parts_in_order", f"""WITH {NEWS_SQL}, {chunks_sql(64)}
SELECT id, part, count(*) AS chunks, max(pos) AS last_pos FROM chunks GROUP BY id, part""")
def parts_in_order(spark, sf_dir):
    chunks = op.chunk(op.to_documents(news(spark, sf_dir)), 64)
    return chunks.groupBy(F.col("article_id").alias("id"), F.col("part").cast("bigint").alias("part")).agg(
        F.count(F.lit(1)).alias("chunks"), F.max("pos").cast("bigint").alias("last_pos")
    )


@query("dt1_parse_day", """
SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS parsed, 0 AS bad_parsed
FROM (SELECT event_id, ts FROM events)""")
def parse_day(spark, sf_dir):
    day = F.date_format("ts", "d/M/yyyy")
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.date_format(fn.parse_day(day), "yyyy-MM-dd").alias("parsed"),
        fn.parse_day(F.date_format("ts", "yyyy-MM-dd")).isNotNull().cast("int").alias("bad_parsed"),
    )


@query("dt2_iso_z", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def iso_z(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.iso_z("ts").alias("stamp"))


@query("dt3_parse_rfc3339", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def parse_rfc3339(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(fn.parse_rfc3339(stamp)).alias("micros"))


@query("jsn1_json_round_trip", """
SELECT event_id, 'k' || CAST(json_extract(props, '$.k') AS BIGINT) AS headline,
       '{"T":"n","id":"' || event_id || '","headline":"k' || CAST(json_extract(props, '$.k') AS BIGINT) || '"}' AS encoded
FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT event_id, NULL, '{broken' || event_id FROM events WHERE event_id % 50 = 0""")
def json_round_trip(spark, sf_dir):
    """Messages decoded from frames and encoded again; every fiftieth frame cannot be read and comes back as it is."""
    number = F.get_json_object("props", "$.k").cast("bigint")
    message = F.struct(F.lit("n").alias("T"), F.col("event_id").alias("id"), F.concat(F.lit("k"), number.cast("string")).alias("headline"))
    frames = table(spark, sf_dir, "events").select("event_id", F.when(
        F.col("event_id") % 50 == 0, F.concat(F.lit("{broken"), F.col("event_id").cast("string"))
    ).otherwise(F.to_json(F.array(message))).alias("value"))
    messages = op.explode_messages(frames)
    return messages.select("event_id", "message.headline", F.coalesce(F.to_json("message"), "raw").alias("encoded"))


@query("vec1_cosine", """
SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a
JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    left = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return left.join(right, "vec_id").select("vec_id", fn.cosine("embedding", "next").alias("cosine"))


@query("vec3_hash_encoder", f"""
SELECT doc_id, {sql_bucket('w', 384)} AS bucket, count(*) AS n
FROM (SELECT doc_id, unnest({sql_words('text')}) AS w FROM documents) GROUP BY ALL""")
def hash_encoder(spark, sf_dir):
    vectors = op.hash_encode(table(spark, sf_dir, "documents"), 384, "text")
    return vectors.select("doc_id", F.posexplode_outer("vector").alias("bucket", "n")).where("n > 0").select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n")
    )


def letter_counts():
    """A stand-in encoder; it refuses texts whose length is a multiple of ten."""

    def predict(texts: np.ndarray) -> np.ndarray:
        if any(len(t) % 10 == 0 for t in texts):
            raise ValueError("text refused")
        return np.array([[t.count("a"), t.count("e"), len(t)] for t in texts], dtype=np.float32)

    return predict


@query("udf1_embed", """
SELECT doc_id, CASE WHEN length(text) % 10 = 0 THEN 'ValueError: text refused' END AS error,
       CASE WHEN length(text) % 10 = 0 THEN 0 ELSE 3 END AS size,
       CASE WHEN length(text) % 10 <> 0 THEN length(text) - length(replace(text, 'a', '')) END AS n_a,
       CASE WHEN length(text) % 10 <> 0 THEN length(text) END AS n_all
FROM documents""")
def embed(spark, sf_dir):
    embedded = op.embed(table(spark, sf_dir, "documents"), letter_counts, 64, "text")
    return embedded.select(
        "doc_id", "error", F.size("vector").alias("size"),
        F.get("vector", 0).cast("bigint").alias("n_a"), F.get("vector", 2).cast("bigint").alias("n_all"),
    )


@query("flt3_drop_failed_embeddings", """
SELECT length(text) % 10 <> 0 AS kept, count(*) AS n FROM documents GROUP BY ALL""")
def drop_failed(spark, sf_dir):
    embedded = op.with_state(op.embed(table(spark, sf_dir, "documents"), letter_counts, 64, "text"), 3)
    return embedded.groupBy((F.col("state") == "ok").alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def first_token_states():
    """A stand-in encoder that yields one state per word and keeps the first, as pooling does."""

    def predict(texts: np.ndarray) -> np.ndarray:
        states = [np.array([[len(w), w.count("e")] for w in (t.split() or [""])], dtype=np.float32) for t in texts]
        return np.stack([s[0] for s in states])

    return predict


@query("vec2_first_token_pooling", f"""
SELECT item_id, length(w) AS n_chars, length(w) - length(replace(w, 'e', '')) AS n_e
FROM (SELECT item_id, {sql_words('text')}[1] AS w FROM benchmark)""")
def first_token(spark, sf_dir):
    embedded = op.embed(table(spark, sf_dir, "benchmark"), first_token_states, text="text")
    return embedded.select(
        "item_id", F.get("vector", 0).cast("bigint").alias("n_chars"), F.get("vector", 1).cast("bigint").alias("n_e")
    )


@query("udf4_count_tokens", f"SELECT doc_id, len({sql_words('text')}) AS tokens FROM documents")
def count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.count_tokens("text").alias("tokens"))


def pieces_at_a():
    return lambda texts: [t.count("a") + 1 for t in texts]


@query("udf4_count_tokens_custom", """
SELECT doc_id, length(text) - length(replace(text, 'a', '')) + 1 AS tokens FROM documents""")
def count_tokens_custom(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.count_tokens("text", pieces_at_a).alias("tokens"))


@query("win2_latest_by_hash", f"""WITH {NEWS_SQL}, {chunks_sql(64)}
SELECT chunk_id, id, part, pos FROM (SELECT *, md5(chunk) AS chunk_id, row_number() OVER (PARTITION BY md5(chunk)
  ORDER BY updated_at DESC, created_at DESC, id DESC, part DESC, pos DESC) AS rn FROM chunks) WHERE rn = 1""")
def latest_by_hash(spark, sf_dir):
    points = latest_points(op.to_points(op.chunk(op.to_documents(news(spark, sf_dir)), 64)))
    return points.select(
        "chunk_id", F.col("article_id").alias("id"), F.col("part").cast("bigint").alias("part"),
        F.col("pos").cast("bigint").alias("pos"),
    )
