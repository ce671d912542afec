"""Messages to documents to points."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep import plans
from newsprep.functions import iso_z

from .common import NEWS_SQL, chunks_sql, news, query, sql_clean_ascii, sql_html


def frames(spark, sf_dir):
    """News as landed frames of up to 20 messages, some of them bad, with control and broken frames."""
    articles = news(spark, sf_dir)
    number = F.col("id")
    message = F.struct(
        F.lit("n").alias("T"),
        F.when(number % 53 == 5, F.concat(F.lit("x"), number.cast("string"))).otherwise(number.cast("string")).alias("id"),
        F.when(number % 50 != 3, F.col("headline")).alias("headline"),
        "summary", "author",
        F.when(number % 61 == 7, "soon").otherwise(iso_z("created_at")).alias("created_at"),
        iso_z("updated_at").alias("updated_at"), "url", "content", "symbols", "source",
    )
    batches = articles.groupBy(F.call_function("div", number, F.lit(20)).alias("frame")).agg(
        F.to_json(F.array_sort(F.collect_list(message), lambda a, b: F.when(a["updated_at"] < b["updated_at"], -1).otherwise(1))).alias("value")
    )
    control = articles.where(number % 100 == 0).select(F.lit('[{"T":"success","msg":"connected"}]').alias("value"))
    broken = articles.where(number % 97 == 0).select(F.concat(F.lit("[{broken "), number.cast("string")).alias("value"))
    return batches.select("value").unionByName(control).unionByName(broken)


REASON_SQL = """CASE WHEN id % 50 = 3 THEN 'missing headline' WHEN id % 53 = 5 THEN 'bad id'
            WHEN id % 61 = 7 THEN 'bad created_at' END"""
GOOD_SQL = f"""{NEWS_SQL.replace('news AS', 'landed AS', 1)},
news AS (SELECT * FROM landed WHERE ({REASON_SQL}) IS NULL)"""


@query("prj1_explode_messages", f"""WITH {NEWS_SQL}
SELECT kind, count(*) AS n FROM (
  SELECT 'n' AS kind FROM news UNION ALL SELECT 'success' FROM news WHERE id % 100 = 0
  UNION ALL SELECT 'unreadable' FROM news WHERE id % 97 = 0) GROUP BY kind""")
def explode_messages(spark, sf_dir):
    messages = op.explode_messages(frames(spark, sf_dir))
    kind = F.coalesce("message.T", F.lit("unreadable"))
    return messages.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("prj2_good_rows", f"""WITH {GOOD_SQL}
SELECT id, md5(content) AS content_md5, epoch_us(created_at) AS created_us, url FROM news""")
def good_rows(spark, sf_dir):
    good, _ = op.parse_messages(frames(spark, sf_dir))
    return good.select("id", F.md5("content").alias("content_md5"), F.unix_micros("created_at").alias("created_us"), "url")


@query("prj2_reject_reasons", f"""WITH {NEWS_SQL}
SELECT reason, count(*) AS n FROM (
  SELECT {REASON_SQL} AS reason FROM news UNION ALL SELECT 'invalid json' FROM news WHERE id % 97 = 0)
WHERE reason IS NOT NULL GROUP BY reason""")
def reject_reasons(spark, sf_dir):
    _, rejects = op.parse_messages(frames(spark, sf_dir))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("prj3_documents", f"""WITH {NEWS_SQL}
SELECT id AS article_id, md5(content) AS doc_id, {sql_clean_ascii('headline')} AS headline,
       md5({sql_clean_ascii('summary')}) AS summary_md5, md5({sql_clean_ascii(sql_html('content'))}) AS body_md5,
       url, author, epoch_us(created_at) AS created_us, array_to_string(symbols, ',') AS symbols FROM news""")
def documents(spark, sf_dir):
    return op.to_documents(news(spark, sf_dir)).select(
        "article_id", "doc_id", F.col("text")[0].alias("headline"), F.md5(F.col("text")[1]).alias("summary_md5"),
        F.md5(F.col("text")[2]).alias("body_md5"), "metadata.url", "metadata.author",
        F.unix_micros("metadata.created_at").alias("created_us"), F.array_join("metadata.symbols", ",").alias("symbols"),
    )


@query("prj8_payloads", f"""WITH {NEWS_SQL}, {chunks_sql(64)}
SELECT md5(chunk) AS chunk_id, id AS article_id, part, pos, md5(summary) AS summary_md5, md5(chunk) AS text_md5 FROM chunks""")
def payloads(spark, sf_dir):
    return plans.news_chunks(news(spark, sf_dir), 64).select(
        "chunk_id", "article_id", F.col("part").cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos"),
        F.md5("payload.summary").alias("summary_md5"), F.md5("payload.text").alias("text_md5"),
    )


@query("map1_merge_text", f"""WITH {NEWS_SQL}, {chunks_sql(64)}
SELECT id AS article_id, part, pos, docs.author, docs.url, length(chunk) AS text_chars
FROM chunks JOIN docs USING (id)""")
def merge_text(spark, sf_dir):
    chunks = op.chunk(op.to_documents(news(spark, sf_dir)), 64).withColumn("payload", op.payload())
    return chunks.select(
        "article_id", F.col("part").cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos"),
        "payload.author", "payload.url", F.length("payload.text").cast("bigint").alias("text_chars"),
    )


@query("prj9_zip_points", """
SELECT doc_id, id AS chunk_id, length(payload) AS payload_chars
FROM (SELECT doc_id, unnest(list_transform(lines, lambda l: md5(l))) AS id, unnest(lines) AS payload
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 5 <> 0))""")
def zip_points(spark, sf_dir):
    """Ids, vectors and payloads of every line; documents that lack a vector are refused."""
    return op.zip_points(_arrays(spark, sf_dir), "ids", "vectors", "payloads").select(
        "doc_id", "chunk_id", F.length("payload").cast("bigint").alias("payload_chars")
    )


@query("prj9_unequal", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def unequal(spark, sf_dir):
    return op.unequal(_arrays(spark, sf_dir), "ids", "vectors", "payloads").select("doc_id")


def _arrays(spark, sf_dir):
    """Parallel arrays per document; every fifth lacks its last vector."""
    from .common import table

    lines = F.split("text", "\n")
    known = F.size(lines) - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.transform(lines, F.md5).alias("ids"),
        F.transform(F.slice(lines, F.lit(1), known), lambda x: F.array(F.length(x))).alias("vectors"),
        lines.alias("payloads"),
    )
