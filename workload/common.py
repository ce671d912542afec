"""Registration, tables and shared SQL for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprep.functions.text import DOUBLE_QUOTES, SINGLE_QUOTES, WHITE
from newsprep.operators import pairs
from newsprep.session import configure, ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say it."""

    def register(body):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(configure(spark), "newsprep", "workload")
            return body(spark, sf_dir)

        run.__doc__ = body.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return body

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "embeddings") else df


# News articles made from ``documents``: the text is the content, its first line the summary.
START = "2024-01-01 00:00:00"


def as_news(df: DataFrame, id_col: str, content: str, source: str, symbols: list[str]) -> DataFrame:
    number = F.col(id_col)
    created = F.timestamp_micros((F.lit(1704067200) + number * 60) * 1_000_000)
    return df.select(
        number.alias("id"),
        F.concat(F.lit("Report "), number.cast("string"), F.lit(" of "), F.col(source)).alias("headline"),
        F.element_at(F.split(content, "\n"), 1).alias("summary"),
        F.col(source).alias("author"),
        created.alias("created_at"),
        (created + F.make_dt_interval(hours=(number % 3).cast("int"))).alias("updated_at"),
        F.when(number % 7 != 0, F.concat(F.lit("https://news.example/"), number.cast("string"))).alias("url"),
        F.col(content).alias("content"),
        F.array(*symbols).alias("symbols"),
        F.col(source).alias("source"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_news(table(spark, sf_dir, "documents"), "doc_id", "text", "source", ["lang", "source"])


NEWS_SQL = """news AS (
  SELECT doc_id AS id, 'Report ' || doc_id || ' of ' || source AS headline,
         split_part(text, chr(10), 1) AS summary, source AS author,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id + 60 * (doc_id % 3)) AS updated_at,
         CASE WHEN doc_id % 7 <> 0 THEN 'https://news.example/' || doc_id END AS url,
         text AS content, [lang, source] AS symbols, source
  FROM documents)"""


def qa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer examples made from ``conversations``."""
    asked = pairs(table(spark, sf_dir, "conversations"))
    return asked.select(
        "conv_id", "turn",
        F.concat(F.lit("Reader "), F.col("conv_id").cast("string"), F.lit("\nlong term\n"), "question").alias("about_me"),
        F.col("answer").alias("context"),
        "question",
        F.concat(F.lit("\n"), "answer").alias("response"),
        F.when(F.col("turn") > 0, F.concat(F.lit("turn  "), F.col("turn").cast("string"))).alias("chat_history"),
    )


QA_SQL = """qa AS (
  SELECT conv_id, turn, 'Reader ' || conv_id || chr(10) || 'long term' || chr(10) || text AS about_me,
         next_text AS context, text AS question, chr(10) || next_text AS response,
         CASE WHEN turn > 0 THEN 'turn  ' || turn END AS chat_history
  FROM (SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# SQL forms of the cleaning steps.
def sql_clean(x: str) -> str:
    return f"trim({x}, {lit(WHITE)})"


def sql_extra(x: str) -> str:
    return sql_clean(f"regexp_replace(translate({x}, chr(10) || chr(160), '  '), ' {{2,}}', ' ', 'g')")


def sql_ascii(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g')"


def sql_quotes(x: str) -> str:
    straight = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    return f"translate({x}, {lit(SINGLE_QUOTES + DOUBLE_QUOTES)}, {lit(straight)})"


def sql_clean_ascii(x: str) -> str:
    return sql_ascii(sql_quotes(sql_clean(x)))


def sql_paragraphs(x: str) -> str:
    blank = "'\\n[ \\t\\r\\f]*\\n[ \\t\\r\\f\\n]*'"
    single = "'[ \\t\\r\\f]*\\n[ \\t\\r\\f]*'"
    return (
        f"array_to_string(list_transform(regexp_split_to_array({sql_clean(x)}, {blank}), "
        f"lambda p: regexp_replace(p, {single}, ' ', 'g')), chr(10) || chr(10))"
    )


def sql_sample(x: str) -> str:
    return sql_paragraphs(sql_extra(x))


def sql_html(x: str) -> str:
    # Written out here, not taken from the library, so that a wrong pattern there shows.
    quoted = """(?:[^<>"']|"[^"]*"|'[^']*')*>"""
    inline = "(?i)</?(?:a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u)\\b" + quoted
    hidden = "(?is)<!--.*?(?:-->|\\z)|<script\\b[^>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^>]*>.*?(?:</style\\s*>|\\z)"
    for pattern, by in ((hidden, " "), ("(?is)<title\\b[^>]*>.*?</title\\s*>", " "), (inline, ""), ("<[a-zA-Z/!?]" + quoted, " ")):
        x = f"regexp_replace({x}, {lit(pattern)}, '{by}', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return sql_clean(f"regexp_replace({x}, '[\\s' || chr(160) || ']+', ' ', 'g')")


def sql_words(x: str) -> str:
    spaced = f"translate({x}, {lit(WHITE)}, repeat(' ', {len(WHITE)}))"
    return f"list_filter(regexp_split_to_array({spaced}, ' +'), lambda w: w <> '')"


def sql_chunks(words: str, size: int) -> str:
    """A list of chunks from a column that holds a list of words."""
    return (
        f"list_transform(range(0, CAST(ceil(len({words}) / {size}.0) AS BIGINT)), "
        f"lambda i: array_to_string({words}[i * {size} + 1:(i + 1) * {size}], ' '))"
    )


def sql_bucket(word: str, n: int) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, 8) AS BIGINT) % {n}"


def chunks_sql(size: int) -> str:
    """``docs`` and ``chunks`` from ``news``: one row per chunk of each cleaned part."""
    return f"""docs AS (
  SELECT id, md5(content) AS doc_id, {sql_clean_ascii('headline')} AS headline,
         {sql_clean_ascii('summary')} AS summary, {sql_clean_ascii(sql_html('content'))} AS body,
         url, symbols, author, created_at, updated_at
  FROM news),
parts AS (
  SELECT id, doc_id, summary, created_at, updated_at, CAST(p AS BIGINT) AS part,
         {sql_words('(CASE p WHEN 0 THEN headline WHEN 1 THEN summary ELSE body END)')} AS words
  FROM docs CROSS JOIN (VALUES (0), (1), (2)) AS t(p)),
pieces AS (
  SELECT id, doc_id, summary, created_at, updated_at, part, {sql_chunks('words', size)} AS list FROM parts),
chunks AS (
  SELECT id, doc_id, summary, created_at, updated_at, part, unnest(range(0, len(list))) AS pos, unnest(list) AS chunk
  FROM pieces)"""


def latest_sql(source: str = "chunks", name: str = "points") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, md5(chunk) AS chunk_id, row_number() OVER (PARTITION BY md5(chunk)
    ORDER BY updated_at DESC, created_at DESC, id DESC, part DESC, pos DESC) AS rn FROM {source}) WHERE rn = 1)"""
