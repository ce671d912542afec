"""Backfill, intervals, paging, symbols, landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsprep import operators as op
from newsprep.functions import iso_z
from newsprep.session import work_dir
from newsprep.sources import landing_stream, parse_pages, read_pages

from .common import NEWS_SQL, news, query, sql_bucket, table

LO, HI = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
_IN = f"ts >= TIMESTAMP '{LO}' AND ts < TIMESTAMP '{HI}'"


def interval_sql(ts: str, lo: str, hi: str, n: int) -> str:
    return f"(epoch_us({ts}) - epoch_us({lo})) * {n} // (epoch_us({hi}) - epoch_us({lo}))"


_ID = interval_sql("ts", f"TIMESTAMP '{LO}'", f"TIMESTAMP '{HI}'", 8)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("src1_backfill", f'SELECT event_id, {_ID} AS "interval", epoch_us(ts) AS micros FROM events WHERE {_IN}')
def backfill(spark, sf_dir):
    rows = op.backfill(_events(spark, sf_dir), LO, HI, 8, "ts", "event_id")
    return rows.select("event_id", "interval", F.unix_micros("ts").alias("micros"))


@query("src2_intervals", f"""
WITH span AS (SELECT min(ts) AS lo, max(ts) + INTERVAL 1 MICROSECOND AS hi FROM events),
cuts AS (SELECT i AS "interval", epoch_us(lo) + (i * (epoch_us(hi) - epoch_us(lo)) + 6) // 7 AS start_us,
                epoch_us(lo) + ((i + 1) * (epoch_us(hi) - epoch_us(lo)) + 6) // 7 AS end_us
         FROM span, range(7) AS r(i))
SELECT "interval", start_us, end_us, count(event_id) AS n
FROM cuts LEFT JOIN events ON epoch_us(ts) >= start_us AND epoch_us(ts) < end_us GROUP BY ALL""")
def intervals(spark, sf_dir):
    """Seven intervals over the span of the table, with the rows that fall in each."""
    events = _events(spark, sf_dir)
    span = events.agg(F.min("ts").alias("lo"), F.timestamp_micros(F.unix_micros(F.max("ts")) + 1).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    counts = events.groupBy(op.interval_id("ts", lo, hi, 7).alias("interval")).agg(F.count(F.lit(1)).alias("n"))
    return op.split_span(span, 7).join(counts, "interval", "left").select(
        "interval", F.unix_micros("interval_start").alias("start_us"), F.unix_micros("interval_end").alias("end_us"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@query("flt1_time_range", f"SELECT event_id FROM events WHERE {_IN}")
def time_range(spark, sf_dir):
    return _events(spark, sf_dir).where(op.in_range("ts", LO, HI)).select("event_id")


@query("srt1_time_order", f"""
SELECT event_id, {_ID} AS "interval",
       row_number() OVER (PARTITION BY {_ID} ORDER BY ts, event_id) AS place FROM events WHERE {_IN}""")
def time_order(spark, sf_dir):
    """The place of a row is where it comes in its partition, as it is read; without the sort the places are others."""
    together = _events(spark, sf_dir).repartition(op.interval_id("ts", LO, HI, 8))
    rows = op.backfill(together, LO, HI, 8, "ts", "event_id")
    placed = rows.select("event_id", "interval").withColumn("_at", F.monotonically_increasing_id())
    first = placed.groupBy("interval").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "interval").select("event_id", "interval", (F.col("_at") - F.col("_first") + 1).alias("place"))


def _landed_pages(spark, sf_dir):
    """The news articles as files by hour, 60 at most in each."""
    path = work_dir(spark, "hours")
    articles = news(spark, sf_dir)
    stamped = articles.withColumns({
        "hour": F.call_function("div", F.unix_seconds("created_at"), F.lit(3600)),
        "created_at": iso_z("created_at"), "updated_at": iso_z("updated_at"),
    })
    stamped.repartition("hour").write.partitionBy("hour").json(path)
    end = articles.agg(F.max("created_at").cast("string")).first()[0]
    return path if "://" in path else f"file://{path}", end


def _pages(spark, sf_dir):
    folder, end = _landed_pages(spark, sf_dir)
    return read_pages(
        spark, "2024-01-01T00:00:00Z", end.replace(" ", "T") + ".000001Z", 8,
        "newsprep.sources.folder_pages:open_pages", 50, folder=folder,
    )


@query("src3_paged_news", f"""WITH {NEWS_SQL}
SELECT id, md5(content) AS content_md5, epoch_us(updated_at) AS updated_us, url FROM news""")
def paged_news(spark, sf_dir):
    good, _ = parse_pages(_pages(spark, sf_dir))
    return good.select("id", F.md5("content").alias("content_md5"), F.unix_micros("updated_at").alias("updated_us"), "url")


@query("lim1_page_limit", f"WITH {NEWS_SQL} SELECT true AS within_limit, count(*) AS articles FROM news")
def page_limit(spark, sf_dir):
    """No page holds more than 50 articles, and the pages hold them all."""
    pages = _pages(spark, sf_dir)
    good, _ = parse_pages(pages)
    largest = pages.agg(F.max(F.json_array_length("value"))).scalar()
    return good.agg(F.count(F.lit(1)).alias("articles")).select((largest <= 50).alias("within_limit"), "articles")


@query("src5_by_symbols", f"WITH {NEWS_SQL} SELECT id FROM news WHERE list_has_any(symbols, ['en', 'src3'])")
def by_symbols(spark, sf_dir):
    return op.by_symbols(news(spark, sf_dir), ["en", "src3"]).select("id")


@query("src5_all_symbols", f"WITH {NEWS_SQL} SELECT id FROM news")
def all_symbols(spark, sf_dir):
    return op.by_symbols(news(spark, sf_dir), ["*", "en"]).select("id")


@query("src6_spread_by_symbol", f"""WITH {NEWS_SQL}
SELECT symbol, {sql_bucket('symbol', 5)} AS worker, count(*) AS n FROM (SELECT unnest(symbols) AS symbol FROM news) GROUP BY ALL""")
def spread_by_symbol(spark, sf_dir):
    rows = op.spread_by_symbol(news(spark, sf_dir).select("id", "symbols"), 5)
    return rows.groupBy("symbol", "worker").agg(F.count(F.lit(1)).alias("n"))


@query("src4_landing_stream", f"""WITH {NEWS_SQL} SELECT id, md5(headline) AS headline_md5 FROM news""")
def landed(spark, sf_dir):
    """Frames read as a stream; the stream's output is read back as a table."""
    src, out = work_dir(spark, "landing"), work_dir(spark, "landed")
    news(spark, sf_dir).select(F.to_json(F.array(F.struct("id", "headline"))).alias("value")).write.text(src)
    query = (
        landing_stream(spark, src).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", work_dir(spark, "landed-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    messages = op.explode_messages(spark.read.parquet(out))
    return messages.select(F.col("message.id").cast("bigint").alias("id"), F.md5("message.headline").alias("headline_md5"))
