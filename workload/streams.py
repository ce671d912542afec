"""The news stream into a collection, replay, and batch against stream."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from newsprep.plans import news_chunks
from newsprep.session import work_dir
from newsprep.sources import ensure_collection, landing_batch, link_sources, read_collection, read_sources
from newsprep.streaming import ProgressLog, counts_tap, ingest_frames, memory_stream, news_stream, read_memory, read_progress

from .common import NEWS_SQL, chunks_sql, latest_sql, news, query, table
from .ingest import GOOD_SQL, REASON_SQL, frames
from .retrieval import HISTORY_SQL

DIM, WORDS = 128, 64
POINTS_SQL = f"WITH {GOOD_SQL}, {chunks_sql(WORDS)}, {latest_sql()} SELECT chunk_id, id AS article_id, part, pos FROM points"


def _landed(spark, sf_dir):
    src = work_dir(spark, "landing")
    frames(spark, sf_dir).write.text(src)
    return src


def _points(spark, dst):
    return read_collection(spark, dst).select(
        "chunk_id", "article_id", F.col("part").cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos")
    )


def _stream(spark, src, dst, run_id, **options):
    news_stream(
        spark, src, dst, work_dir(spark, "state"), run_id, dim=DIM, max_tokens=WORDS,
        **{"trigger": {"availableNow": True}, **options}
    ).awaitTermination()


@query("stm1_news_stream", POINTS_SQL)
def stream(spark, sf_dir):
    """Landing folder to collection in micro-batches of four files."""
    src, dst = _landed(spark, sf_dir), work_dir(spark, "collection")
    _stream(spark, src, dst, "live", max_files=4)
    return _points(spark, dst)


@query("stm2_same_graph_batch", POINTS_SQL)
def batch(spark, sf_dir):
    """The same graph over the same frames as one table."""
    src, dst = _landed(spark, sf_dir), work_dir(spark, "collection")
    ensure_collection(spark, dst, DIM)
    ingest_frames(landing_batch(spark, src), dst, "backfill", 0, dim=DIM, max_tokens=WORDS)
    return _points(spark, dst)


@query("stm3_replay", POINTS_SQL)
def replay(spark, sf_dir):
    """A second stream over the same folder under the same run replaces what the first wrote."""
    src, dst = _landed(spark, sf_dir), work_dir(spark, "collection")
    _stream(spark, src, dst, "live")
    _stream(spark, src, dst, "live")
    return _points(spark, dst)


@query("stm4_debug_tap", f"""WITH {NEWS_SQL}
SELECT (SELECT count(*) FROM news) + (SELECT count(*) FROM news WHERE id % 100 = 0) + (SELECT count(*) FROM news WHERE id % 97 = 0) AS messages,
       (SELECT count(*) FROM news WHERE ({REASON_SQL}) IS NULL) AS articles""")
def tap(spark, sf_dir):
    """Counts reported by the batches of a stream."""
    src, dst, seen = _landed(spark, sf_dir), work_dir(spark, "collection"), []
    _stream(spark, src, dst, "live", tap=lambda batch_id, counts: seen.append(counts))
    totals = [sum(c[name] for c in seen) for name in ("messages", "articles")]
    return spark.range(1).select(F.lit(totals[0]).cast("bigint").alias("messages"), F.lit(totals[1]).cast("bigint").alias("articles"))


@query("stm4_progress", f"""WITH {NEWS_SQL}
SELECT (SELECT count(*) FROM news) + (SELECT count(*) FROM news WHERE id % 100 = 0) + (SELECT count(*) FROM news WHERE id % 97 = 0) AS messages,
       (SELECT count(*) FROM news WHERE ({REASON_SQL}) IS NULL) AS articles, true AS every_batch_seen""")
def progress(spark, sf_dir):
    """The same counts from the table that the stream keeps, and its batches from the listener's."""
    src, dst, log = _landed(spark, sf_dir), work_dir(spark, "collection"), work_dir(spark, "progress")
    listener = ProgressLog(log)
    spark.streams.addListener(listener)
    try:
        _stream(spark, src, dst, "live", max_files=3, tap=counts_tap(log, "live"))
        for _ in range(100):  # the listener hears of the last batch a moment later
            rows = read_progress(spark, log)
            if rows.where("kind = 'ended'").count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    counts = rows.where("kind = 'counts'").agg(*[F.sum(F.col("counts")[c]).alias(c) for c in ("messages", "articles")])
    heard = rows.where("kind = 'progress' AND rows > 0").agg(F.countDistinct("batch_id")).scalar()
    told = rows.where("kind = 'counts'").agg(F.countDistinct("batch_id")).scalar()
    return counts.select("messages", "articles", (heard == told).alias("every_batch_seen"))


@query("win1_live_memory", f"WITH {HISTORY_SQL} SELECT conv_id, n_pairs, md5(chat_history) AS history_md5 FROM histories")
def live_memory(spark, sf_dir):
    """Turns arrive in three micro-batches, by their numbers; the state holds three pairs of each conversation."""
    src, dst, state = (work_dir(spark, name) for name in ("turns", "memory", "memory-state"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    for low, high in ((0, 2), (2, 3), (3, 1 << 31)):
        turns.where((F.col("turn") >= low) & (F.col("turn") < high)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(turns.schema).parquet(src)
        memory_stream(stream, dst, state, 3, expire=None, trigger={"availableNow": True}).awaitTermination()
    memory = read_memory(spark, dst)
    return memory.select("conv_id", F.size("pairs").cast("bigint").alias("n_pairs"), F.md5("chat_history").alias("history_md5"))


@query("prj8_sources", f"""WITH {NEWS_SQL}, {chunks_sql(WORDS)} SELECT DISTINCT md5(chunk) AS chunk_id, id AS article_id, doc_id FROM chunks""")
def source_links(spark, sf_dir):
    """Every article of every chunk; a batch is written twice."""
    path = work_dir(spark, "collection")
    chunks = news_chunks(news(spark, sf_dir), WORDS)
    link_sources(chunks.where(F.col("article_id") % 2 == 0), path, "a", 0)
    link_sources(chunks.where(F.col("article_id") % 2 == 0), path, "a", 0)
    link_sources(chunks.where(F.col("article_id") % 2 == 1), path, "a", 1)
    return read_sources(spark, path).select("chunk_id", "article_id", "doc_id")


@query("stm5_message_rejects", f"""WITH {NEWS_SQL}
SELECT reason, count(*) AS n FROM (
  SELECT {REASON_SQL} AS reason FROM news UNION ALL SELECT 'invalid json' FROM news WHERE id % 97 = 0)
WHERE reason IS NOT NULL GROUP BY reason""")
def rejects(spark, sf_dir):
    """Bad messages end in a table beside the collection."""
    src, dst = _landed(spark, sf_dir), work_dir(spark, "collection")
    _stream(spark, src, dst, "live")
    return spark.read.parquet(f"{dst}/message_rejects").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
