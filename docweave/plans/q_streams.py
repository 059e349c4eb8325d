"""Streaming queries, each run to the end of its input, and their batch equivalents as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import shared_folder
from ..streaming import progress as P
from .registry import query, table


def _events(spark, d):
    return P.parquet_stream(spark, d, "events")


@query("stm01_running_totals", """SELECT event_type AS operation, count(*) AS completed, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 2) AS seconds, CAST(sum(user_id) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def running_totals(spark, d):
    calls = _events(spark, d).select(F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("seconds"), F.col("user_id").alias("tokens"))
    return P.finished(P.running_totals(calls, "operation"), shared_folder(spark, "totals"), "complete")


@query("stm01_group_progress", """WITH g AS (SELECT stem, 'extract' AS stage, sha256(text) AS f, text FROM chunks WHERE text IS NOT NULL), c AS (SELECT DISTINCT sha256(text) AS f FROM chunks WHERE chunk_id % 2 = 0),
  t AS (SELECT stem, stage, count(*) AS total, count(*) FILTER (f IN (SELECT f FROM c)) AS completed FROM g GROUP BY ALL)
  SELECT *, CASE WHEN completed = 0 THEN 'idle' WHEN completed < total THEN 'running' ELSE 'done' END AS status FROM t""")  # fmt: skip
def group_progress(spark, d):
    g = table(spark, d, "chunks").where("text is not null").select("stem", "chunk_id", F.lit("extract").alias("stage"), F.sha2("text", 256).alias("fingerprint"))
    return P.progress(g, g.where("chunk_id % 2 = 0"))


@query("stm02_event_cursor", "SELECT event_id FROM events WHERE event_id > 900")
def event_cursor(spark, d):
    return P.finished(P.since(_events(spark, d), 900).select("event_id"), shared_folder(spark, "cursor"))


@query("stm03_resumed_groups", "SELECT DISTINCT sha256(text) AS fingerprint, length(text) AS n_chars FROM chunks WHERE text IS NOT NULL")
def resumed_groups(spark, d):
    """Every text is worked on once: a first run takes half of the rows, a second one all of them."""
    chunks = table(spark, d, "chunks").where("text is not null").select("chunk_id", F.sha2("text", 256).alias("fingerprint"), F.length("text").cast("long").alias("n_chars"))
    cache = shared_folder(spark, "resume")
    step = P.new_items(chunks, cache, "fingerprint", lambda df: df.select("fingerprint", "n_chars"))
    step(chunks.where("chunk_id % 2 = 0"), 0)
    step(chunks, 1)
    return spark.read.parquet(cache)


@query("stm05_answer_log", "SELECT stem, id, arg_max(quote_id, quote_id) AS quote_id FROM goldenset GROUP BY ALL")
def answer_log(spark, d):
    """Answers appended in two runs; the last one appended counts."""
    log = shared_folder(spark, "answers")
    g = table(spark, d, "goldenset").select("stem", "id", "quote_id")
    g.where("quote_id % 2 = 0").write.parquet(log)
    g.where("quote_id % 2 = 1").write.mode("append").parquet(log)
    return spark.read.parquet(log).groupBy("stem", "id").agg(F.max("quote_id").alias("quote_id"))


@query("stx_tumbling_counts", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start_at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    got = P.finished(P.tumbling_counts(_events(spark, d), "1 hour", "1 hour"), shared_folder(spark, "tumbling"), "complete")
    return got.withColumn("start_at", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss"))


@query("stx_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_at, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def sessions(spark, d):
    got = P.finished(P.sessions(_events(spark, d), "30 minutes", "1 hour"), shared_folder(spark, "sessions"), "complete")
    return got.select("user_id", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "n")


@query("stx_deduplicated", "SELECT DISTINCT event_id FROM events")
def deduplicated(spark, d):
    return P.finished(P.deduplicated(_events(spark, d), ["event_id"], "1 hour").select("event_id"), shared_folder(spark, "dedup"))
