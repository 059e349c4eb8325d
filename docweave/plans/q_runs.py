"""Call logs, run records, event logs and readiness checks; the events table serves as call and event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import query, table

CALLS_SQL = "calls AS (SELECT event_id, ts, event_type AS operation, 'm' || (user_id % 3) AS model, value AS seconds, CASE WHEN event_type = 'error' THEN 'failed' END AS error, user_id AS tokens FROM events)"


def calls_of(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("operation"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("seconds"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("user_id").alias("tokens"))


@query("agg11_call_summary", f"""WITH {CALLS_SQL} SELECT operation, count(*) AS n_calls, count(error) AS n_errors, round(sum(seconds), 2) AS total_s, round(max(seconds), 6) AS longest_s, round(avg(seconds), 4) AS mean_s,
  CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM calls GROUP BY operation""")  # fmt: skip
def call_summary(spark, d):
    return calls_of(spark, d).groupBy("operation").agg(
        F.count("*").alias("n_calls"), F.count("error").alias("n_errors"), F.round(F.sum("seconds"), 2).alias("total_s"), F.round(F.max("seconds"), 6).alias("longest_s"), F.round(F.avg("seconds"), 4).alias("mean_s"),
        F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


@query("agg12_running_totals", f"""WITH {CALLS_SQL} SELECT event_id, operation, count(*) OVER w AS completed, CAST(sum(tokens) OVER w AS BIGINT) AS tokens FROM calls WINDOW w AS (PARTITION BY operation, model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(spark, d):
    w = Window.partitionBy("operation", "model").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return calls_of(spark, d).select("event_id", "operation", F.count("*").over(w).alias("completed"), F.sum("tokens").over(w).alias("tokens"))


@query("agg23_run_table", """SELECT stem, version, CASE WHEN count(*) = 0 THEN '-' ELSE CAST(CAST(floor(100.0 * count(evidence_text) / count(*) + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS evidence, strftime(max(extracted_at), '%Y%m%dT%H%M%S') < '20220101T000000' AS before_fix
  FROM nodes GROUP BY stem, version""")  # fmt: skip
def run_table(spark, d):
    share = F.floor(100.0 * F.count("evidence_text") / F.count("*") + 0.5).cast("string")
    stamp = F.date_format(F.max("extracted_at"), "yyyyMMdd'T'HHmmss")
    return table(spark, d, "nodes").groupBy("stem", "version").agg(F.concat(share, F.lit("%")).alias("evidence"), (stamp < "20220101T000000").alias("before_fix"))


@query("msc06_phase_times", f"WITH {CALLS_SQL} SELECT operation AS phase, round(sum(seconds), 2) AS seconds FROM calls GROUP BY 1")
def phase_times(spark, d):
    return calls_of(spark, d).groupBy(F.col("operation").alias("phase")).agg(F.round(F.sum("seconds"), 2).alias("seconds"))


CEILINGS = [("m0", 8192), ("m1", 4096), ("m2", None)]
OPERATIONS = [("click", 1024), ("view", None), ("purchase", 6000), ("signup", 16384), ("error", None)]


@query("msc01_output_ceilings", """WITH m AS (SELECT * FROM (VALUES ('m0', 8192), ('m1', 4096), ('m2', NULL)) m(model, cap)), o AS (SELECT * FROM (VALUES ('click', 1024), ('view', NULL), ('purchase', 6000), ('signup', 16384), ('error', NULL)) o(operation, cap))
  SELECT model, operation, least(m.cap, o.cap) AS ceiling FROM (SELECT DISTINCT 'm' || (user_id % 3) AS model, event_type AS operation FROM events) JOIN m USING (model) JOIN o USING (operation)""")  # fmt: skip
def output_ceilings(spark, d):
    m = F.broadcast(spark.createDataFrame(CEILINGS, "model string, model_cap int"))
    o = F.broadcast(spark.createDataFrame(OPERATIONS, "operation string, own_cap int"))
    return calls_of(spark, d).select("model", "operation").distinct().join(m, "model").join(o, "operation").select("model", "operation", F.least("model_cap", "own_cap").alias("ceiling"))


@query("flt21_events_since", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def events_since(spark, d):
    return table(spark, d, "events").where("event_id > 500").select("event_id", "event_type")


@query("srt05_ring_buffer", "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS place FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100)")
def ring_buffer(spark, d):
    newest = table(spark, d, "events").orderBy(F.desc("event_id")).limit(100)
    return newest.select("event_id", "event_type", F.row_number().over(Window.orderBy("event_id")).cast("long").alias("place"))


@query("srt04_first_examples", "SELECT stem, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS examples FROM (SELECT stem, chunk_id, row_number() OVER (PARTITION BY stem ORDER BY chunk_id) AS k FROM chunks) WHERE k <= 5 GROUP BY stem")
def first_examples(spark, d):
    k = F.row_number().over(Window.partitionBy("stem").orderBy("chunk_id"))
    kept = table(spark, d, "chunks").select("stem", "chunk_id", k.alias("k")).where("k <= 5")
    return kept.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("examples"))


@query("srt06_table_order", "SELECT chunk_id, row_number() OVER (PARTITION BY stem ORDER BY line_start, section_index, chunk_id) AS place FROM chunks")
def table_order(spark, d):
    w = Window.partitionBy("stem").orderBy("line_start", "section_index", "chunk_id")
    return table(spark, d, "chunks").select("chunk_id", F.row_number().over(w).cast("long").alias("place"))


@query("msc03_readiness", """WITH c AS (SELECT DISTINCT stem FROM chunks), t AS (SELECT DISTINCT stem FROM chunks WHERE text <> ''), g AS (SELECT DISTINCT stem FROM nodes), v AS (SELECT DISTINCT stem FROM nodes WHERE version = 2), q AS (SELECT DISTINCT stem FROM goldenset),
  s AS (SELECT stem FROM c UNION SELECT lower(document_id) || '_raw' FROM samsung_life_term WHERE document_id IS NOT NULL),
  n AS (SELECT * FROM (VALUES ('generate', 'text'), ('schema', 'text'), ('schema', 'chunks'), ('reextract', 'chunks'), ('reextract', 'graph'), ('reextract', 'active version'), ('score', 'text'), ('score', 'golden set'), ('score', 'graph')) n(stage, need)),
  h AS (SELECT stem, 'text' AS need FROM t UNION ALL SELECT stem, 'chunks' FROM c UNION ALL SELECT stem, 'graph' FROM g UNION ALL SELECT stem, 'active version' FROM v UNION ALL SELECT stem, 'golden set' FROM q)
  SELECT stem, stage, 'no ' || need AS problem FROM s CROSS JOIN n ANTI JOIN h USING (stem, need)""")  # fmt: skip
def readiness(spark, d):
    """Documents of the catalogue and of the chunks; the second version counts as the active one."""
    chunks, nodes = table(spark, d, "chunks"), table(spark, d, "nodes")
    listed = table(spark, d, "samsung_life_term").where("document_id is not null").select(F.concat(F.lower("document_id"), F.lit("_raw")).alias("stem"))
    held = {"text": chunks.where("text <> ''"), "chunks": chunks, "graph": nodes, "active version": nodes.where("version = 2"), "golden set": table(spark, d, "goldenset")}
    return E.readiness(chunks.select("stem").union(listed), held)
