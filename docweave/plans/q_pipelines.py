"""Composite pipelines: search with context, extraction, scoring, refinement."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import discovery as D
from ..operators import evaluation as E
from ..operators import rewriting as W
from ..operators.search import Search, tiered_matches
from ..operators.spreading import sums_before
from ..shared import shared_folder
from . import pipelines as P
from .q_graph import GRAPH_SQL, edges_of, nodes_of
from .registry import query, table

#: (pos, type, keywords, property, operator, value), asked of every stem and version.
ANALYSIS = [(0, "Coverage", ["암"], None, None, None), (1, "Premium", [], "amount", "gte", "500"), (2, "Regulation", [], None, None, None)]
EDGE_TYPES = ["LIMITS", "EXCLUDES"]


def analysis_of(nodes):
    spark = nodes.sparkSession
    rows = spark.createDataFrame(ANALYSIS, "pos int, type string, keywords array<string>, property string, operator string, value string")
    scopes = nodes.select("stem", "version").distinct().withColumn("query_id", F.concat_ws("/", "stem", "version"))
    return scopes.crossJoin(F.broadcast(rows))


def edge_types_of(analysis):
    return analysis.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, EDGE_TYPES))).alias("type"))


def _search(spark, d):
    n = nodes_of(spark, d)
    analysis = analysis_of(n)
    return Search(n, edges_of(spark, d), analysis, edge_types_of(analysis), hops=1, least_confidence="LOW")


TIER_SQL = f"""{GRAPH_SQL}, hit AS (SELECT stem || '/' || version AS query_id, id, type, CASE
    WHEN type = 'Coverage' AND contains(lower(label), '암') THEN 1
    WHEN type = 'Premium' AND coalesce(try_cast(properties['amount'] AS DOUBLE) >= 500, false) THEN 2 ELSE 4 END AS tier FROM g WHERE type IN ('Coverage', 'Premium', 'Regulation')),
  best AS (SELECT query_id, type, min(tier) AS tier FROM hit GROUP BY ALL), m AS (SELECT query_id, id, tier FROM hit JOIN best USING (query_id, type, tier))"""


@query("pipe01_tiered_matches", f"WITH {TIER_SQL} SELECT query_id, id, tier FROM m")
def matches(spark, d):
    n = nodes_of(spark, d)
    return tiered_matches(n, analysis_of(n)).select("query_id", "id", "tier")


@query("pipe01_related_nodes", f"""WITH {TIER_SQL}, w AS (SELECT stem || '/' || version AS query_id, source, target FROM edges WHERE type IN ('LIMITS', 'EXCLUDES')),
  t AS (SELECT query_id, source, target FROM w WHERE (query_id, source) IN (SELECT query_id, id FROM m) OR (query_id, target) IN (SELECT query_id, id FROM m) OR query_id NOT IN (SELECT query_id FROM m)),
  s AS (SELECT query_id, id FROM m UNION SELECT query_id, source FROM t UNION SELECT query_id, target FROM t),
  r AS (SELECT query_id, id FROM s UNION SELECT w.query_id, w.target FROM w JOIN s ON w.query_id = s.query_id AND w.source = s.id UNION SELECT w.query_id, w.source FROM w JOIN s ON w.query_id = s.query_id AND w.target = s.id)
  SELECT DISTINCT r.query_id, r.id FROM r JOIN g ON r.id = g.id
  WHERE (g.confidence IS NULL OR g.confidence IN ('LOW', 'MEDIUM', 'HIGH')) AND g.stem || '/' || g.version IN (SELECT DISTINCT stem || '/' || version FROM nodes)""")  # fmt: skip
def related_nodes(spark, d):
    return _search(spark, d).related_nodes.select("query_id", "id").distinct()


CONTEXT_SQL = f"""{TIER_SQL}, w AS (SELECT stem || '/' || version AS query_id, source, target, type, detail, confidence FROM edges WHERE type IN ('LIMITS', 'EXCLUDES')),
  t AS (SELECT query_id, source, target FROM w WHERE (query_id, source) IN (SELECT query_id, id FROM m) OR (query_id, target) IN (SELECT query_id, id FROM m) OR query_id NOT IN (SELECT query_id FROM m)),
  s AS (SELECT query_id, id FROM m UNION SELECT query_id, source FROM t UNION SELECT query_id, target FROM t),
  r AS (SELECT query_id, id FROM s UNION SELECT w.query_id, w.target FROM w JOIN s ON w.query_id = s.query_id AND w.source = s.id UNION SELECT w.query_id, w.source FROM w JOIN s ON w.query_id = s.query_id AND w.target = s.id),
  asked AS (SELECT DISTINCT stem || '/' || version AS query_id FROM g), reached AS (SELECT r.* FROM r SEMI JOIN asked USING (query_id)),
  nl AS (SELECT reached.query_id, CASE WHEN (reached.query_id, g.id) IN (SELECT query_id, id FROM m) THEN CASE type WHEN 'Coverage' THEN 0 WHEN 'Premium' THEN 1 ELSE 2 END ELSE 1073741824 END AS rank, g.id,
    '- ' || label || ' (' || coalesce(type, '') || ')' || CASE WHEN length(detail) > 0 THEN ': ' || detail ELSE '' END || CASE WHEN evidence_text IS NULL AND source_section IS NULL THEN '' ELSE ' [' || concat_ws('; ', '근거: ' || evidence_text, '출처: ' || source_section) || ']' END AS line
    FROM reached JOIN g USING (id) WHERE confidence IS NULL OR confidence IN ('LOW', 'MEDIUM', 'HIGH')),
  el AS (SELECT DISTINCT w.query_id, concat_ws('|', w.type, source, target) AS key, '- ' || x.label || ' --' || w.type || '--> ' || y.label || CASE WHEN length(w.detail) > 0 THEN ': ' || w.detail ELSE '' END AS line
    FROM w JOIN reached a ON a.query_id = w.query_id AND a.id = source JOIN reached b ON b.query_id = w.query_id AND b.id = target JOIN g x ON x.id = source JOIN g y ON y.id = target WHERE w.confidence IS NULL OR w.confidence IN ('LOW', 'MEDIUM', 'HIGH')),
  en AS (SELECT query_id, 'Entities:' || chr(10) || string_agg(line, chr(10) ORDER BY rank, id, line) AS text FROM nl GROUP BY query_id), rl AS (SELECT query_id, 'Relations:' || chr(10) || string_agg(line, chr(10) ORDER BY key, line) AS text FROM el GROUP BY query_id)"""


@query("pipe01_search_context", f"WITH {CONTEXT_SQL} SELECT query_id, concat_ws(chr(10) || chr(10), en.text, rl.text) AS context FROM en FULL JOIN rl USING (query_id)")
def search_context(spark, d):
    return _search(spark, d).context()


@query("pipe04_extracted_versions", """WITH c AS (SELECT chunk_id, text, section_label, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY stem ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM chunks),
  n AS (SELECT n.stem, n.version, n.id, n.type, n.label, node_no, CASE WHEN confidence IN ('HIGH', 'MEDIUM', 'LOW') THEN confidence END AS confidence,
    CASE WHEN evidence_text <> '' AND strpos(c.text, evidence_text) > 0 THEN evidence_text END AS evidence_text, CASE WHEN evidence_text <> '' AND strpos(c.text, evidence_text) > 0 THEN CAST(base + strpos(c.text, evidence_text) - 1 AS BIGINT) END AS start,
    CASE WHEN list_contains(regexp_extract_all('[' || c.section_label || ']' || chr(10) || c.text, '(?m)^\\[(.+)\\]$', 1), source_section) THEN source_section END AS source_section,
    CASE WHEN properties IS NOT NULL AND list_contains(map_keys(properties), 'amount') THEN coalesce(properties['amount'], '') END AS amount
    FROM nodes n LEFT JOIN c USING (chunk_id) WHERE n.id <> '' AND n.label <> '' AND n.type <> ''),
  kept AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY stem, version, type, label ORDER BY node_no) = 1),
  idm AS (SELECT n.stem, n.version, n.id, arg_max(k.id, n.node_no) AS kept_id FROM n JOIN kept k USING (stem, version, type, label) GROUP BY ALL),
  e AS (SELECT DISTINCT e.stem, e.version, a.kept_id AS source, b.kept_id AS target, e.type FROM edges e JOIN idm a ON e.stem = a.stem AND e.version = a.version AND e.source = a.id
    JOIN idm b ON e.stem = b.stem AND e.version = b.version AND e.target = b.id WHERE source <> '' AND target <> '' AND e.type <> ''),
  o AS (SELECT stem, version, source AS id, count(*) AS n_out FROM e GROUP BY ALL)
  SELECT stem, version, id, type, label, confidence, evidence_text, start, start + length(evidence_text) AS "end", source_section, amount, coalesce(n_out, 0) AS n_out FROM kept LEFT JOIN o USING (stem, version, id)""")  # fmt: skip
def extracted_versions(spark, d):
    """Group replies of every stem and version: declared properties, known sections, evidence verified and anchored in the document, merged."""
    chunks = table(spark, d, "chunks")
    sized = chunks.select("chunk_id", "stem", (F.length(F.coalesce("text", F.lit(""))) + 2).alias("n"))
    bases = sums_before(sized, "stem", "chunk_id", "n", "base").select(F.col("chunk_id").alias("text_id"), "base")
    texts = chunks.select(F.col("chunk_id").alias("text_id"), "text", F.concat(F.lit("["), "section_label", F.lit("]\n"), "text").alias("headed")).join(bases, "text_id")
    n = table(spark, d, "nodes").select("stem", "version", "id", "type", "label", "confidence", "evidence_text", "source_section", "properties", F.col("chunk_id").alias("text_id"), F.col("node_no").alias("seq"))
    e = edges_of(spark, d).select("stem", "version", "source", "target", "type", F.col("edge_no").alias("seq"))
    merged, edges = W.extracted(n, e, texts, {"amount": "amount"}, ["stem", "version"], "seq")
    ends = edges.groupBy("stem", "version", F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    amount = F.try_element_at("properties", F.lit("amount")).alias("amount")
    counted = merged.join(ends, ["stem", "version", "id"], "left")
    return counted.select("stem", "version", "id", "type", "label", "confidence", "evidence_text", "start", "end", "source_section", amount, F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query("pipe10_document_scores")
def document_scores(spark, d):
    """All scores of PIPE-10, of every document; pipe10_chunking_scores counts the delivered chunks only."""
    return K.chunking_scores(table(spark, d, "documents"))


@query("udf01_group_budget_report", """WITH c AS (SELECT stem, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM chunks GROUP BY stem) SELECT stem, n, CAST(chars AS BIGINT) AS chars FROM c""")
def group_budget_report(spark, d):
    """Chunks and characters that the groups of a document carry; packing loses none."""
    chunks = table(spark, d, "chunks")
    groups = K.packed_groups(chunks, "stem", "chunk_id", 3000)
    joined = groups.join(chunks.select("stem", "chunk_id", F.length(F.coalesce("text", F.lit(""))).alias("k")), ["stem", "chunk_id"])
    return joined.groupBy("stem").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("chars"))


@query("pipe02_discovered", """WITH n AS (SELECT n.stem, n.chunk_id, node_no, label, type, confidence FROM nodes n JOIN chunks c ON c.chunk_id = n.chunk_id AND c.stem = n.stem WHERE label <> '' AND type <> ''),
  i AS (SELECT stem, 'attributes' AS field, label || '|' || type AS item, min((chunk_id, node_no)) AS place FROM n GROUP BY ALL
    UNION ALL SELECT stem, 'terminology', label, min((chunk_id, node_no)) FROM n GROUP BY ALL UNION ALL SELECT stem, 'warnings', type, min((chunk_id, node_no)) FROM n GROUP BY ALL)
  SELECT stem, field, row_number() OVER (PARTITION BY stem, field ORDER BY place) AS position, item FROM i
  UNION ALL SELECT stem, 'domain', 1, arg_min(label, (chunk_id, node_no)) FROM n GROUP BY stem""")  # fmt: skip
def discovered(spark, d):
    """Chunks packed to groups of 12,000 characters, a report for each made of what was extracted there, the reports reduced to one a document."""
    chunks = table(spark, d, "chunks")
    groups = K.packed_groups(chunks, "stem", "chunk_id", 12_000)
    n = table(spark, d, "nodes").where("label <> '' and type <> ''").select("stem", "chunk_id", "node_no", "label", "type")
    own = n.join(groups, ["stem", "chunk_id"]).groupBy("stem", "group_index").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "node_no", "label", "type"))).alias("n"))
    report = F.struct(
        F.struct(F.get("n", F.lit(0))["label"].alias("domain")).alias("domain_model"),
        F.transform("n", lambda x: F.struct(x["label"].alias("name"), x["type"].alias("defined_on"))).alias("attributes"),
        F.transform("n", lambda x: F.struct(x["label"].alias("canonical_term"))).alias("terminology"),
        F.transform("n", lambda x: x["type"]).alias("warnings"),
    )
    reduced = D.reduced_reports(own.select("stem", "group_index", F.to_json(report).alias("report")), ["stem"], "group_index")
    told = F.when(F.col("field") == "attributes", F.concat_ws("|", F.get_json_object("item", "$.name"), F.get_json_object("item", "$.defined_on"))).when(F.col("field") == "terminology", F.get_json_object("item", "$.canonical_term"))
    return reduced.select("stem", "field", "position", F.coalesce(told, "item").alias("item"))


def _schema_model(operation: str, prompt: str) -> str:
    """A deterministic stand-in: a type named by a group's length; consolidation keeps the first of equal names."""
    if operation == "generate_schema":
        return json.dumps({"node_types": [{"name": f"T{len(prompt) % 5}", "description": "d"}], "edge_types": []})
    names = dict.fromkeys(t["name"] for s in json.loads(prompt) for t in json.loads(s)["node_types"])
    return "```json\n" + json.dumps({"node_types": [{"name": n} for n in names], "edge_types": []}) + "\n```"


@query("pipe03_document_schemas", """WITH RECURSIVE c AS (SELECT stem, chunk_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY stem ORDER BY chunk_id) AS k FROM chunks),
  p AS (SELECT stem, chunk_id, k, 1 AS g, n AS used FROM c WHERE k = 1
    UNION ALL SELECT c.stem, c.chunk_id, c.k, CASE WHEN p.used + c.n > 12000 THEN p.g + 1 ELSE p.g END, CASE WHEN p.used + c.n > 12000 THEN c.n ELSE p.used + c.n END FROM p JOIN c ON c.stem = p.stem AND c.k = p.k + 1),
  t AS (SELECT stem, g, length(string_agg(CASE WHEN length(path) > 0 THEN '[' || path || ']' || chr(10) ELSE '' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_id)) AS n FROM p JOIN chunks USING (stem, chunk_id) GROUP BY ALL),
  f AS (SELECT stem, 'T' || (n % 5) AS name, min(g) AS first FROM t GROUP BY ALL)
  SELECT stem, 'node_type' AS kind, row_number() OVER (PARTITION BY stem ORDER BY first) - 1 AS pos, name FROM f""")  # fmt: skip
def document_schemas(spark, d):
    """Groups of 12,000 characters asked for a schema each, consolidated to one a document."""
    made = P.schema_for_documents(table(spark, d, "chunks"), _schema_model, shared_folder(spark, "schemas"))
    return made.select("stem", "kind", F.col("pos").cast("long").alias("pos"), "name")


@query("pipe05_proposed_changes", """SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY edge_no) - 1 AS seq, CASE WHEN confidence = 'LOW' THEN 'DEPRECATE' ELSE 'ADD' END AS decision, type AS element FROM edges WHERE type IS NOT NULL AND version = (SELECT max(version) FROM edges x WHERE x.stem = edges.stem)""")
def proposed_changes(spark, d):
    """Proposals made of the newest edges of a document, read from fenced replies."""
    e = table(spark, d, "edges")
    newest = e.groupBy("stem").agg(F.max("version").alias("version"))
    change = F.struct(F.col("edge_no"), F.when(F.col("confidence") == "LOW", "DEPRECATE").otherwise("ADD").alias("decision"), F.lit("edge").alias("element_type"), F.struct("type").alias("element"))
    listed = e.where("type is not null").join(newest, ["stem", "version"], "left_semi").groupBy("stem").agg(F.array_sort(F.collect_list(change)).alias("changes"))
    replies = listed.select(F.col("stem").alias("key"), F.concat(F.lit("```json\n"), F.to_json(F.struct("changes")), F.lit("\n```")).alias("reply"))
    rows = P.proposed_changes(replies)
    return rows.select(F.col("key").alias("stem"), F.col("seq").cast("long").alias("seq"), "decision", F.get_json_object("element", "$.type").alias("element"))


@query("pipe08_golden_sets", """WITH g AS (SELECT stem, quote_id, question, CASE WHEN question_type IN ('entity', 'attribute', 'relation', 'multi_hop', 'list', 'boolean', 'unanswerable') THEN question_type ELSE 'entity' END AS question_type, answer, answerable, quote, chunk_id FROM goldenset WHERE question <> ''),
  c AS (SELECT g.*, coalesce(quote <> '' AND contains(t.text, quote), false) AS good FROM g LEFT JOIN (SELECT stem, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_id) AS text FROM chunks GROUP BY stem) t USING (stem)),
  k AS (SELECT stem, arg_min(quote_id, quote_id) AS quote_id FROM (SELECT stem, quote_id, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS key FROM c) GROUP BY stem, key)
  SELECT c.stem, 'q' || CASE WHEN row_number() OVER w < 1000 THEN lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER w AS VARCHAR) END AS new_id, coalesce(answerable, false) AND good AS answerable, CASE WHEN good THEN quote END AS evidence
  FROM k JOIN c USING (stem, quote_id) WINDOW w AS (PARTITION BY c.stem ORDER BY quote_id)""")  # fmt: skip
def golden_sets(spark, d):
    """Delivered questions as generated ones, each with its own answer, checked against the text of the document."""
    g = table(spark, d, "goldenset").where("question <> ''")
    kind = F.when(F.col("question_type").isin(*E.QUESTION_TYPES), F.col("question_type")).otherwise("entity")
    questions = g.select("stem", F.col("quote_id").alias("position"), F.col("quote_id").cast("string").alias("id"), "question", kind.alias("question_type"))
    answers = g.select("stem", F.col("quote_id").cast("string").alias("id"), F.lit(0).alias("seq"), "answer", "answerable", "quote")
    documents = table(spark, d, "chunks").select("stem", F.col("chunk_id").alias("part"), "text")
    made = P.golden_sets(questions, answers, documents, questions.groupBy("stem").agg(F.count("*").alias("n")))
    return made.select("stem", "new_id", "answerable", "evidence")


VECTOR_SQL = f"""{GRAPH_SQL}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0),
  s AS (SELECT stem || '/' || version AS query_id, id, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM g JOIN v ON v.vec_id = g.node_no CROSS JOIN q WHERE type = 'Regulation'),
  near AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 5 AND score >= 0.05)"""


@query("pipe01_vector_tier", f"""WITH {VECTOR_SQL} SELECT query_id, id, 3 AS tier FROM near UNION ALL SELECT stem || '/' || version, id, 4 FROM g WHERE type = 'Regulation' AND stem || '/' || version NOT IN (SELECT query_id FROM near)""")
def vector_tier(spark, d):
    """Questions that neither keywords nor a property answer, by the vectors that the first nodes of the table have."""
    n = nodes_of(spark, d)
    analysis = analysis_of(n).where("type = 'Regulation'")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    vectors = n.select("id", "node_no").join(e, F.col("vec_id") == F.col("node_no")).select("id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id = 0").select(F.col("embedding").alias("vector"))
    questions = analysis.select("query_id").distinct().withColumn("k", F.lit(0)).join(asked.withColumn("k", F.lit(0)), "k").select("query_id", "vector")
    return tiered_matches(n, analysis, vectors, questions, min_score=0.05).select("query_id", "id", "tier")
