"""Store, file and catalogue source queries: each writes to the shared folder, reads back and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..shared import shared_folder
from ..sources import files as X
from ..sources.store import GraphStore, with_envelope
from .providers import OPERATIONS, map_concurrently, run_groups, unbundled, with_fingerprints
from .q_graph import STORED_SQL, storable
from .registry import query, table

SPACE = r"[\s\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CLEAN_SQL = f"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), '(?m) +$', '', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"


@query("src14_written_graph", f"WITH {STORED_SQL} SELECT 'node' AS kind, stem, version, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', stem, version, count(*) FROM e GROUP BY ALL")
def written_graph(spark, d):
    store = GraphStore(spark, shared_folder(spark, "graph"))
    n, e = storable(spark, d)
    store.write_graphs(n, e)
    count = lambda rows, kind: rows.groupBy("stem", "version").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "stem", "version", "n")
    return count(store.nodes(), "node").union(count(store.edges(), "edge"))


@query("src08_markdown_scan", "SELECT stem || '.md' AS name, CAST(sum(length(coalesce(text, '')) + 2) - 2 AS BIGINT) AS n_chars FROM chunks GROUP BY stem")
def markdown_scan(spark, d):
    """Documents written as text and scanned again by name."""
    chunks = table(spark, d, "chunks")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    folder = shared_folder(spark, "markdown")
    chunks.groupBy("stem").agg(F.array_join(ordered, "\n\n").alias("text")).write.parquet(folder)
    return spark.read.parquet(folder).select(F.concat("stem", F.lit(".md")).alias("name"), F.length("text").cast("long").alias("n_chars"))


@query("src26_jsonl_sink", "SELECT quote_id, question, answer FROM goldenset")
def jsonl_sink(spark, d):
    folder = shared_folder(spark, "jsonl")
    X.write_jsonl(table(spark, d, "goldenset").select("quote_id", "question", "answer"), folder)
    return spark.read.schema("quote_id long, question string, answer string").json(folder)


@query("src27_run_tables", "SELECT '| type | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || coalesce(type, '-') || ' | ' || n || ' |', chr(10) ORDER BY type NULLS FIRST) AS \"table\" FROM (SELECT type, count(*) AS n FROM edges GROUP BY type)")
def run_tables(spark, d):
    counts = table(spark, d, "edges").groupBy("type").agg(F.count("*").alias("n"))
    return X.markdown_table(counts, ["type", "n"], "type")


@query("src28_migrated_ids", "SELECT node_no, string_split(id, '::')[-1] AS original_id FROM nodes")
def migrated_ids(spark, d):
    """Rows of a layout without original ids; the number rides along in the detail."""
    old = table(spark, d, "nodes").select("id", "label", "type", F.col("node_no").cast("string").alias("detail"), "stem", "version")
    return with_envelope(old).select(F.col("detail").cast("long").alias("node_no"), "original_id")


def echo_provider(operation: str, prompt: str) -> str:
    """A deterministic stand-in for a model: one node named by the first characters of the text."""
    import json

    return "```json\n" + json.dumps({"nodes": [{"id": "n1", "label": prompt[:12], "type": "Clause"}], "edges": []}, ensure_ascii=False) + "\n```"


@query("mdl_extract_replies", "SELECT DISTINCT sha256(text) AS digest, left(text, 12) AS label, 'Clause' AS type FROM chunks WHERE length(text) > 0")
def extract_replies(spark, d):
    """Texts through the resumable map with a deterministic provider, the replies parsed to nodes."""
    groups = table(spark, d, "chunks").where("length(text) > 0").select("text").distinct()
    groups = with_fingerprints(groups, OPERATIONS["extract_graph"], "extract", {}, "echo")
    got = run_groups(groups, echo_provider, OPERATIONS["extract_graph"], shared_folder(spark, "replies"), at_once=8)
    bare = got.withColumn("reply", F.regexp_extract("reply", r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    return unbundled(bare, "nodes").select(F.sha2("text", 256).alias("digest"), "label", "type")




@query("flt19_file_search", "SELECT DISTINCT stem FROM chunks WHERE contains(lower(stem || '.md'), '02_raw')")
def file_search(spark, d):
    """Case-insensitive part of a file name; a blank part gives all."""
    return table(spark, d, "chunks").select("stem").distinct().where(F.contains(F.lower(F.concat("stem", F.lit(".md"))), F.lower(F.lit("02_RAW"))))


@query("src17_deleted_version", f"WITH {STORED_SQL} SELECT stem, version, count(*) AS n FROM n WHERE version <> 2 GROUP BY ALL")
def deleted_version(spark, d):
    """Second versions deleted leave the others."""
    store = GraphStore(spark, shared_folder(spark, "graph"))
    n, e = storable(spark, d)
    store.write_graphs(n, e)
    store.delete_graphs(n.where("version = 2"))
    return store.nodes().groupBy("stem", "version").agg(F.count("*").alias("n"))


@query("src20_table_columns", """SELECT 'edges' AS name, unnest(['source', 'target', 'type', 'detail', 'confidence', 'stem', 'version', 'write_id']) AS column_name
  UNION ALL SELECT 'extracted', unnest(['stem', 'version', 'nodes_write', 'edges_write', 'deleted', 'marked'])
  UNION ALL SELECT 'nodes', unnest(['id', 'original_id', 'label', 'type', 'detail', 'properties', 'confidence', 'evidence_text', 'start_offset', 'end_offset', 'source_section', 'valid_from', 'valid_to', 'embedding', 'stem', 'version', 'write_id'])""")  # fmt: skip
def table_columns(spark, d):
    """The catalogue of a store after a graph is written: its tables and their columns."""
    store = GraphStore(spark, shared_folder(spark, "graph"))
    store.write_graphs(*storable(spark, d))
    return spark.createDataFrame([(n, c) for n, columns in store.table_columns().items() for c in columns], "name string, column_name string")


@query("src22_schema_versions", """WITH v AS (SELECT stem, count(DISTINCT version) AS c FROM nodes WHERE stem IS NOT NULL GROUP BY stem), r AS (SELECT stem, c, unnest(range(1, c + 1)) AS version FROM v)
  SELECT stem, version, CASE WHEN c > 2 THEN version = 1 WHEN c = 2 THEN version = 1 ELSE true END AS is_active FROM r WHERE c <> 2 OR version <> 2""")  # fmt: skip
def schema_versions(spark, d):
    """As many versions created as a document has; of three or more the first is activated, of two the second, active one is deleted."""
    v = G.checkpointed(table(spark, d, "nodes").where("stem is not null").groupBy("stem").agg(F.countDistinct("version").alias("c")))
    store = GraphStore(spark, shared_folder(spark, "versions"))
    for k in range(1, (v.agg(F.max("c")).first()[0] or 0) + 1):
        store.create_schema_versions(v.where(F.col("c") >= k).select("stem", F.lit("general").alias("document_type"), F.lit(str(k)).alias("digest")))
    store.activate_versions(v.where("c > 2").select("stem", F.lit(1).cast("long").alias("version")))
    store.delete_schema_versions(v.where("c = 2").select("stem", F.col("c").alias("version")))
    return store.schema_versions().select("stem", "version", "is_active")


@query("src24_manifests", "SELECT DISTINCT stem, stem || '.md' AS original_filename, 'converter' AS converter FROM chunks WHERE stem IN (SELECT stem FROM nodes)")
def manifests(spark, d):
    """Manifests created, then updated in one field; documents without a graph are deleted again."""
    stems = table(spark, d, "chunks").select("stem").distinct()
    store = GraphStore(spark, shared_folder(spark, "manifests"))
    store.save_manifests(stems.withColumn("original_filename", F.concat("stem", F.lit(".md"))))
    store.save_manifests(stems.withColumn("converter", F.lit("converter")))
    store.delete_documents(stems.join(table(spark, d, "nodes").select("stem").distinct(), "stem", "left_anti"))
    return store.manifests()


@query("src25_changed_sets", "SELECT stem FROM goldenset GROUP BY stem HAVING count(*) FILTER (answerable) > 0 AND count(*) FILTER (NOT coalesce(answerable, false)) > 0")
def changed_sets(spark, d):
    """Answerable questions saved first and all of them later: the sets that differ are archived."""
    q = table(spark, d, "goldenset").select("stem", "quote_id", "question", "answer", "answerable")
    store = GraphStore(spark, shared_folder(spark, "goldenset"))
    store.save_goldensets(q.where("answerable"))
    return store.save_goldensets(q)


@query("udf05_mapped_in_order", "SELECT chunk_id, CAST(length(text) AS VARCHAR) AS reply FROM chunks WHERE length(text) > 0")
def mapped_in_order(spark, d):
    """A function over all texts, at most five calls in flight; results come back to their items."""
    items = table(spark, d, "chunks").where("length(text) > 0").select("chunk_id", "text")
    return map_concurrently(items, "chunk_id", "text", lambda text: str(len(text)), at_once=5)


@query("str02_markdown_text", f"""WITH c AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents WHERE text IS NOT NULL),
  l AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS k, regexp_replace(unnest(string_split(t, chr(10))), '^{SPACE}+|{SPACE}+$', '', 'g') AS line FROM c),
  t AS (SELECT doc_id, k, CASE WHEN line = '' OR regexp_full_match(line, '[-–—]?\\s*\\d+\\s*[-–—]?|\\d+\\s*/\\s*\\d+') THEN [''] WHEN regexp_matches(line, '^제\\s*\\d+\\s*[장편관]($|[^\\p{{L}}\\p{{N}}_])') THEN ['## ' || line, '']
    WHEN regexp_full_match(line, '제\\s*\\d+\\s*조(\\s*의\\s*\\d+)?(\\s*[(\\[][^)\\]]*[)\\]])?\\s*') THEN ['### ' || line, ''] WHEN regexp_matches(line, '^[①-⑳]') THEN ['', line]
    WHEN regexp_matches(line, '^(㈜\\s*)?\\d+\\.\\s+\\S') THEN ['- ' || line] WHEN regexp_matches(line, '^[●■◆▶▣□◦ㆍ∙]') THEN ['- ' || regexp_replace(line, '^[●■◆▶▣□◦ㆍ∙]\\s*', '')] ELSE [line] END AS tokens FROM l),
  u AS (SELECT doc_id, k, generate_subscripts(tokens, 1) AS j, unnest(tokens) AS token FROM t), w AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY k, j), '') AS before FROM u)
  SELECT doc_id, sha256(rtrim(coalesce(string_agg(token, chr(10) ORDER BY k, j) FILTER (token <> '' OR before <> ''), ''), chr(10))) AS digest FROM w GROUP BY doc_id""")  # fmt: skip
def markdown_text(spark, d):
    """Whole texts as Markdown: headings, lists and paragraphs of circled numbers; page numbers and runs of blanks go."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.markdown_lines(F.col("text")).alias("lines"))
    return rows.select("doc_id", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


@query("src12_document_list", """WITH t AS (SELECT stem, max(loaded_at) AS m FROM chunks GROUP BY stem), p AS (SELECT lower(document_id) || '_raw' AS stem, max(loaded_at) AS m FROM samsung_life_term WHERE document_id IS NOT NULL GROUP BY 1)
  SELECT stem, t.stem IS NOT NULL AS has_text, p.stem IS NOT NULL AS has_pdf, stem IN (SELECT stem FROM nodes) AS has_graph, strftime(greatest(t.m, p.m), '%Y-%m-%d %H:%M:%S') AS modified_at FROM t FULL JOIN p USING (stem)""")  # fmt: skip
def document_list(spark, d):
    """Documents with text and those with a catalogue entry only, newest first."""
    t = table(spark, d, "chunks").groupBy("stem").agg(F.max("loaded_at").alias("t"))
    p = table(spark, d, "samsung_life_term").where("document_id is not null").groupBy(F.concat(F.lower("document_id"), F.lit("_raw")).alias("stem")).agg(F.max("loaded_at").alias("p"))
    g = table(spark, d, "nodes").select("stem").distinct().withColumn("g", F.lit(True))
    both = t.join(p, "stem", "full_outer").join(g, "stem", "left").withColumn("m", F.greatest("t", "p")).orderBy(F.desc("m"), "stem")
    return both.select("stem", F.col("t").isNotNull().alias("has_text"), F.col("p").isNotNull().alias("has_pdf"), F.col("g").isNotNull().alias("has_graph"), F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("modified_at"))
