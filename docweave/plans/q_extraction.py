"""Verification, merging and rewriting of extracted graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import refinement as R
from ..operators import rewriting as W
from ..operators.spreading import sums_before
from ..shared import shared_folder
from ..sources.store import GraphStore
from .providers import parsed_replies
from .q_graph import GRAPH_SQL, STORED_SQL, edges_of, nodes_of, storable
from .registry import query, table

SCOPE = ["stem", "version"]
#: A reviewed merge mapping: (kind, old, new); no new type removes the old one.
MAPPING = [("node_type", "Coverage", "Benefit"), ("node_type", "Rider", "InsuranceProduct"), ("node_type", "Document", None), ("edge_type", "LIMITS", "EXCLUDES"), ("edge_type", "REQUIRES", None)]
MAPPING_SQL = "map AS (SELECT * FROM (VALUES {}) m(kind, old, new))".format(
    ", ".join(f"('{k}', '{o}', {'NULL' if n is None else repr(n)})" for k, o, n in MAPPING)
)


def _mapping(spark):
    return spark.createDataFrame(MAPPING, "kind string, old string, new string")


def _cited(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", "text", "section_label")
    return table(spark, d, "nodes").select("node_no", "chunk_id", "stem", "evidence_text", "source_section").join(texts, "chunk_id")


@query("flt06_complete_items", """SELECT 'node' AS kind, node_no AS no FROM nodes WHERE id <> '' AND label <> '' AND type <> ''
  UNION ALL SELECT 'edge', edge_no FROM edges WHERE source <> '' AND target <> '' AND type <> ''""")  # fmt: skip
def complete_items(spark, d):
    n = table(spark, d, "nodes").where(W.filled("id", "label", "type")).select(F.lit("node").alias("kind"), F.col("node_no").alias("no"))
    return n.union(table(spark, d, "edges").where(W.filled("source", "target", "type")).select(F.lit("edge"), "edge_no"))


@query("flt09_declared_properties", """SELECT node_no, 'Amount=' || coalesce(properties['amount'], '') AS held FROM nodes
  WHERE properties IS NOT NULL AND list_contains(map_keys(properties), 'amount')""")  # fmt: skip
def declared_properties(spark, d):
    kept = table(spark, d, "nodes").select("node_no", W.declared_properties(F.col("properties"), {"amount": "Amount"}).alias("p")).where("size(p) > 0")
    return kept.select("node_no", F.array_join(F.transform(F.array_sort(F.map_entries("p")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("held"))


@query("flt10_known_confidence", "SELECT node_no, CASE WHEN confidence IN ('HIGH', 'MEDIUM', 'LOW') THEN confidence END AS confidence FROM nodes")
def known_confidence(spark, d):
    return table(spark, d, "nodes").select("node_no", W.known_confidence(F.col("confidence")).alias("confidence"))


@query("flt11_verified_evidence", """SELECT node_no, CASE WHEN evidence_text <> '' AND strpos(c.text, evidence_text) > 0 THEN evidence_text END AS evidence_text,
  CASE WHEN evidence_text <> '' AND strpos(c.text, evidence_text) > 0 THEN strpos(c.text, evidence_text) - 1 END AS start_offset,
  CASE WHEN evidence_text <> '' AND strpos(c.text, evidence_text) > 0 THEN strpos(c.text, evidence_text) - 1 + length(evidence_text) END AS end_offset
  FROM nodes JOIN chunks c USING (chunk_id)""")  # fmt: skip
def verified_evidence(spark, d):
    found = _cited(spark, d).withColumn("s", W.evidence_span(F.col("evidence_text"), F.col("text")))
    return found.select("node_no", F.when(F.col("s").isNotNull(), F.col("evidence_text")).alias("evidence_text"), F.col("s.start").alias("start_offset"), F.col("s.end").alias("end_offset"))


@query("flt12_known_sections", """SELECT node_no, source_section FROM nodes n JOIN chunks c USING (chunk_id)
  WHERE list_contains(regexp_extract_all('[' || c.section_label || ']' || chr(10) || c.text, '(?m)^\\[(.+)\\]$', 1), source_section)""")  # fmt: skip
def known_sections(spark, d):
    text = F.concat(F.lit("["), "section_label", F.lit("]\n"), "text")
    return _cited(spark, d).where(F.array_contains(W.section_labels(text), F.col("source_section"))).select("node_no", "source_section")


MERGE_SQL = """kept AS (SELECT stem, version, type, label, arg_min(id, node_no) AS kept_id, min(node_no) AS node_no FROM nodes GROUP BY ALL),
  idm AS (SELECT n.stem, n.version, n.id, arg_max(k.kept_id, n.node_no) AS kept_id FROM nodes n JOIN kept k ON n.stem = k.stem AND n.version = k.version
    AND n.type IS NOT DISTINCT FROM k.type AND n.label IS NOT DISTINCT FROM k.label GROUP BY ALL)"""


def _merged(spark, d):
    n = table(spark, d, "nodes").select(*SCOPE, "id", "type", "label", "detail", "node_no").withColumn("seq", F.col("node_no"))
    e = edges_of(spark, d).select(*SCOPE, "source", "target", "type", "edge_no").withColumn("seq", F.col("edge_no"))
    return W.merge_groups(n, e, SCOPE, "seq")


@query("set02_merged_nodes", f"WITH {MERGE_SQL} SELECT kept_id AS id, type, label, node_no FROM kept")
def merged_nodes(spark, d):
    return _merged(spark, d)[0].select("id", "type", "label", "node_no")


@query("set02_merged_edges", f"""WITH {MERGE_SQL} SELECT a.kept_id AS source, b.kept_id AS target, e.type, min(e.edge_no) AS edge_no
  FROM edges e JOIN idm a ON e.source = a.id AND e.stem = a.stem AND e.version = a.version JOIN idm b ON e.target = b.id AND e.stem = b.stem AND e.version = b.version GROUP BY ALL""")  # fmt: skip
def merged_edges(spark, d):
    return _merged(spark, d)[1].select("source", "target", "type", "edge_no")


REFINE_SQL = f"""{MAPPING_SQL},
  ret AS (SELECT n.stem, n.version, n.id, n.label, n.node_no, n.detail, n.confidence, CASE WHEN m.old IS NOT NULL THEN m.new ELSE n.type END AS type
    FROM nodes n LEFT JOIN map m ON m.kind = 'node_type' AND m.old = n.type),
  mer AS (SELECT stem, version, type, label, arg_min(id, node_no) AS id, min(node_no) AS seq, arg_min(detail, node_no) FILTER (detail IS NOT NULL AND detail NOT IN ('', '0', 'false')) AS detail,
    arg_min(confidence, node_no) FILTER (confidence IS NOT NULL AND confidence NOT IN ('', '0', 'false')) AS confidence FROM ret WHERE type IS NOT NULL GROUP BY ALL),
  idm AS (SELECT r.stem, r.version, r.id, arg_max(m.id, r.node_no) AS kept_id FROM ret r JOIN mer m ON r.stem = m.stem AND r.version = m.version AND r.type = m.type AND r.label IS NOT DISTINCT FROM m.label GROUP BY ALL)"""


def _refined(spark, d):
    n = table(spark, d, "nodes").select(*SCOPE, "id", "type", "label", "detail", "confidence", "node_no").withColumnRenamed("node_no", "seq")
    e = edges_of(spark, d).select(*SCOPE, "source", "target", "type", F.col("edge_no").alias("seq"))
    return W.apply_mapping(n, e, _mapping(spark), SCOPE, "seq", ["detail", "confidence"])


@query("set03_refined_nodes", f"WITH {REFINE_SQL} SELECT id, type, label, detail, confidence FROM mer")
def refined_nodes(spark, d):
    return _refined(spark, d)[0].select("id", "type", "label", "detail", "confidence")


@query("set03_refined_edges", f"""WITH {REFINE_SQL}, e AS (SELECT e.*, CASE WHEN m.old IS NOT NULL THEN m.new ELSE e.type END AS new_type FROM edges e LEFT JOIN map m ON m.kind = 'edge_type' AND m.old = e.type)
  SELECT a.kept_id AS source, b.kept_id AS target, new_type AS type, min(edge_no) AS seq FROM e JOIN idm a ON e.source = a.id AND e.stem = a.stem AND e.version = a.version
  JOIN idm b ON e.target = b.id AND e.stem = b.stem AND e.version = b.version WHERE new_type IS NOT NULL AND (source = target OR a.kept_id <> b.kept_id) GROUP BY ALL""")  # fmt: skip
def refined_edges(spark, d):
    return _refined(spark, d)[1].select("source", "target", "type", "seq")


@query("join13_mapped_types", f"""WITH {MAPPING_SQL} SELECT node_no, CASE WHEN m.old IS NOT NULL THEN m.new ELSE n.type END AS new_type, m.old IS NOT NULL AND m.new IS NULL AS removed
  FROM nodes n LEFT JOIN map m ON m.kind = 'node_type' AND m.old = n.type""")  # fmt: skip
def mapped_types(spark, d):
    side, new_type = W.mapped("type", "node_type", _mapping(spark))
    joined = table(spark, d, "nodes").select("node_no", "type").join(side, "type", "left")
    return joined.select("node_no", new_type.alias("new_type"), (F.col("listed").isNotNull() & F.col("new").isNull()).alias("removed"))


@query("agg15_retyped_counts", f"""WITH {MAPPING_SQL} SELECT old || ' -> ' || coalesce(new, '(removed)') AS change, count(*) AS n FROM nodes n JOIN map m ON m.kind = 'node_type' AND m.old = n.type GROUP BY ALL""")
def retyped_counts(spark, d):
    m = F.broadcast(_mapping(spark).where("kind = 'node_type'"))
    hit = table(spark, d, "nodes").select("type").join(m, F.col("type") == F.col("old"))
    return hit.groupBy(F.concat(F.col("old"), F.lit(" -> "), F.coalesce("new", F.lit("(removed)"))).alias("change")).agg(F.count("*").alias("n"))


OWN_IDS = "regexp_replace({}, '^.*::', '')"


def _own_ids(spark, d):
    """Nodes and edges under the ids they have within their document."""
    n = nodes_of(spark, d).select("stem", "version", F.col("original_id").alias("id"), "type", "label", "confidence", F.col("node_no").alias("seq"))
    bare = lambda c: F.regexp_replace(c, "^.*::", "").alias(c)
    e = edges_of(spark, d).select("stem", "version", bare("source"), bare("target"), "type", "confidence", F.col("edge_no").alias("seq"))
    return n, e


SUPPLEMENT_SQL = f"""{GRAPH_SQL}, b AS (SELECT stem, original_id AS id, type, label, node_no FROM g WHERE version = 1), x AS (SELECT stem, original_id AS id, type, label, node_no FROM g WHERE version = 2),
  known AS (SELECT stem, type, label, arg_max(id, node_no) AS kept FROM b GROUP BY ALL),
  fresh AS (SELECT stem, type, label, arg_min(id, node_no) AS id, min(node_no) AS node_no FROM x ANTI JOIN known USING (stem, type, label) GROUP BY ALL),
  named AS (SELECT f.*, row_number() OVER (PARTITION BY f.stem, f.id ORDER BY f.node_no) - CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.stem = f.stem AND b.id = f.id) THEN 0 ELSE 1 END AS k FROM fresh f),
  added AS (SELECT *, CASE WHEN k = 0 THEN id ELSE 's' || k || '_' || id END AS new_id FROM named),
  went AS (SELECT x.stem, x.id, arg_max(coalesce(known.kept, added.new_id), x.node_no) AS kept FROM x LEFT JOIN known USING (stem, type, label) LEFT JOIN added USING (stem, type, label)
    WHERE known.kept IS NOT NULL OR added.new_id IS NOT NULL GROUP BY ALL)"""


def _supplement(spark, d):
    n, e = _own_ids(spark, d)
    (base, extra), (old, new) = (tuple(rows.where(F.col("version") == v).drop("version") for v in (1, 2)) for rows in (n, e))
    added, went = W.supplement(base, extra, ["stem"], "seq")
    return added, W.supplemented_edges(old, new, went, ["stem"], "seq")


@query("set09_supplement", f"WITH {SUPPLEMENT_SQL} SELECT stem, type, label, new_id FROM added")
def supplement(spark, d):
    """Second versions as a second pass over the first: the nodes it adds."""
    return _supplement(spark, d)[0].select("stem", "type", "label", "new_id")


@query("set09_supplement_edges", f"""WITH {SUPPLEMENT_SQL}, e AS (SELECT stem, version, edge_no, type, {OWN_IDS.format("source")} AS source, {OWN_IDS.format("target")} AS target FROM edges),
  m AS (SELECT e.stem, coalesce(a.kept, source) AS source, coalesce(b.kept, target) AS target, type, edge_no FROM e LEFT JOIN went a ON a.stem = e.stem AND a.id = source LEFT JOIN went b ON b.stem = e.stem AND b.id = target WHERE version = 2)
  SELECT stem, source, target, type, min(edge_no) AS seq FROM m WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e o WHERE o.version = 1 AND o.stem = m.stem AND o.source = m.source AND o.target = m.target AND o.type = m.type) GROUP BY ALL""")  # fmt: skip
def supplement_edges(spark, d):
    """The edges it adds, between the nodes where its own went."""
    return _supplement(spark, d)[1].where("source is not null and target is not null and type is not null").select("stem", "source", "target", "type", "seq")


@query("set08_evolved_version", f"""WITH {GRAPH_SQL}, v AS (SELECT stem, max(version) + 1 AS next FROM g GROUP BY stem HAVING min(version) = 1),
  n AS (SELECT stem, version, original_id AS id, label, coalesce(confidence, '') = 'LOW' AS gone, node_no FROM g), c AS (SELECT stem, id, arg_max(label, node_no) AS label, arg_max(gone, node_no) AS gone FROM n WHERE version = 2 GROUP BY ALL),
  nn AS (SELECT stem, id, label FROM n WHERE version = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.stem = n.stem AND c.id = n.id) UNION ALL SELECT stem, id, label FROM c WHERE NOT gone),
  e AS (SELECT stem, version, {OWN_IDS.format("source")} AS source, {OWN_IDS.format("target")} AS target, type, coalesce(confidence, '') = 'LOW' AS gone, edge_no FROM edges WHERE type IS NOT NULL),
  d AS (SELECT stem, source, target, type, max(edge_no) AS last FROM e WHERE version = 2 AND gone GROUP BY ALL),
  ee AS (SELECT stem, source, target, type FROM e ANTI JOIN d USING (stem, source, target, type) WHERE version = 1 UNION ALL SELECT e.stem, source, target, type FROM e LEFT JOIN d USING (stem, source, target, type) WHERE version = 2 AND NOT gone AND (last IS NULL OR edge_no > last)),
  t AS (SELECT stem, type AS name, min(node_no) AS pos FROM g WHERE version = 1 AND type IS NOT NULL GROUP BY ALL), tc AS (SELECT DISTINCT stem, type AS name FROM g WHERE version = 2 AND type IS NOT NULL),
  tt AS (SELECT coalesce(t.stem, tc.stem) AS stem, coalesce(t.name, tc.name) AS name, CASE WHEN tc.name IS NULL THEN t.name WHEN lower(tc.name) < 'e' THEN 'new ' || tc.name ELSE '[DEPRECATED] ' || t.name END AS description
    FROM t FULL JOIN tc ON t.stem = tc.stem AND t.name = tc.name WHERE t.name IS NOT NULL OR lower(tc.name) < 'e'),
  a AS (SELECT 'node' AS part, stem, id AS a, label AS b FROM nn UNION ALL SELECT 'edge', stem, source || '>' || target, type FROM ee UNION ALL SELECT 'node_type', stem, name, description FROM tt)
  SELECT part, stem, next AS version, a, b FROM a JOIN v USING (stem)""")  # fmt: skip
def evolved_version(spark, d):
    """Second versions as reviewed changes to the first: those of low confidence deprecate, the others add or replace; the result is a new version."""
    n, e = _own_ids(spark, d)
    e = e.where("type is not null")
    numbers = n.groupBy("stem").agg(F.min("version").alias("version"), (F.max("version") + 1).alias("next")).where("version = 1")
    types = n.where("type is not null").groupBy("stem", "version", F.col("type").alias("name")).agg(F.min("seq").alias("pos")).withColumn("description", F.col("name"))
    decision = F.when(F.col("confidence") == "LOW", "DEPRECATE").otherwise("ADD")
    told = lambda rows: rows.where("version = 2").withColumns({"version": F.lit(1).cast("long"), "decision": decision})
    changed = types.where("version = 2").select("stem", F.lit(1).cast("long").alias("version"), F.lit("node_type").alias("kind"), "name", F.col("pos").alias("seq"), F.when(F.lower("name") < "e", "ADD").otherwise("DEPRECATE").alias("decision"), F.concat(F.lit("new "), "name").alias("description"))
    old = R.Version(types, types.limit(0), n.select("stem", "version", "id", "label"), e.select("stem", "version", "source", "target", "type"))
    new = R.evolved(old, numbers, changed, told(n).select("stem", "version", "seq", "decision", "id", "label"), told(e).select("stem", "version", "seq", "decision", "source", "target", "type"))
    parts = (("node", new.nodes, "id", "label"), ("edge", new.edges, F.concat("source", F.lit(">"), "target"), "type"), ("node_type", new.node_types, "name", "description"))
    rows = [x.select(F.lit(part).alias("part"), "stem", "version", (F.col(a) if isinstance(a, str) else a).alias("a"), F.col(b).alias("b")) for part, x, a, b in parts]
    return rows[0].union(rows[1]).union(rows[2])


REFINEMENT = [("node_type", "Coverage", "Benefit"), ("node_type", "Rider", "InsuranceProduct"), ("edge_type", "REQUIRES", None)]
REFINEMENT_SQL = "map AS (SELECT * FROM (VALUES {}) m(kind, old, new))".format(", ".join(f"('{k}', '{o}', {'NULL' if n is None else repr(n)})" for k, o, n in REFINEMENT))


@query("set06_refined_version", f"""WITH {STORED_SQL}, {REFINEMENT_SQL}, v AS (SELECT stem, max(version) AS version FROM n GROUP BY stem),
  an AS (SELECT n.stem, id, label, node_no, CASE WHEN m.old IS NOT NULL THEN m.new ELSE type END AS goal, type FROM n SEMI JOIN v USING (stem, version) LEFT JOIN map m ON m.kind = 'node_type' AND m.old = n.type),
  mer AS (SELECT stem, goal, label, arg_min(id, node_no) AS kept FROM an GROUP BY ALL), idm AS (SELECT an.stem, an.id, kept FROM an JOIN mer ON an.stem = mer.stem AND an.goal = mer.goal AND an.label IS NOT DISTINCT FROM mer.label),
  ae AS (SELECT e.stem, source, target, e.type, CASE WHEN m.old IS NOT NULL THEN m.new ELSE e.type END AS goal FROM e SEMI JOIN v USING (stem, version) LEFT JOIN map m ON m.kind = 'edge_type' AND m.old = e.type),
  re AS (SELECT DISTINCT ae.stem, a.kept AS source, b.kept AS target, goal FROM ae JOIN idm a ON a.stem = ae.stem AND a.id = source JOIN idm b ON b.stem = ae.stem AND b.id = target WHERE goal IS NOT NULL AND (source = target OR a.kept <> b.kept)),
  c AS (SELECT stem, 'nodes' AS part, count(*) AS before, (SELECT count(*) FROM mer WHERE mer.stem = an.stem) AS after FROM an GROUP BY stem
    UNION ALL SELECT stem, 'node_types', count(DISTINCT type), count(DISTINCT goal) FROM an GROUP BY stem
    UNION ALL SELECT stem, 'edge_types', count(DISTINCT type), count(DISTINCT type) FILTER (type NOT IN (SELECT old FROM map WHERE kind = 'edge_type')) FROM ae GROUP BY stem
    UNION ALL SELECT stem, 'edges', count(*), (SELECT count(*) FROM re WHERE re.stem = ae.stem) FROM ae GROUP BY stem)
  SELECT stem, version + 1 AS version, part, before, after FROM c JOIN v USING (stem)""")  # fmt: skip
def refined_version(spark, d):
    """The newest version of every document refined into the next one, written to the store and counted there."""
    n, e = storable(spark, d)
    own = lambda rows, kind: rows.select(*SCOPE, F.col("type").alias("name")).distinct().withColumns({"pos": F.lit(0), "description": F.lit(""), "kind": F.lit(kind), "source": F.lit(None).cast("string"), "target": F.lit(None).cast("string")})
    old = R.Version(own(n, "node_type"), own(e, "edge_type"), n.select(*SCOPE, "id", "type", "label", "detail", F.col("node_no").alias("seq")), e.select(*SCOPE, "source", "target", "type", F.col("edge_no").alias("seq")))
    numbers = n.groupBy("stem").agg(F.max("version").alias("version")).withColumn("next", F.col("version") + 1)
    new = R.refined(old, numbers, spark.createDataFrame(REFINEMENT, "kind string, old string, new string"), "seq", ["detail"])
    store = GraphStore(spark, shared_folder(spark, "graph"))
    store.write_graphs(new.nodes, new.edges)
    return R.size_changes(old, R.Version(new.node_types, new.edge_types, store.nodes(), store.edges()), numbers)


@query("src18_update_embeddings", "SELECT vec_id, round((CASE WHEN embedding[1] > 0 THEN -embedding[1] ELSE embedding[1] END)::DOUBLE, 5) AS first FROM embeddings")
def update_embeddings(spark, d):
    """New vectors for rows whose first value is positive replace old ones in the store, twice over; the other rows keep theirs."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("stem"), F.lit(1).cast("long").alias("version"), F.col("vec_id").cast("string").alias("id"), "embedding")
    store = GraphStore(spark, shared_folder(spark, "vectors"))
    n = e.withColumns({"type": F.lit("Vector"), "label": F.col("id")})
    store.write_graphs(n, spark.createDataFrame([], "stem string, version long, source string, target string, type string"))
    new = e.where(F.col("embedding")[0] > 0).withColumn("embedding", F.transform("embedding", lambda x: -x))
    for _ in range(2):
        store.update_embeddings(new)
    return store.nodes().select(F.col("id").cast("long").alias("vec_id"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("jsn01_lenient_replies", """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, props IS NULL AS malformed FROM events""")
def lenient_replies(spark, d):
    """Replies wrapped in a code fence, with text behind the value, parse to the first complete value; a reply without one is malformed."""
    fenced = F.concat(F.lit("```json\n"), F.coalesce("props", F.lit("nothing")), F.lit(" and more\n```"))
    got = parsed_replies(table(spark, d, "events").select("event_id", fenced.alias("reply")), "event_id", ("k",))
    return got.select("event_id", F.get_json_object("value", "$.k").cast("long").alias("k"), F.col("error").isNotNull().alias("malformed"))


@query("flt13_document_offsets", """WITH o AS (SELECT stem, chunk_id, text, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY stem ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM chunks),
  e AS (SELECT DISTINCT stem, evidence_text FROM nodes WHERE evidence_text <> ''), f AS (SELECT e.stem, evidence_text, min(base + strpos(text, evidence_text) - 1) AS start_at FROM e JOIN o ON o.stem = e.stem AND contains(text, evidence_text) GROUP BY ALL)
  SELECT node_no, CAST(start_at AS BIGINT) AS start_at, CAST(start_at + length(evidence_text) AS BIGINT) AS end_at FROM nodes LEFT JOIN f USING (stem, evidence_text) WHERE evidence_text <> ''""")  # fmt: skip
def document_offsets(spark, d):
    """Every quoted wording at its first place in the document; one that is nowhere keeps its text and loses its offsets."""
    chunks = table(spark, d, "chunks")
    sized = chunks.select("chunk_id", "stem", (F.length(F.coalesce("text", F.lit(""))) + 2).alias("n"))
    bases = sums_before(sized, "stem", "chunk_id", "n", "base").select(F.col("chunk_id").alias("text_id"), "base")
    texts = chunks.select("stem", F.col("chunk_id").alias("text_id"), "text").join(bases, "text_id")
    quotes = table(spark, d, "nodes").where("evidence_text <> ''").select("node_no", "stem", F.col("evidence_text").alias("quote"))
    return E.anchored(quotes, texts, "stem").select("node_no", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
