"""Graph queries over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..operators import graph as G
from .registry import query, table

SEED_TYPES = ["Regulation", "Procedure"]
WALK_TYPES = ["LIMITS", "EXCLUDES"]
TOP_K, MIN_SCORE = 5, 0.3

#: Nodes with a number divisible by 20 make as many searches, with the first letters and an inflected form of their labels as keywords.
KEYWORDS_SQL = """kw AS (
  SELECT node_no AS query_id, stem, type, unnest([left(label, 5), label || '은']) AS keyword FROM nodes WHERE node_no % 20 = 0 AND label IS NOT NULL)"""
GRAPH_SQL = "g AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY node_no) = 1)"


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    """One row an id: the first delivered."""
    rows = table(spark, d, "nodes")
    first = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "node_no").alias("n"))
    return first.select("id", "n.*")


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges")


#: The graph as it can be stored: valid type names and resolved edges only.
STORED_SQL = f"""{GRAPH_SQL}, n AS (SELECT * FROM g WHERE regexp_full_match(type, '[A-Za-z_][A-Za-z0-9_]*')),
  e AS (SELECT * FROM edges WHERE regexp_full_match(type, '[A-Za-z_][A-Za-z0-9_]*') AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n))"""


def storable(spark, d):
    n = nodes_of(spark, d).where(F.col("type").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"))
    e = edges_of(spark, d).where(F.col("type").rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"))
    return n, G.resolved_edges(n, e)


def keywords_of(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nodes").where("node_no % 20 = 0 and label is not null")
    words = F.explode(F.array(F.substring("label", 1, 5), F.concat("label", F.lit("은")))).alias("keyword")
    return asked.select(F.col("node_no").alias("query_id"), "stem", "type", words)


def _versioned(spark: SparkSession, d: str, keywords: DataFrame) -> DataFrame:
    return keywords.crossJoin(spark.createDataFrame([(1,), (2,)], "version long"))


@query("src15_load_graph_nodes", f"""WITH {GRAPH_SQL} SELECT stem, version, id, label, type, nullif(detail, '') AS detail,
  confidence, evidence_text, CASE WHEN evidence_text IS NOT NULL THEN start_offset END AS start_offset,
  CASE WHEN evidence_text IS NOT NULL THEN end_offset END AS end_offset FROM g""")  # fmt: skip
def load_graph_nodes(spark, d):
    return G.read_nodes(nodes_of(spark, d)).select("stem", "version", "id", "label", "type", "detail", "confidence", "evidence_text", "start_offset", "end_offset")


@query("src15_load_graph_edges", "SELECT stem, version, source, target, type, nullif(detail, '') AS detail, edge_no FROM edges")
def load_graph_edges(spark, d):
    return edges_of(spark, d).select("stem", "version", "source", "target", "type", F.nullif("detail", F.lit("")).alias("detail"), "edge_no")


@query("src16_has_graph", "SELECT DISTINCT stem, version FROM nodes")
def has_graph(spark, d):
    return table(spark, d, "nodes").select("stem", "version").distinct()


@query("flt01_scope_counts", "SELECT stem, version, count(*) AS n_nodes FROM nodes WHERE version = 1 GROUP BY ALL")
def scope_counts(spark, d):
    return table(spark, d, "nodes").where("version = 1").groupBy("stem", "version").agg(F.count("*").alias("n_nodes"))


@query("flt02_nodes_of_types", f"WITH {GRAPH_SQL} SELECT id, stem, version, type, label FROM g WHERE type IN ('Regulation', 'Procedure')")
def nodes_of_types(spark, d):
    return G.of_types(nodes_of(spark, d), SEED_TYPES).select("id", "stem", "version", "type", "label")


@query("flt03_keyword_matches", f"""WITH {KEYWORDS_SQL}, {GRAPH_SQL}
  SELECT DISTINCT k.query_id, g.id FROM kw k JOIN g ON g.stem = k.stem AND g.type = k.type AND g.version IN (1, 2)
  WHERE contains(lower(g.label), lower(k.keyword)) OR contains(lower(k.keyword), lower(g.label))""")  # fmt: skip
def keyword_matches(spark, d):
    return G.keyword_matches(nodes_of(spark, d), _versioned(spark, d, keywords_of(spark, d)))


@query("flt03_keyword_matches_all_versions", f"""WITH {KEYWORDS_SQL}, {GRAPH_SQL}
  SELECT DISTINCT k.query_id, g.id FROM kw k JOIN g ON g.stem = k.stem AND g.type = k.type
  WHERE contains(lower(g.label), lower(k.keyword)) OR contains(lower(k.keyword), lower(g.label))""")  # fmt: skip
def keyword_matches_all_versions(spark, d):
    """The searches over every version there is; flt03_keyword_matches asks for versions 1 and 2, as its SQL does."""
    n = nodes_of(spark, d)
    return G.keyword_matches(n, keywords_of(spark, d).join(n.select("stem", "version").distinct(), "stem"))


def _property_sql(test: str) -> str:
    return f"WITH {GRAPH_SQL} SELECT id, properties['amount'] AS amount FROM g WHERE properties IS NOT NULL AND {test}"


for _op, _value, _test in (
    ("eq", "129", "properties['amount'] = '129'"),
    ("ne", "129", "properties['amount'] <> '129'"),
    ("gt", "500", "try_cast(properties['amount'] AS DOUBLE) > 500"),
    ("gte", "500", "try_cast(properties['amount'] AS DOUBLE) >= 500"),
    ("lt", "100", "try_cast(properties['amount'] AS DOUBLE) < 100"),
    ("lte", "100", "try_cast(properties['amount'] AS DOUBLE) <= 100"),
):

    @query(f"flt04_property_{_op}", _property_sql(_test))
    def property_filter(spark, d, op=_op, value=_value):
        held = nodes_of(spark, d).where(G.property_test(F.col("properties"), "amount", op, value))
        return held.select("id", F.try_element_at("properties", F.lit("amount")).alias("amount"))


@query("flt05_confidence_medium", """SELECT node_no, confidence FROM nodes WHERE confidence IS NULL
  OR coalesce(CASE confidence WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 END, 0) >= 2""")  # fmt: skip
def confidence_medium(spark, d):
    return table(spark, d, "nodes").where(G.confidence_passes(F.col("confidence"), "MEDIUM")).select("node_no", "confidence")


ENDS_SQL = "ends AS (SELECT DISTINCT id FROM nodes)"


@query("flt07_resolved_edges", f"WITH {ENDS_SQL} SELECT edge_no FROM edges WHERE source IN (SELECT id FROM ends) AND target IN (SELECT id FROM ends)")
def resolved_edges(spark, d):
    return G.resolved_edges(table(spark, d, "nodes"), edges_of(spark, d)).select("edge_no")


@query("flt08_dangling_edges", f"WITH {ENDS_SQL} SELECT edge_no, source, target FROM edges WHERE source NOT IN (SELECT id FROM ends) OR target NOT IN (SELECT id FROM ends)")
def dangling_edges(spark, d):
    return G.dangling_edges(table(spark, d, "nodes"), edges_of(spark, d)).select("edge_no", "source", "target")


@query("flt18_visible_subgraph", f"""WITH {GRAPH_SQL}, v AS (SELECT id FROM g WHERE type IN ('Coverage', 'Benefit', 'Premium', 'Exclusion'))
  SELECT edge_no FROM edges WHERE type IN ('LIMITS', 'EXCLUDES') AND source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)""")  # fmt: skip
def visible_subgraph(spark, d):
    return G.visible_subgraph(nodes_of(spark, d), edges_of(spark, d), ["Coverage", "Benefit", "Premium", "Exclusion"], WALK_TYPES)[1].select("edge_no")


@query("prj01_global_ids", "SELECT node_no, stem || '::v' || CAST(version AS VARCHAR) || '::' || original_id AS global_id, split_part(id, '::', 1) AS id_stem FROM nodes")
def global_ids(spark, d):
    made = F.concat_ws("::", "stem", F.concat(F.lit("v"), F.col("version").cast("string")), "original_id")
    return table(spark, d, "nodes").select("node_no", made.alias("global_id"), F.split_part("id", F.lit("::"), F.lit(1)).alias("id_stem"))


@query("prj02_envelope", """SELECT node_no, nullif(detail, '') AS detail, CASE WHEN evidence_text IS NOT NULL THEN start_offset END AS start_offset,
  CASE WHEN evidence_text IS NOT NULL THEN end_offset END AS end_offset, nullif(confidence, '') AS confidence FROM nodes""")  # fmt: skip
def envelope(spark, d):
    return G.read_nodes(table(spark, d, "nodes")).select("node_no", "detail", "start_offset", "end_offset", F.nullif("confidence", F.lit("")).alias("confidence"))


@query("join01_edges_with_ends", f"""WITH {GRAPH_SQL} SELECT e.edge_no, a.label AS source_label, b.label AS target_label
  FROM edges e JOIN g a ON e.source = a.id JOIN g b ON e.target = b.id""")  # fmt: skip
def edges_with_ends(spark, d):
    n = nodes_of(spark, d).select("id", "label")
    a, b = (n.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("source", "target"))
    return edges_of(spark, d).join(a, "source").join(b, "target").select("edge_no", "source_label", "target_label")


SEEDS_SQL = f"{GRAPH_SQL}, seeds AS (SELECT stem, version, id FROM g WHERE type IN ('Regulation', 'Procedure'))"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """One search a scope, seeded by its regulations and procedures."""
    return G.of_types(nodes_of(spark, d), SEED_TYPES).select(F.concat_ws("/", "stem", "version").alias("query_id"), "stem", "version", "id")


@query("join02_matching_edges", f"""WITH {SEEDS_SQL} SELECT DISTINCT stem || '/' || version AS query_id, edge_no FROM edges e
  WHERE type IN ('LIMITS', 'EXCLUDES') AND (EXISTS (SELECT 1 FROM seeds s WHERE s.id = e.source) OR EXISTS (SELECT 1 FROM seeds s WHERE s.id = e.target))""")  # fmt: skip
def matching_edges(spark, d):
    seeds = _seeds(spark, d)
    types = seeds.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, WALK_TYPES))).alias("type"))
    edges = edges_of(spark, d).select("stem", "version", "source", "target", "type", "edge_no")
    return G.matching_edges(edges, seeds, types).select("query_id", "edge_no")


@query("join03_edges_of_types", "SELECT edge_no, type FROM edges WHERE type IN ('LIMITS', 'EXCLUDES')")
def edges_of_types(spark, d):
    return G.of_types(edges_of(spark, d), WALK_TYPES).select("edge_no", "type")


@query("join04_containment_pairs", f"""WITH {KEYWORDS_SQL}, {GRAPH_SQL}
  SELECT k.query_id, k.keyword, count(DISTINCT g.id) AS n_nodes FROM kw k JOIN g ON g.stem = k.stem AND g.type = k.type
  WHERE contains(lower(g.label), lower(k.keyword)) OR contains(lower(k.keyword), lower(g.label)) GROUP BY ALL""")  # fmt: skip
def containment_pairs(spark, d):
    n = nodes_of(spark, d).select("stem", "type", "id", "label")
    hit = n.join(keywords_of(spark, d), ["stem", "type"]).where(G.keyword_hit(F.col("label"), F.col("keyword")))
    return hit.groupBy("query_id", "keyword").agg(F.countDistinct("id").alias("n_nodes"))


WALK_SQL = f"""{SEEDS_SQL}, links AS (
    SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
  h0 AS (SELECT id FROM seeds), h1 AS (SELECT id FROM h0 UNION SELECT b FROM links WHERE a IN (SELECT id FROM h0)),
  h2 AS (SELECT id FROM h1 UNION SELECT b FROM links WHERE a IN (SELECT id FROM h1)),
  hops AS (SELECT id, CASE WHEN id IN (SELECT id FROM h0) THEN 0 WHEN id IN (SELECT id FROM h1) THEN 1 ELSE 2 END AS hop FROM h2)"""


@query("join05_expand_hops", f"WITH {WALK_SQL} SELECT id, hop FROM hops")
def expand_hops(spark, d):
    return G.expand_hops(edges_of(spark, d), _seeds(spark, d), 2).select("id", "hop")


@query("join05_expand_no_types", f"WITH {SEEDS_SQL} SELECT id, 0 AS hop FROM seeds")
def expand_no_types(spark, d):
    return G.expand_hops(edges_of(spark, d), _seeds(spark, d), 3, []).select("id", "hop")


@query("join06_induced_subgraph", f"WITH {WALK_SQL} SELECT edge_no FROM edges WHERE source IN (SELECT id FROM h2) AND target IN (SELECT id FROM h2)")
def induced_subgraph(spark, d):
    return G.induced_edges(edges_of(spark, d), G.expand_hops(edges_of(spark, d), _seeds(spark, d), 2)).select("edge_no")


@query("join07_edge_lines", f"""WITH {GRAPH_SQL} SELECT e.edge_no, '- ' || coalesce(a.label, e.source) || ' --' || e.type || '--> ' || coalesce(b.label, e.target)
  || CASE WHEN e.detail IS NULL OR e.detail = '' THEN '' ELSE ': ' || e.detail END AS line
  FROM edges e LEFT JOIN g a ON e.source = a.id LEFT JOIN g b ON e.target = b.id""")  # fmt: skip
def edge_lines(spark, d):
    n = nodes_of(spark, d).select("id", "label")
    a, b = (n.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("source", "target"))
    e = edges_of(spark, d).join(a, "source", "left").join(b, "target", "left")
    tail = F.when(F.coalesce("detail", F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), "detail"))
    line = F.concat(F.lit("- "), F.coalesce("source_label", "source"), F.lit(" --"), "type", F.lit("--> "), F.coalesce("target_label", "target"), tail)
    return e.select("edge_no", line.alias("line"))


@query("agg01_type_counts", "SELECT stem, version, type, count(*) AS n FROM nodes GROUP BY ALL")
def type_counts(spark, d):
    return table(spark, d, "nodes").groupBy("stem", "version", "type").agg(F.count("*").alias("n"))


@query("agg07_evidence_coverage", """SELECT 'node' AS kind, count(*) AS total, count(evidence_text) AS with_evidence FROM nodes
  UNION ALL SELECT 'edge', count(*), count(confidence) FROM edges""")  # fmt: skip
def evidence_coverage(spark, d):
    n = table(spark, d, "nodes").agg(F.count("*").alias("total"), F.count("evidence_text").alias("with_evidence")).select(F.lit("node").alias("kind"), "*")
    return n.union(edges_of(spark, d).agg(F.count("*"), F.count("confidence")).select(F.lit("edge"), "*"))


@query("agg22_degree", """SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id""")
def degree(spark, d):
    return G.degree(edges_of(spark, d)).select("id", "degree")


@query("srt01_ordered_graph", "SELECT edge_no, row_number() OVER (PARTITION BY stem, version ORDER BY type, source, target, edge_no) AS position FROM edges")
def ordered_graph(spark, d):
    w = Window.partitionBy("stem", "version").orderBy("type", "source", "target", "edge_no")
    return edges_of(spark, d).select("edge_no", F.row_number().over(w).cast("long").alias("position"))


@query("srt02_vector_top_k", f"""WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS score
    FROM n q JOIN n c ON q.label = c.label WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)
  SELECT query_id, id, score, place FROM r WHERE place <= {TOP_K} AND score >= {MIN_SCORE}""")  # fmt: skip
def vector_top_k(spark, d):
    n = table(spark, d, "embeddings").where("embedding is not null").withColumn("norm", norm(F.col("embedding")))
    q = n.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"), F.col("norm").alias("q_norm"))
    scored = n.join(q, "label").select("query_id", F.col("vec_id").alias("id"), F.round(cosine(F.col("q"), F.col("embedding"), F.col("q_norm"), F.col("norm")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place.cast("long")).where((F.col("place") <= TOP_K) & (F.col("score") >= MIN_SCORE))


@query("mth01_cosine_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")  # fmt: skip
def cosine_pairs(spark, d):
    n = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = n.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return n.join(b, F.col("vec_id") == F.col("a")).select("a", "b", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


@query("win05_match_ranks", f"""WITH {KEYWORDS_SQL}, {GRAPH_SQL}, hit AS (
    SELECT k.query_id, g.id, min(CASE g.type WHEN 'InsuranceProduct' THEN 0 WHEN 'Coverage' THEN 1 ELSE 2 END) AS pos FROM kw k JOIN g ON g.stem = k.stem AND g.type = k.type
    WHERE contains(lower(g.label), lower(k.keyword)) OR contains(lower(k.keyword), lower(g.label)) GROUP BY ALL)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS place FROM hit""")  # fmt: skip
def match_ranks(spark, d):
    n = nodes_of(spark, d).select("stem", "type", "id", "label")
    pos = F.when(F.col("type") == "InsuranceProduct", 0).when(F.col("type") == "Coverage", 1).otherwise(2)
    hit = n.join(keywords_of(spark, d), ["stem", "type"]).where(G.keyword_hit(F.col("label"), F.col("keyword"))).groupBy("query_id", "id").agg(F.min(pos).alias("pos"))
    return hit.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "id")).cast("long").alias("place"))


@query("win06_first_wins", "SELECT stem, version, type, label, min(node_no) AS node_no FROM nodes GROUP BY ALL")
def first_wins(spark, d):
    return table(spark, d, "nodes").groupBy("stem", "version", "type", "label").agg(F.min("node_no").alias("node_no"))


@query("win14_type_colours", "SELECT type, (dense_rank() OVER (ORDER BY type) - 1) % 12 AS colour FROM (SELECT DISTINCT type FROM nodes WHERE type IS NOT NULL)")
def type_colours(spark, d):
    types = table(spark, d, "nodes").where("type is not null").select("type").distinct()
    return types.select("type", F.pmod(F.dense_rank().over(Window.orderBy("type")) - 1, F.lit(12)).cast("long").alias("colour"))


@query("win15_cluster_layout", """WITH deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
  n AS (SELECT stem, version, type, id FROM nodes GROUP BY ALL),
  r AS (SELECT n.*, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY n.stem, n.version, n.type ORDER BY coalesce(degree, 0) DESC, n.id) - 1 AS k,
    ceil(sqrt(count(*) OVER (PARTITION BY n.stem, n.version, n.type))) AS cols FROM n LEFT JOIN deg USING (id))
  SELECT id, type, degree, CAST(k % CAST(cols AS BIGINT) AS BIGINT) AS grid_x, CAST(floor(k / cols) AS BIGINT) AS grid_y FROM r""")  # fmt: skip
def cluster_layout(spark, d):
    n = table(spark, d, "nodes").select("stem", "version", "type", "id").distinct()
    sized = n.join(G.degree(edges_of(spark, d)).select("id", "degree"), "id", "left").fillna(0, ["degree"])
    scope = Window.partitionBy("stem", "version", "type")
    k = F.row_number().over(scope.orderBy(F.desc("degree"), "id")) - 1
    cols = F.ceil(F.sqrt(F.count("*").over(scope)))
    placed = sized.select("id", "type", "degree", k.alias("k"), cols.alias("cols"))
    return placed.select("id", "type", "degree", (F.col("k") % F.col("cols")).cast("long").alias("grid_x"), F.floor(F.col("k") / F.col("cols")).cast("long").alias("grid_y"))


@query("set01_edge_specs", """SELECT e.type, a.type AS source_type, b.type AS target_type, min(e.edge_no) AS first_seen
  FROM edges e JOIN (SELECT DISTINCT id, min(type) AS type FROM nodes GROUP BY id) a ON e.source = a.id JOIN (SELECT DISTINCT id, min(type) AS type FROM nodes GROUP BY id) b ON e.target = b.id GROUP BY ALL""")  # fmt: skip
def edge_specs(spark, d):
    kinds = table(spark, d, "nodes").groupBy("id").agg(F.min("type").alias("t"))
    a, b = (kinds.select(F.col("id").alias(c), F.col("t").alias(f"{c}_type")) for c in ("source", "target"))
    joined = edges_of(spark, d).join(a, "source").join(b, "target")
    return joined.groupBy("type", "source_type", "target_type").agg(F.min("edge_no").alias("first_seen"))


@query("msc02_stems_with_versions", "SELECT stem, string_agg(DISTINCT CAST(version AS VARCHAR), ',' ORDER BY CAST(version AS VARCHAR)) AS versions FROM nodes GROUP BY stem")
def stems_with_versions(spark, d):
    versions = F.array_join(F.array_sort(F.collect_set(F.col("version").cast("string"))), ",")
    return table(spark, d, "nodes").groupBy("stem").agg(versions.alias("versions"))


@query("msc10_table_counts", "SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def table_counts(spark, d):
    one = lambda n: table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("nodes").union(one("edges"))
