"""Schema, version and domain queries; a schema version is what the nodes and edges of a stem and version use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import domain as D
from ..operators import evaluation as E
from ..operators import schema as S
from ..shared import shared_folder
from .q_extraction import MAPPING, MAPPING_SQL
from .registry import query, table

SCOPE = ["stem", "version"]
TYPES_SQL = """types AS (SELECT stem, version, 'node_type' AS kind, type AS name, min(node_no) AS pos FROM nodes WHERE type IS NOT NULL GROUP BY ALL
  UNION ALL SELECT stem, version, 'edge_type', type, min(edge_no) FROM edges WHERE type IS NOT NULL GROUP BY ALL)"""


def types_of(spark, d):
    n = table(spark, d, "nodes").where("type is not null").groupBy(*SCOPE, F.col("type").alias("name")).agg(F.min("node_no").alias("pos"))
    e = table(spark, d, "edges").where("type is not null").groupBy(*SCOPE, F.col("type").alias("name")).agg(F.min("edge_no").alias("pos"))
    return n.select(*SCOPE, F.lit("node_type").alias("kind"), "name", "pos").union(e.select(*SCOPE, F.lit("edge_type"), "name", "pos"))


#: Edge types with the types of the nodes they were seen between.
ENDS_SQL = """kinds AS (SELECT id, min(type) AS t FROM nodes GROUP BY id),
  ends AS (SELECT DISTINCT e.stem, e.version, e.type AS name, s.t AS source, t.t AS target FROM edges e JOIN kinds s ON s.id = e.source JOIN kinds t ON t.id = e.target WHERE e.type IS NOT NULL)"""
ISSUES_SQL = f"""{TYPES_SQL}, {ENDS_SQL}, declared AS (SELECT DISTINCT stem, version, lower(name) AS name FROM types WHERE kind = 'node_type'), used AS (SELECT stem, version, source AS "end" FROM ends UNION SELECT stem, version, target FROM ends),
  issues AS (SELECT DISTINCT stem, version, 'invalid_identifier' AS rule, name AS element FROM types WHERE NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')
  UNION ALL SELECT stem, version, 'duplicate_type', lower(name) FROM types WHERE kind = 'node_type' GROUP BY stem, version, lower(name) HAVING count(*) > 1
  UNION ALL SELECT stem, version, 'unknown_endpoint', "end" FROM used WHERE "end" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM declared t WHERE t.stem = used.stem AND t.version = used.version AND t.name = lower(used."end")))"""


def edge_types_of(spark, d):
    kinds = table(spark, d, "nodes").groupBy("id").agg(F.min("type").alias("t"))
    a, b = (kinds.select(F.col("id").alias(c), F.col("t").alias(f"{c}_type")) for c in ("source", "target"))
    seen = table(spark, d, "edges").where("type is not null").join(a, "source").join(b, "target")
    return seen.select(*SCOPE, F.col("type").alias("name"), F.col("source_type").alias("source"), F.col("target_type").alias("target")).distinct()


def _issues(spark, d):
    none = F.lit(None).cast("string")
    nodes = types_of(spark, d).select(*SCOPE, "kind", "name", none.alias("source"), none.alias("target"))
    ends = edge_types_of(spark, d).select(*SCOPE, F.lit("edge_type").alias("kind"), "name", "source", "target")
    return S.validate_types(nodes.union(ends), SCOPE).distinct()


@query("val01_schema_issues", f"WITH {ISSUES_SQL} SELECT stem, version, rule, element FROM issues")
def schema_issues(spark, d):
    return _issues(spark, d).select(*SCOPE, "rule", "element")


@query("agg13_issue_counts", f"WITH {ISSUES_SQL} SELECT stem, version, 'error' AS severity, count(*) AS n FROM issues GROUP BY stem, version")
def issue_counts(spark, d):
    return _issues(spark, d).groupBy(*SCOPE, "severity").agg(F.count("*").alias("n"))


@query("join15_undeclared_ends", f"""WITH {TYPES_SQL}, {ENDS_SQL}, own AS (SELECT DISTINCT stem, version, lower(name) AS name FROM types WHERE kind = 'node_type'), u AS (SELECT stem, version, name, source AS "end" FROM ends UNION SELECT stem, version, name, target FROM ends)
  SELECT stem, version, name, "end" FROM u WHERE "end" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.stem = u.stem AND own.version = u.version AND own.name = lower(u."end"))""")  # fmt: skip
def undeclared_ends(spark, d):
    """Ends of edge types, source or target, that the schema of their version does not declare, whatever their case."""
    declared = types_of(spark, d).where("kind = 'node_type'").select(*SCOPE, F.lower("name").alias("key")).distinct()
    ends = edge_types_of(spark, d).select(*SCOPE, "name", F.explode(F.array("source", "target")).alias("end")).where("end is not null").distinct()
    return ends.withColumn("key", F.lower("end")).join(declared, [*SCOPE, "key"], "left_anti").select(*SCOPE, "name", "end")


@query("prj04_schema_preview", f"""WITH {TYPES_SQL}, {ENDS_SQL} SELECT stem, version, 'node' AS part, name AS id, NULL AS source, NULL AS target FROM types WHERE kind = 'node_type' UNION ALL SELECT stem, version, 'edge', name, source, target FROM ends""")
def schema_preview(spark, d):
    """A schema as a graph: its node types are nodes, its edge types edges between them."""
    none = F.lit(None).cast("string")
    nodes = types_of(spark, d).where("kind = 'node_type'").select(*SCOPE, F.lit("node").alias("part"), F.col("name").alias("id"), none.alias("source"), none.alias("target"))
    return nodes.union(edge_types_of(spark, d).select(*SCOPE, F.lit("edge"), "name", "source", "target"))


MERGED_SQL = f"""{MAPPING_SQL}, {TYPES_SQL}, {ENDS_SQL}, j AS (SELECT stem, version, CASE WHEN m.old IS NOT NULL THEN m.new ELSE name END AS goal, name, pos FROM types LEFT JOIN map m ON m.kind = 'node_type' AND m.old = name WHERE types.kind = 'node_type' AND name <> '')"""


def _mapping(spark):
    return spark.createDataFrame(MAPPING, "kind string, old string, new string")


@query("set04_merged_schema", f"""WITH {MERGED_SQL}, keys AS (SELECT DISTINCT stem, version, type AS name, unnest(map_keys(properties)) AS key FROM nodes WHERE type <> ''),
  first AS (SELECT stem, version, goal, key, arg_min(name, (CASE WHEN name = goal THEN 0 ELSE 1 END, pos)) AS origin FROM keys JOIN j USING (stem, version, name) WHERE goal IS NOT NULL GROUP BY ALL),
  p AS (SELECT stem, version, goal, string_agg(key || '=' || origin, ';' ORDER BY key) AS properties FROM first GROUP BY ALL)
  SELECT stem, version, goal AS name, min(pos) AS pos, string_agg(name, ' / ' ORDER BY CASE WHEN name = goal THEN 0 ELSE 1 END, pos) AS description, coalesce(any_value(p.properties), '') AS properties
  FROM j LEFT JOIN p USING (stem, version, goal) WHERE goal IS NOT NULL GROUP BY stem, version, goal""")  # fmt: skip
def merged_schema(spark, d):
    """Node types merged; a property says which type's declaration it is."""
    types = types_of(spark, d).where("kind = 'node_type' and name <> ''").withColumn("description", F.col("name"))
    keys = table(spark, d, "nodes").where("type <> ''").select(*SCOPE, F.col("type").alias("name"), F.explode(F.map_keys("properties")).alias("key")).distinct()
    held = keys.groupBy(*SCOPE, "name").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("name").alias("origin")))).alias("properties"))
    merged = S.merged_types(types.join(held, [*SCOPE, "name"], "left"), _mapping(spark), SCOPE)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return merged.select(*SCOPE, "name", "pos", "description", told.alias("properties"))


@query("set04_merged_edge_types", f"""WITH {MERGED_SQL} SELECT stem, version, name, CASE WHEN a.old IS NOT NULL THEN a.new ELSE source END AS source, CASE WHEN b.old IS NOT NULL THEN b.new ELSE target END AS target
  FROM ends LEFT JOIN map a ON a.kind = 'node_type' AND a.old = source LEFT JOIN map b ON b.kind = 'node_type' AND b.old = target WHERE name NOT IN (SELECT old FROM map WHERE kind = 'edge_type')""")  # fmt: skip
def merged_edge_types(spark, d):
    return S.merged_edge_types(edge_types_of(spark, d), _mapping(spark), SCOPE)


PROBE = [("node_type", "Coverage", "Benefit"), ("node_type", "Benefit", "Benefit"), ("node_type", "Nothing", "Rider"), ("edge_type", "LIMITS", "NOWHERE"), ("edge_type", "EXCLUDES", "LIMITS"), ("edge_type", "REQUIRES", "EXCLUDES")]


@query("set05_mapping_problems", f"""WITH m AS (SELECT * FROM (VALUES {", ".join(str(p) for p in PROBE)}) m(kind, old, new)), {TYPES_SQL}, {ENDS_SQL},
  n AS (SELECT DISTINCT 'node_type' AS kind, name FROM types WHERE kind = 'node_type' UNION SELECT 'edge_type', name FROM ends),
  g AS (SELECT DISTINCT name, coalesce((SELECT new FROM m WHERE kind = 'node_type' AND old = source), source) AS source, coalesce((SELECT new FROM m WHERE kind = 'node_type' AND old = target), target) AS target FROM ends),
  l AS (SELECT name, list_sort(list(coalesce(source, '') || '>' || coalesce(target, ''))) AS ends FROM g GROUP BY name)
  SELECT kind, old, 'unknown_old' AS problem FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = m.kind AND n.name = m.old)
  UNION ALL SELECT kind, old, 'unknown_new' FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = m.kind AND n.name = m.new)
  UNION ALL SELECT kind, old, 'self_merge' FROM m WHERE old = new
  UNION ALL SELECT kind, old, 'ends_differ' FROM m JOIN l a ON a.name = old JOIN l b ON b.name = new WHERE kind = 'edge_type' AND a.ends <> b.ends
  UNION ALL SELECT kind, old, 'chain' FROM m WHERE old <> new AND EXISTS (SELECT 1 FROM m x WHERE x.kind = m.kind AND x.old = m.new)""")  # fmt: skip
def mapping_problems(spark, d):
    none = F.lit(None).cast("string")
    nodes = types_of(spark, d).where("kind = 'node_type'").select("kind", "name", none.alias("source"), none.alias("target"))
    edges = edge_types_of(spark, d).select(F.lit("edge_type").alias("kind"), "name", "source", "target")
    return S.mapping_problems(spark.createDataFrame(PROBE, "kind string, old string, new string"), nodes.union(edges).distinct())


@query("val01_property_issues", """WITH p AS (SELECT DISTINCT stem, type, unnest(map_keys(properties)) AS name FROM nodes WHERE properties IS NOT NULL)
  SELECT stem, 'invalid_property' AS rule, concat_ws('.', type, name) AS element FROM p WHERE NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')
  UNION ALL SELECT stem, 'duplicate_property', concat_ws('.', type, lower(name)) FROM p GROUP BY stem, type, lower(name) HAVING count(*) > 1""")  # fmt: skip
def property_issues(spark, d):
    p = table(spark, d, "nodes").where("properties is not null").select("stem", "type", F.explode(F.map_keys("properties")).alias("name")).distinct().withColumn("datatype", F.lit("string"))
    return S.validate_properties(p, ["stem"]).select("stem", "rule", "element")


@query("prj03_normalized_schema", f"WITH {TYPES_SQL} SELECT stem, version, kind, name, '' AS description, 0 AS n_properties FROM types")
def normalized_schema(spark, d):
    bare = types_of(spark, d).withColumns({"description": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "properties": F.lit(None).cast("map<string,string>")})
    return S.normalized(S.normalized(bare)).select(*SCOPE, "kind", "name", "description", F.size("properties").alias("n_properties"))


@query("join17_version_states", """WITH v AS (SELECT DISTINCT stem, version FROM nodes), a AS (SELECT stem, max(version) AS version FROM v GROUP BY stem), g AS (SELECT DISTINCT stem, version FROM edges)
  SELECT v.stem, v.version, a.version IS NOT NULL AS is_active, g.version IS NOT NULL AS has_edges FROM v LEFT JOIN a USING (stem, version) LEFT JOIN g ON g.stem = v.stem AND g.version = v.version""")  # fmt: skip
def version_states(spark, d):
    v = table(spark, d, "nodes").select(*SCOPE).distinct()
    active = v.groupBy("stem").agg(F.max("version").alias("version")).withColumn("a", F.lit(True))
    graph = table(spark, d, "edges").select(*SCOPE).distinct().withColumn("g", F.lit(True))
    return v.join(active, SCOPE, "left").join(graph, SCOPE, "left").select(*SCOPE, F.col("a").isNotNull().alias("is_active"), F.col("g").isNotNull().alias("has_edges"))


@query("agg20_next_versions", """WITH v AS (SELECT DISTINCT stem, version FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY version DESC) AS k FROM v)
  SELECT stem, max(version) + 1 AS next_version, max(version) FILTER (k = 2) AS fallback FROM r GROUP BY stem""")  # fmt: skip
def next_versions(spark, d):
    return S.next_versions(table(spark, d, "nodes"))


@query("agg14_type_stability", """WITH s AS (SELECT stem, version, list(DISTINCT type) AS names FROM nodes WHERE type IS NOT NULL GROUP BY ALL)
  SELECT a.stem, round(avg(len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names)))), 6) AS stability FROM s a JOIN s b ON a.stem = b.stem AND a.version < b.version GROUP BY a.stem""")  # fmt: skip
def type_stability(spark, d):
    sets = table(spark, d, "nodes").where("type is not null").groupBy(*SCOPE).agg(F.collect_set("type").alias("names"))
    return E.pairwise_jaccard(sets, ["stem"], "version", "names")


@query("set07_type_changes", f"""WITH {TYPES_SQL}, t AS (SELECT stem, name, min(pos) AS pos FROM types WHERE kind = 'node_type' AND version = 1 GROUP BY ALL),
  c AS (SELECT stem, name, min(pos) AS seq FROM types WHERE kind = 'node_type' AND version = 2 GROUP BY ALL)
  SELECT coalesce(t.stem, c.stem) AS stem, coalesce(t.name, c.name) AS name, CASE WHEN t.name IS NULL THEN 'new ' || c.name WHEN c.name IS NULL THEN t.name WHEN lower(c.name) < 'e' THEN 'new ' || c.name ELSE '[DEPRECATED] ' || t.name END AS description
  FROM t FULL JOIN c ON t.stem = c.stem AND t.name = c.name WHERE t.name IS NOT NULL OR lower(c.name) < 'e'""")  # fmt: skip
def type_changes(spark, d):
    """Second versions' types as changes to the first's: names up to D replace or add, the others deprecate."""
    t = types_of(spark, d).where("kind = 'node_type'")
    base = t.where("version = 1").select("stem", "name", "pos", F.col("name").alias("description"))
    decision = F.when(F.lower("name") < "e", "ADD").otherwise("DEPRECATE")
    changes = t.where("version = 2").select("stem", "name", F.col("pos").alias("seq"), decision.alias("decision"), F.concat(F.lit("new "), "name").alias("description"))
    got = S.apply_changes(base, changes, ["stem"])
    return got.select("stem", "name", "description")


@query("src23_active_schema", f"WITH {TYPES_SQL} SELECT stem, kind, name FROM types t WHERE version = (SELECT max(version) FROM types x WHERE x.stem = t.stem)")
def active_schema(spark, d):
    t = types_of(spark, d)
    active = t.groupBy("stem").agg(F.max("version").alias("version"))
    return t.join(active, SCOPE, "left_semi").select("stem", "kind", "name")


@query("src32_domain_types", f"WITH {TYPES_SQL}, dm AS (SELECT lower(document_id) || '_raw' AS stem, min(category) AS domain FROM samsung_life_term WHERE document_id IS NOT NULL GROUP BY 1) SELECT domain, kind, count(DISTINCT name) AS n_types, count(DISTINCT stem) AS n_stems FROM types JOIN dm USING (stem) GROUP BY ALL")
def domain_types(spark, d):
    dm = table(spark, d, "samsung_life_term").where("document_id is not null").groupBy(F.concat(F.lower("document_id"), F.lit("_raw")).alias("stem")).agg(F.min("category").alias("domain"))
    return types_of(spark, d).join(dm, "stem").groupBy("domain", "kind").agg(F.countDistinct("name").alias("n_types"), F.countDistinct("stem").alias("n_stems"))


@query("agg02_mean_coverage", "WITH i AS (SELECT stem, count(*) FILTER (confidence = 'LOW') AS issue_count, count(*) FILTER (evidence_text IS NULL) AS missing_count FROM nodes GROUP BY stem) SELECT round(avg(issue_count), 6) AS mean_issue_count, round(avg(missing_count), 6) AS mean_missing_count FROM i")
def mean_coverage(spark, d):
    i = table(spark, d, "nodes").groupBy("stem").agg(F.count_if(F.col("confidence") == "LOW").alias("issue_count"), F.count_if(F.col("evidence_text").isNull()).alias("missing_count"))
    return D.coverage(i)


@query("agg03_type_utilization", "SELECT type, round(count(DISTINCT stem) / (SELECT count(DISTINCT stem) FROM nodes), 6) AS utilization FROM nodes WHERE type IS NOT NULL GROUP BY type")
def type_utilization(spark, d):
    n = table(spark, d, "nodes")
    return D.utilization(n.where("type is not null").select("type"), n, n)


@query("agg04_type_consistency", """WITH docs AS (SELECT stem, sum(length(coalesce(text, ''))) AS chars FROM chunks GROUP BY stem), t AS (SELECT DISTINCT type FROM nodes WHERE type IS NOT NULL), n AS (SELECT stem, type, count(*) AS n FROM nodes GROUP BY ALL)
  SELECT t.type, round(stddev_pop(CASE WHEN chars > 0 THEN coalesce(n.n, 0) * 1000.0::DOUBLE / chars ELSE 0 END), 4) AS deviation FROM t CROSS JOIN docs LEFT JOIN n ON n.type = t.type AND n.stem = docs.stem GROUP BY t.type""")  # fmt: skip
def type_consistency(spark, d):
    docs = table(spark, d, "chunks").groupBy("stem").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    n = table(spark, d, "nodes").where("type is not null")
    return D.consistency(n.select("type"), n.groupBy("stem", "type").agg(F.count("*").alias("n")), docs)


@query("agg05_question_success", "SELECT count(*) AS n, round(avg(CAST(answerable AS INT)), 6) AS success FROM (SELECT stem, id, bool_or(answerable) AS answerable FROM goldenset GROUP BY ALL)")
def question_success(spark, d):
    q = table(spark, d, "goldenset").groupBy("stem", "id").agg(F.bool_or("answerable").alias("a"))
    return q.agg(F.count("*").alias("n"), F.round(F.avg(F.col("a").cast("int")), 6).alias("success"))


PROPOSAL_SQL = f"""{TYPES_SQL}, dm AS (SELECT lower(document_id) || '_raw' AS stem, min(coalesce(category, '-')) AS domain FROM samsung_life_term WHERE document_id IS NOT NULL GROUP BY 1),
  p AS (SELECT domain, stem, name, min(pos) AS position FROM types JOIN dm USING (stem) WHERE kind = 'node_type' AND name <> '' GROUP BY ALL)"""


def _proposals(spark, d):
    dm = table(spark, d, "samsung_life_term").where("document_id is not null").groupBy(F.concat(F.lower("document_id"), F.lit("_raw")).alias("stem")).agg(F.min(F.coalesce("category", F.lit("-"))).alias("domain"))
    t = types_of(spark, d).where("kind = 'node_type' and name <> ''").join(dm, "stem")
    p = t.groupBy("domain", "stem", "name").agg(F.min("pos").alias("position"))
    decision = F.when(F.lower("name") < "c", "NEEDS_HUMAN_REVIEW").when(F.lower("name") < "p", "ADD").otherwise("REJECT")
    return p.withColumns({"decision": decision, "element_type": F.lit("node_type"), "description": F.concat_ws(" ", F.lit("from"), "stem")})


@query("set11_converged_types", f"WITH {PROPOSAL_SQL} SELECT domain, name, 'from ' || max(stem) AS description FROM p WHERE lower(name) >= 'c' AND lower(name) < 'p' GROUP BY ALL")
def converged_types(spark, d):
    """Documents folded into their domain's schema in order: the last document to add a type describes it."""
    seed = spark.createDataFrame([], "domain string, name string, pos long, description string")
    return D.converge(seed, _proposals(spark, d), ["domain"], ["stem"])[0].select("domain", "name", "description")


@query("set11_pending_types", f"WITH {PROPOSAL_SQL} SELECT domain, stem, name FROM p WHERE lower(name) < 'c'")
def pending_types(spark, d):
    seed = spark.createDataFrame([], "domain string, name string, pos long, description string")
    return D.converge(seed, _proposals(spark, d), ["domain"], ["stem"])[1].select("domain", "stem", "name")


TYPE_VECTORS_SQL = """dims AS (SELECT label, unnest(range(1, 65)) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM dims GROUP BY ALL), tv AS (SELECT label, list(x ORDER BY k) AS v FROM m GROUP BY label)"""


@query("join10_redundant_types", f"""WITH {TYPE_VECTORS_SQL} SELECT a.label AS a, b.label AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM tv a JOIN tv b ON a.label < b.label
  WHERE round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) >= 0.05""")  # fmt: skip
def redundant_types(spark, d):
    """Types, each the mean of its members' vectors, compared with each other."""
    dims = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("vector"))
    types = vectors.select(F.lit("node_type").alias("kind"), F.col("label").alias("pos"), F.col("label").alias("name"), "vector")
    return S.redundant_types(types, 0.05).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "score")


@query("flt14_valid_analysis", f"""WITH {TYPES_SQL}, nt AS (SELECT DISTINCT stem, version, name FROM types WHERE kind = 'node_type'), et AS (SELECT DISTINCT stem, version, name FROM types WHERE kind = 'edge_type'), sc AS (SELECT DISTINCT stem, version FROM nodes),
  pr AS (SELECT DISTINCT stem, version, type FROM nodes WHERE properties IS NOT NULL AND list_contains(map_keys(properties), 'amount')),
  has AS (SELECT sc.*, EXISTS (SELECT 1 FROM nt WHERE nt.stem = sc.stem AND nt.version = sc.version AND name = 'Coverage') AS c, EXISTS (SELECT 1 FROM nt WHERE nt.stem = sc.stem AND nt.version = sc.version AND name = 'Benefit') AS b,
    EXISTS (SELECT 1 FROM et WHERE et.stem = sc.stem AND et.version = sc.version AND name = 'LIMITS') AS l, EXISTS (SELECT 1 FROM pr WHERE pr.stem = sc.stem AND pr.version = sc.version AND type = 'Benefit') AS p FROM sc)
  SELECT stem, version, concat_ws(',', CASE WHEN c THEN 'Coverage' END, CASE WHEN b THEN 'Benefit' END, CASE WHEN EXISTS (SELECT 1 FROM nt WHERE nt.stem = has.stem AND nt.version = has.version AND name = 'coverage') THEN 'coverage' END, CASE WHEN c THEN 'Coverage' END) AS node_types, CASE WHEN l THEN 'LIMITS' ELSE '' END AS edge_types,
    CASE WHEN c THEN 'Coverage' ELSE '' END AS keyword_types, CASE WHEN b AND p THEN 'Benefit' ELSE '' END AS filter_types FROM has""")  # fmt: skip
def valid_analysis(spark, d):
    """One analysis, invented names and all, asked of every stem and version."""
    t = types_of(spark, d)
    p = table(spark, d, "nodes").where("properties is not null").select(*SCOPE, "type", F.explode(F.map_keys("properties")).alias("name")).distinct()
    lists = F.array(*map(F.lit, ("Coverage", "Invented", "Benefit", "coverage", "Coverage")))
    words = F.create_map(F.lit("Coverage"), F.array(F.lit("암")), F.lit("Invented"), F.array(F.lit("x")), F.lit("Premium"), F.array(F.lit("y")))
    told = lambda prop, op, value: F.struct(F.lit(prop).alias("property"), F.lit(op).alias("operator"), F.lit(value).cast("string").alias("value"))
    filters = F.create_map(F.lit("Benefit"), told("amount", "gte", 5), F.lit("Coverage"), told("nothing", "gte", 5), F.lit("Invented"), told("amount", "like", 5))
    scopes = table(spark, d, "nodes").select(*SCOPE).distinct()
    asked = scopes.select(F.concat_ws("/", *SCOPE).alias("key"), *SCOPE, lists.alias("node_types"), F.array(F.lit("LIMITS"), F.lit("INVENTS")).alias("edge_types"), words.alias("keywords"), filters.alias("property_filters"))
    kept = S.valid_analyses(asked, t, p, SCOPE)
    flat = lambda c: F.array_join(c, ",")
    return kept.select(*SCOPE, flat("node_types").alias("node_types"), flat("edge_types").alias("edge_types"), flat(F.array_sort(F.map_keys("keywords"))).alias("keyword_types"), flat(F.array_sort(F.map_keys("property_filters"))).alias("filter_types"))


@query("join16_unfinished_copies", f"""WITH {TYPES_SQL}, k AS (SELECT stem, version, sha256(string_agg(DISTINCT kind || ':' || name, chr(10) ORDER BY kind || ':' || name)) AS digest FROM types GROUP BY ALL),
  nx AS (SELECT stem, max(version) + 1 AS version, arg_max(digest, version) AS digest FROM k GROUP BY stem) SELECT nx.stem, nx.version, max(k.version) AS copy_of FROM nx JOIN k USING (stem, digest) GROUP BY nx.stem, nx.version""")  # fmt: skip
def unfinished_copies(spark, d):
    """The newest schema of every document copied as its active next version, which has no graph yet."""
    t = types_of(spark, d)
    newest = t.groupBy("stem").agg(F.max("version").alias("version"))
    copies = t.join(newest, SCOPE, "left_semi").withColumn("version", F.col("version") + 1)
    return S.unfinished_copies(t.unionByName(copies), copies.select(*SCOPE).distinct(), table(spark, d, "nodes").select(*SCOPE))


@query("src30_reused_schemas", f"""WITH {TYPES_SQL}, v AS (SELECT stem, max(version) AS version FROM types GROUP BY stem), dm AS (SELECT lower(document_id) || '_raw' AS stem, min(coalesce(category, '-')) AS domain FROM samsung_life_term WHERE document_id IS NOT NULL GROUP BY 1),
  f AS (SELECT domain, min(stem) AS source FROM dm JOIN v USING (stem) GROUP BY domain) SELECT v.stem, v.version + 1 AS version, t.kind, t.name FROM v JOIN dm USING (stem) JOIN f USING (domain) JOIN v s ON s.stem = f.source JOIN types t ON t.stem = s.stem AND t.version = s.version WHERE v.stem <> f.source""")  # fmt: skip
def reuse_schema(spark, d):
    """Every document takes over the active schema of the first document of its category."""
    t = types_of(spark, d).select(*SCOPE, "kind", "name")
    active = t.groupBy("stem").agg(F.max("version").alias("version"))
    dm = table(spark, d, "samsung_life_term").where("document_id is not null").groupBy(F.concat(F.lower("document_id"), F.lit("_raw")).alias("stem")).agg(F.min(F.coalesce("category", F.lit("-"))).alias("domain"))
    own = dm.join(active.select("stem"), "stem")
    pairs = own.join(own.groupBy("domain").agg(F.min("stem").alias("source")), "domain").where("stem <> source").select("stem", "source")
    return S.reused_schemas(t, active, pairs)


@query("set12_persisted_convergence", """WITH dm AS (SELECT lower(document_id) || '_raw' AS stem, min(coalesce(category, '-')) AS domain FROM samsung_life_term WHERE document_id IS NOT NULL GROUP BY 1),
  e AS (SELECT domain, stem, type AS change_id, confidence FROM edges JOIN dm USING (stem)), done AS (SELECT DISTINCT domain, change_id FROM e WHERE confidence = 'HIGH')
  SELECT domain, 'stem' AS part, stem AS value, NULL::BIGINT AS n FROM e GROUP BY domain, stem UNION ALL SELECT domain, 'history', NULL, count(DISTINCT stem) FROM e GROUP BY domain
  UNION ALL SELECT domain, 'pending', change_id, count(*) FROM e WHERE confidence IS NULL AND NOT EXISTS (SELECT 1 FROM done WHERE done.domain = e.domain AND done.change_id IS NOT DISTINCT FROM e.change_id) GROUP BY domain, change_id""")  # fmt: skip
def persisted_convergence(spark, d):
    """Two runs over a domain's documents: stems united, history and queue appended, resolved changes out of the queue; a null id only matches a null id."""
    dm = table(spark, d, "samsung_life_term").where("document_id is not null").groupBy(F.concat(F.lower("document_id"), F.lit("_raw")).alias("stem")).agg(F.min(F.coalesce("category", F.lit("-"))).alias("domain"))
    e = table(spark, d, "edges").join(dm, "stem").select("domain", "stem", F.col("type").alias("change_id"), "confidence", "version")
    store = D.DomainStore(spark, shared_folder(spark, "domains"))
    first = e.groupBy("domain", "stem").agg(F.min("version").alias("first"))
    for later in (False, True):
        own = e.join(first, ["domain", "stem"]).where((F.col("version") > F.col("first")) == F.lit(later))
        stems = own.select("domain", "stem").distinct()
        told = e.select("domain", "stem").distinct().join(first.where(F.lit(not later)), ["domain", "stem"], "left_semi")
        store.append_run(stems, told, own.where("confidence is null").select("domain", "change_id"))
    store.resolve(e.where("confidence = 'HIGH'").select("domain", "change_id").distinct())
    none = F.lit(None).cast("string")
    history = store.history().groupBy("domain").agg(F.count("*").alias("n")).select("domain", F.lit("history").alias("part"), none.alias("value"), "n")
    pending = store.pending().groupBy("domain", "change_id").agg(F.count("*").alias("n")).select("domain", F.lit("pending"), "change_id", "n")
    return store.stems().select("domain", F.lit("stem").alias("part"), F.col("stem").alias("value"), F.lit(None).cast("long").alias("n")).union(history).union(pending)
