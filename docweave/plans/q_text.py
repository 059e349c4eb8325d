"""Text functions over whole text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import table_markdown
from .registry import query, table

S = r"[\s\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ARTICLE_SQL = r"제\s*(\p{Nd}+(?:-\p{Nd}+)?)\s*조(?:\s*의\s*(\p{Nd}+))?\s*\(((?:[^()]|\([^()]*\))*)\)\s*$"
LINES_SQL = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


def _lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("src01_document_text", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def document_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


@query("str01_policy_headings", f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS n_articles FROM ln
  WHERE regexp_matches(regexp_replace(line, '^\\s*#+\\s*', ''), '^{ARTICLE_SQL}') GROUP BY doc_id""")  # fmt: skip
def policy_headings(spark, d):
    marked = table(spark, d, "documents").select("doc_id", T.policy_headings(F.col("text")).alias("text"))
    found = marked.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("^### " + T.PLAIN_ARTICLE[1:]))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_articles"))


@query("str03_clean_text", f"""SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), '(?m) +$', '', 'g'), '^{S}+|{S}+$', '', 'g') AS text
  FROM chunks""")  # fmt: skip
def clean_text(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.clean_text(F.col("text")).alias("text"))


@query("str03_clean_cell", """SELECT node_no, replace(trim(regexp_replace(detail, '[ \\t]+', ' ', 'g')), '|', '\\|') AS cell FROM nodes""")
def clean_cell(spark, d):
    return table(spark, d, "nodes").select("node_no", T.clean_cell(F.col("detail")).alias("cell"))


@query("str06_article_headings", f"""WITH {LINES_SQL}, a AS (SELECT doc_id, regexp_extract(line, '^(?:###\\s*)?{ARTICLE_SQL}', ['no', 'sub', 'title']) AS m FROM ln
    WHERE regexp_matches(line, '^(?:###\\s*)?{ARTICLE_SQL}'))
  SELECT doc_id, m.no AS article_no, nullif(m.sub, '') AS sub_no, m.title AS title, count(*) AS n FROM a GROUP BY ALL""")  # fmt: skip
def article_headings(spark, d):
    found = _lines(spark, d).withColumn("h", T.article_heading(F.col("line"))).where("h is not null")
    return found.groupBy("doc_id", "h.article_no", "h.sub_no", "h.title").agg(F.count("*").alias("n"))


@query("str07_section_headings", """WITH p AS (SELECT DISTINCT unnest(string_split(path, ' > ')) AS line FROM chunks),
  s AS (SELECT line, regexp_extract(line, '^(?:##\\s*)?제\\s*(\\d+)\\s*(편|장|절|관)(?:\\s+(.*?))?\\s*$', ['no', 'level', 'title']) AS m FROM p)
  SELECT line, m.level AS level, m.no AS no, m.title AS title FROM s WHERE m.no <> '' AND NOT regexp_matches(m.title, '\\s\\d{1,4}$|제\\s*\\d+(?:-\\d+)?\\s*조')""")  # fmt: skip
def section_headings(spark, d):
    parts = table(spark, d, "chunks").select(F.explode(F.split("path", " > ")).alias("line")).distinct()
    return parts.withColumn("h", T.section_heading(F.col("line"))).where("h is not null").select("line", "h.level", "h.no", "h.title")


@query("str10_body_text", f"""SELECT chunk_id, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '---' AND NOT starts_with(trim(x), '<!-- page:')), chr(10)),
  '^{S}+|{S}+$', '', 'g') AS body FROM chunks""")  # fmt: skip
def body_text(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.body_text(F.split("text", "\n")).alias("body"))


@query("str14_rider_name_keys", f"""SELECT DISTINCT rider_name, translate(regexp_replace(regexp_replace(regexp_replace(rider_name, '^{S}*#*', ''), '{S}+', '', 'g'), '약관$', ''), '∙ㆍ•‧·', '') AS key,
  length(replace(rider_name, '(', '')) = length(replace(rider_name, ')', '')) AND length(replace(rider_name, '[', '')) = length(replace(rider_name, ']', '')) AS balanced
  FROM chunks WHERE rider_name IS NOT NULL""")  # fmt: skip
def rider_name_keys(spark, d):
    names = table(spark, d, "chunks").where("rider_name is not null").select("rider_name").distinct()
    return names.select("rider_name", T.rider_name_key(F.col("rider_name")).alias("key"), T.brackets_balance(F.col("rider_name")).alias("balanced"))


@query("str15_fact_in_text", f"""WITH f AS (SELECT g.quote_id, regexp_replace(lower(g.answer), '{S}+', '', 'g') AS a, regexp_replace(lower(c.text), '{S}+', '', 'g') AS t,
    list_transform(regexp_extract_all(lower(g.answer), '[a-z]*\\d[\\d,.]*[a-z가-힣%]*'), lambda x: regexp_replace(x, '{S}+', '', 'g')) AS figures
    FROM goldenset g JOIN chunks c USING (chunk_id) WHERE g.answer IS NOT NULL AND c.text IS NOT NULL),
  b AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) AS grams FROM f)
  SELECT quote_id, len(list_filter(figures, lambda x: NOT contains(t, x))) = 0 AND CASE WHEN len(grams) < 3 THEN contains(t, a)
    ELSE len(list_filter(grams, lambda g: contains(t, g))) / len(grams) >= CASE WHEN len(figures) > 0 THEN 0.5 ELSE 0.8 END END AS stated FROM b""")  # fmt: skip
def fact_in_text(spark, d):
    texts = table(spark, d, "chunks").where("text is not null").select("chunk_id", "text")
    gold = table(spark, d, "goldenset").where("answer is not null").select("quote_id", "chunk_id", "answer").join(texts, "chunk_id")
    return gold.select("quote_id", T.fact_stated(F.col("answer"), F.col("text")).alias("stated"))


@query("str18_quote_lines", """SELECT quote_id, 1 + length(left(c.text, strpos(c.text, quote) - 1)) - length(replace(left(c.text, strpos(c.text, quote) - 1), chr(10), '')) AS line_start,
  1 + length(left(c.text, strpos(c.text, quote) - 1)) - length(replace(left(c.text, strpos(c.text, quote) - 1), chr(10), '')) + length(quote) - length(replace(quote, chr(10), '')) AS line_end
  FROM goldenset g JOIN chunks c USING (chunk_id) WHERE strpos(c.text, quote) > 0 AND quote <> ''""")  # fmt: skip
def quote_lines(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    gold = table(spark, d, "goldenset").select("quote_id", "chunk_id", "quote").join(texts, "chunk_id")
    span = T.line_span(F.col("text"), F.col("quote"))
    return gold.withColumn("s", span).where("s is not null").select("quote_id", F.col("s.line_start").cast("long").alias("line_start"), F.col("s.line_end").cast("long").alias("line_end"))


@query("str17_cited_spans", """SELECT node_no, strpos(c.text, evidence_text) - 1 AS start_at, strpos(c.text, evidence_text) - 1 + length(evidence_text) AS end_at
  FROM nodes n JOIN chunks c USING (chunk_id) WHERE evidence_text <> '' AND strpos(c.text, evidence_text) > 0""")  # fmt: skip
def cited_spans(spark, d):
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    cited = table(spark, d, "nodes").select("node_no", "chunk_id", "evidence_text").join(texts, "chunk_id").withColumn("at", T.find(F.col("text"), F.col("evidence_text")))
    return cited.where("at is not null").select("node_no", F.col("at").cast("long").alias("start_at"), (F.col("at") + F.length("evidence_text")).cast("long").alias("end_at"))


@query("str23_fingerprints", """SELECT chunk_id, sha256('{"operation":{"name":"extract_graph","max_tokens":8192},"stage":"extract"' || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) END || '}') AS fingerprint FROM chunks""")
def fingerprints(spark, d):
    parts = {"stage": F.lit("extract"), "operation": F.struct(F.lit("extract_graph").alias("name"), F.lit(8192).alias("max_tokens")), "text": F.col("text")}
    return table(spark, d, "chunks").select("chunk_id", T.fingerprint(parts).alias("fingerprint"))


@query("hsh01_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def sha256(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("str25_file_stems", "SELECT doc_id, lower(source) || '_raw' AS stem FROM (SELECT doc_id, source FROM documents WHERE source IS NOT NULL)")
def file_stems(spark, d):
    named = table(spark, d, "documents").where("source is not null").select("doc_id", F.concat(F.lit("in/"), "source", F.lit(".md")).alias("name"))
    return named.select("doc_id", F.concat(T.file_stem(F.col("name")), F.lit("_raw")).alias("stem"))


@query("str26_match_keys", f"""SELECT node_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(evidence_text, ''), '^#{{1,6}}\\s*', ''), '^[-*]\\s+', ''), '^>\\s?', ''), '[|*`_]', '', 'g'), '{S}+', '', 'g') AS key,
  regexp_replace(regexp_replace(lower(coalesce(evidence_text, '')), '{S}+', ' ', 'g'), '^ +| +$', '', 'g') AS search FROM nodes""")  # fmt: skip
def match_keys(spark, d):
    return table(spark, d, "nodes").select("node_no", T.match_key(F.col("evidence_text")).alias("key"), T.search_key(F.col("evidence_text")).alias("search"))


@query("str26_quote_ranges", """WITH q AS (SELECT quote_id, quote, c.text FROM goldenset JOIN chunks c USING (chunk_id) WHERE quote <> '' AND c.text IS NOT NULL)
  SELECT quote_id, CASE WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 ELSE strpos(text, left(quote, 20)) - 1 END AS start_at,
  CASE WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 + length(quote) ELSE strpos(text, left(quote, 20)) + 19 END AS end_at
  FROM q WHERE strpos(text, quote) > 0 OR (length(quote) > 20 AND strpos(text, left(quote, 20)) > 0)""")  # fmt: skip
def quote_ranges(spark, d):
    gold = table(spark, d, "goldenset").select("quote_id", "chunk_id", "quote").join(table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id")
    found = gold.withColumn("m", T.prefix_match(F.col("text"), F.col("quote"))).where("m is not null")
    return found.select("quote_id", F.col("m.start").cast("long").alias("start_at"), F.col("m.end").cast("long").alias("end_at"))


@query("str27_line_counts", "SELECT chunk_id, CAST(line_end - line_start + 1 AS BIGINT) AS n_lines FROM chunks")
def line_counts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", (F.col("line_end") - F.col("line_start") + 1).cast("long").alias("n_lines"))


@query("str28_article_parts", """SELECT chunk_id, CAST(split_part(article_no, '-', 1) AS BIGINT) AS part, try_cast(nullif(split_part(article_no, '-', 2), '') AS BIGINT) AS sub_part,
  sub_no IS NULL AND (article_no = '1' OR regexp_matches(article_no, '^\\d+-1$')) AS is_first FROM chunks WHERE article_no IS NOT NULL""")  # fmt: skip
def article_parts(spark, d):
    rows = table(spark, d, "chunks").where("article_no is not null").withColumn("p", T.article_parts(F.col("article_no")))
    at = lambda k: F.get("p", F.lit(k)).cast("long")
    return rows.select("chunk_id", at(0).alias("part"), at(1).alias("sub_part"), T.is_first_article(F.col("article_no"), F.col("sub_no")).alias("is_first"))


@query("str29_question_keys", f"""SELECT quote_id, regexp_replace(regexp_replace(lower(question), '{S}+', ' ', 'g'), '^ +| +$', '', 'g') AS key FROM goldenset""")
def question_keys(spark, d):
    return table(spark, d, "goldenset").select("quote_id", T.question_key(F.col("question")).alias("key"))


@query("mth02_arithmetic", """SELECT lang, CAST(ceil(count(*) / 7) AS BIGINT) AS batches, count(*) // 7 AS whole, count(*) % 7 AS rest,
  round(avg(length(text)), 4) AS mean_chars, round(stddev_pop(length(text)), 4) AS spread FROM documents WHERE text IS NOT NULL GROUP BY lang""")  # fmt: skip
def arithmetic(spark, d):
    n = F.count("*")
    return table(spark, d, "documents").where("text is not null").groupBy("lang").agg(
        F.ceil(n / 7).alias("batches"), F.floor(n / 7).alias("whole"), (n % 7).alias("rest"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.round(F.stddev_pop(F.length("text")), 4).alias("spread")
    )


@query("dat01_stamps", "SELECT chunk_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS stamp, strftime(created_at, '%Y%m%dT%H%M%S') AS archive FROM chunks")
def stamps(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.date_format("created_at", "yyyyMMdd'T'HHmmss").alias("archive"))


@query("flt22_length_guard", "SELECT doc_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def length_guard(spark, d):
    """Lengths of all texts behind the guard; one over the limit would end the query."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(T.length_guarded(F.col("text"))).cast("long").alias("n_chars"))


@query("str20_item_texts", f"""WITH g AS (SELECT id, label FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY node_no) = 1)
  SELECT 'node' AS kind, node_no AS no, md5(coalesce(CASE WHEN length(detail) > 0 THEN label || ': ' || detail ELSE label END, '') || ' ' || CASE WHEN len(map_values(coalesce(properties, MAP {{}}))) > 0 THEN array_to_string(list_transform(map_values(properties), lambda v: coalesce(v, 'None')), ' ') || ' ' ELSE '' END || coalesce(evidence_text, '')) AS digest FROM nodes
  UNION ALL SELECT 'edge', edge_no, md5(CASE WHEN length(e.detail) > 0 THEN e.detail ELSE coalesce(s.label, '') || ' ' || coalesce(e.type, '') || ' ' || coalesce(t.label, '') END || ' ') FROM edges e LEFT JOIN g s ON s.id = e.source LEFT JOIN g t ON t.id = e.target""")  # fmt: skip
def item_texts(spark, d):
    """Nodes with property values and evidence, edges by their detail or their ends."""
    n = table(spark, d, "nodes")
    nodes = n.select(F.lit("node").alias("kind"), F.col("node_no").alias("no"), T.item_text(T.node_text(F.col("label"), F.col("detail")), F.col("properties"), F.col("evidence_text")).alias("text"))
    labels = n.groupBy("id").agg(F.min_by("label", "node_no").alias("label"))
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label")) for x in ("source", "target"))
    e = table(spark, d, "edges").join(a, "source", "left").join(b, "target", "left")
    said = T.edge_text(F.col("detail"), F.col("source_label"), F.col("type"), F.col("target_label"))
    edges = e.select(F.lit("edge"), "edge_no", T.item_text(said, F.create_map().cast("map<string,string>"), F.lit(None).cast("string")))
    return nodes.union(edges).select("kind", "no", F.md5("text").alias("digest"))


@query("map01_property_maps", "SELECT node_no, properties['amount'] AS amount, len(map_keys(properties)) AS n FROM nodes WHERE properties IS NOT NULL")
def property_maps(spark, d):
    """Property maps taken apart into keys and values and built again, and read by key."""
    rebuilt = F.map_from_arrays(F.map_keys("properties"), F.transform(F.map_values("properties"), lambda v: v.cast("string")))
    n = table(spark, d, "nodes").where("properties is not null").select("node_no", rebuilt.alias("p"))
    return n.select("node_no", F.try_element_at("p", F.lit("amount")).alias("amount"), F.size("p").cast("long").alias("n"))


@query("str05_cover_pages", """SELECT stem, '**보험코드:** ' || 'G' || lpad(CAST(min(chunk_id) AS VARCHAR), 9, '0') || chr(10) || chr(10) || '# ' || min(section_label) || chr(10) || chr(10) || '> ※ 안내' || chr(10) || chr(10) || '제1관 목적' AS page
  FROM chunks WHERE section_label IS NOT NULL GROUP BY stem""")  # fmt: skip
def cover_pages(spark, d):
    """A cover made of each document's first chunk number and section, styled."""
    made = table(spark, d, "chunks").where("section_label is not null").groupBy("stem").agg(F.min("chunk_id").alias("k"), F.min("section_label").alias("name"))
    lines = F.array(F.lit(""), F.concat(F.lit("G"), F.lpad(F.col("k").cast("string"), 9, "0")), F.col("name"), F.lit(""), F.lit("※ 안내"), F.lit("제1관 목적"))
    return made.select("stem", F.array_join(T.cover_page(lines), "\n").alias("page"))


@query("str04_table_markdown", """WITH c AS (SELECT node_no, list_transform([label, type, detail, confidence], lambda x: trim(regexp_replace(replace(coalesce(x, ''), '|', '\\|'), '\\s*\\n\\s*', '<br>', 'g'))) AS c FROM nodes)
  SELECT node_no, CASE WHEN len(list_filter(c, lambda x: x <> '')) >= 3 THEN '| ' || c[1] || ' | ' || c[2] || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c[3] || ' | ' || c[4] || ' |' END AS markdown FROM c""")  # fmt: skip
def table_markdowns(spark, d):
    """Two rows of a node's fields around an empty column, with an empty row below, as a Markdown table."""
    none = F.lit(None).cast("string")
    cells = F.array(F.array("label", none, "type"), F.array("detail", F.lit(""), "confidence"), F.array(none, none, none))
    return table(spark, d, "nodes").select("node_no", table_markdown(cells).alias("markdown"))
