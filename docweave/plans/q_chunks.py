"""Chunking, packing and chunk sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from .registry import query, table

LIMIT_EXTRACT, LIMIT_DISCOVER = 3000, 12000


def _packing_sql(limit: int) -> str:
    return f"""WITH RECURSIVE c AS (SELECT stem, chunk_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY stem ORDER BY chunk_id) AS k FROM chunks),
  p AS (SELECT stem, chunk_id, k, 1 AS g, n AS used FROM c WHERE k = 1
    UNION ALL SELECT c.stem, c.chunk_id, c.k, CASE WHEN p.used + c.n > {limit} THEN p.g + 1 ELSE p.g END, CASE WHEN p.used + c.n > {limit} THEN c.n ELSE p.used + c.n END
    FROM p JOIN c ON c.stem = p.stem AND c.k = p.k + 1)
  SELECT chunk_id, CAST(g AS BIGINT) AS group_index FROM p"""


for _name, _limit in (("win01_packing_extract", LIMIT_EXTRACT), ("win01_packing_discover", LIMIT_DISCOVER)):

    @query(_name, _packing_sql(_limit))
    def packing(spark, d, limit=_limit):
        return K.packed_groups(table(spark, d, "chunks"), "stem", "chunk_id", limit).select("chunk_id", F.col("group_index").cast("long").alias("group_index"))


@query("str22_group_texts", f"""WITH RECURSIVE c AS (SELECT stem, chunk_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY stem ORDER BY chunk_id) AS k FROM chunks),
  p AS (SELECT stem, chunk_id, k, 1 AS g, n AS used FROM c WHERE k = 1
    UNION ALL SELECT c.stem, c.chunk_id, c.k, CASE WHEN p.used + c.n > {LIMIT_EXTRACT} THEN p.g + 1 ELSE p.g END, CASE WHEN p.used + c.n > {LIMIT_EXTRACT} THEN c.n ELSE p.used + c.n END
    FROM p JOIN c ON c.stem = p.stem AND c.k = p.k + 1)
  SELECT stem, CAST(g AS BIGINT) AS group_index, md5(string_agg(CASE WHEN length(path) > 0 THEN '[' || path || ']' || chr(10) ELSE '' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_id)) AS digest
  FROM p JOIN chunks USING (stem, chunk_id) GROUP BY ALL""")  # fmt: skip
def group_texts(spark, d):
    chunks = table(spark, d, "chunks")
    groups = K.packed_groups(chunks, "stem", "chunk_id", LIMIT_EXTRACT)
    return K.group_texts(chunks, groups, "stem", "chunk_id").select("stem", F.col("group_index").cast("long").alias("group_index"), F.md5("text").alias("digest"))


@query("str11_policy_chunks")
def policy_chunks(spark, d):
    made = K.policy_chunks(table(spark, d, "documents"))
    return made.select("doc_id", "chunk_index", "id", "section_label", "rider_type", "article_no", "sub_no", "title", "path", "line_start", "line_end", F.md5("text").alias("digest"))


@query("str11_articles_found", """WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, count(*) AS n_articles FROM ln WHERE regexp_matches(trim(line), '^(?:###\\s*)?제\\s*(\\p{Nd}+(?:-\\p{Nd}+)?)\\s*조(?:\\s*의\\s*(\\p{Nd}+))?\\s*\\(((?:[^()]|\\([^()]*\\))*)\\)\\s*$') GROUP BY doc_id""")  # fmt: skip
def articles_found(spark, d):
    """Article chunks per document, as the chunker finds them."""
    return K.policy_chunks(table(spark, d, "documents")).where("chunk_index > 0").groupBy("doc_id").agg(F.count("*").alias("n_articles"))


LINE_SQL = "ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
MARKED_SQL = r"^###\s*제\s*(\p{Nd}+(?:-\p{Nd}+)?)\s*조(?:\s*의\s*(\p{Nd}+))?\s*\(((?:[^()]|\([^()]*\))*)\)\s*$"


@query("str12_legacy_chunks", f"""WITH {LINE_SQL}, h AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, regexp_extract(line, '{MARKED_SQL}', ['no', 'sub', 'title']) AS m FROM ln WHERE regexp_matches(line, '{MARKED_SQL}'))
  SELECT doc_id, CAST(sum(CASE WHEN m.sub = '' AND (m.no = '1' OR regexp_full_match(m.no, '\\d+-1')) THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) AS section, m.no AS article_no, m.title AS title, line_no, lead(line_no) OVER w AS line_end
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")  # fmt: skip
def legacy_chunks(spark, d):
    """Marked headings only; a rider begins where the numbering starts over."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heads = lines.where(F.col("line").startswith("###")).withColumn("h", T.article_heading(F.col("line"))).where("h is not null")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    restart = T.is_first_article(F.col("h.article_no"), F.col("h.sub_no")).cast("int")
    numbered = heads.withColumn("section", F.sum(restart).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("line_end", F.lead("line_no").over(w))
    return numbered.select("doc_id", "section", "h.article_no", "h.title", "line_no", "line_end")


SEQ = ["stem", "section_index"]


@query("win02_article_sequence", """WITH v AS (SELECT *, CASE WHEN variant IS DISTINCT FROM lag(variant) OVER w THEN 1 ELSE 0 END AS c FROM chunks WHERE article_no IS NOT NULL WINDOW w AS (PARTITION BY stem, section_index ORDER BY chunk_id)),
  r AS (SELECT *, sum(c) OVER (PARTITION BY stem, section_index ORDER BY chunk_id) AS run, list_transform(string_split(article_no, '-'), lambda x: try_cast(x AS INT)) AS p FROM v),
  l AS (SELECT *, lag(p) OVER (PARTITION BY stem, section_index, run ORDER BY chunk_id) AS q,
    row_number() OVER (PARTITION BY stem, section_index, article_no, sub_no, variant ORDER BY chunk_id) AS k FROM r)
  SELECT chunk_id, k > 1 AS duplicate, coalesce(p < q, false) AS regression, rider_type <> 'appendix' AND coalesce(CASE WHEN len(p) = 1 AND len(q) = 1 THEN p[1] > q[1] + 1
    ELSE (p[1] = q[1] AND p[2] > q[2] + 1) OR (p[1] > q[1] AND (p[1] > q[1] + 1 OR p[2] > 1)) END, false) AS gap FROM l""")  # fmt: skip
def article_sequence(spark, d):
    return K.article_sequence(table(spark, d, "chunks").where("article_no is not null"), SEQ, "chunk_id").select("chunk_id", "duplicate", "regression", "gap")


@query("win03_hierarchy_jumps", """WITH a AS (SELECT stem, section_index, chunk_id, rider_type, unnest(ancestors, recursive := true) FROM chunks),
  m AS (SELECT *, try_cast(no AS INT) AS n, coalesce(lag(try_cast(no AS INT), 1, 0) OVER (PARTITION BY stem, section_index, level ORDER BY chunk_id), 0) AS b FROM a)
  SELECT stem, section_index, level, count(*) FILTER (n < b) AS regressions, count(*) FILTER (n > b + 1 AND rider_type <> 'appendix' AND NOT (level = '편' AND b = 0 AND n = 2)) AS skips FROM m GROUP BY ALL""")  # fmt: skip
def hierarchy_jumps(spark, d):
    return K.hierarchy_jumps(table(spark, d, "chunks"), SEQ, "chunk_id").select("stem", "section_index", "level", "regressions", "skips")


@query("win08_section_index", f"""WITH {LINE_SQL} SELECT doc_id, k - 1 AS line_no, CAST(sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS section FROM ln""")
def section_index(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.sum(F.col("line").startswith("#").cast("int")).over(w) - 1).alias("section"))


@query("win09_carried_heading", f"""WITH {LINE_SQL} SELECT doc_id, k - 1 AS line_no, last_value(CASE WHEN starts_with(line, '#') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS heading FROM ln""")
def carried_heading(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(w)
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), heading.alias("heading"))


@query("win10_hierarchy_stack", """WITH a AS (SELECT chunk_id, unnest(ancestors, recursive := true) FROM chunks)
  SELECT chunk_id, string_agg('제' || no || level, '/' ORDER BY CASE level WHEN '편' THEN 0 WHEN '장' THEN 1 WHEN '절' THEN 2 ELSE 3 END) AS stack FROM a GROUP BY chunk_id""")  # fmt: skip
def hierarchy_stack(spark, d):
    """The stack rendered after popping same or deeper levels, by a fold over the ancestors."""
    level_of = F.create_map(*(F.lit(x) for k, v in zip("편장절관", range(4)) for x in (k, v)))
    empty = F.array().cast("array<struct<level:string,no:string,title:string>>")
    fold = F.aggregate("ancestors", empty, lambda s, x: F.array_append(F.filter(s, lambda y: F.element_at(level_of, y["level"]) < F.element_at(level_of, x["level"])), x))
    rows = table(spark, d, "chunks").select("chunk_id", fold.alias("s")).where("size(s) > 0")
    return rows.select("chunk_id", F.array_join(F.transform("s", lambda x: F.concat(F.lit("제"), x["no"], x["level"])), "/").alias("stack"))


@query("win11_chunk_ends", "SELECT chunk_id, coalesce(lead(line_start) OVER (PARTITION BY stem ORDER BY line_start, chunk_id) - 1, line_end) AS end_line FROM chunks")
def chunk_ends(spark, d):
    after = F.lead("line_start").over(Window.partitionBy("stem").orderBy("line_start", "chunk_id"))
    return table(spark, d, "chunks").select("chunk_id", F.coalesce(after - 1, "line_end").alias("end_line"))


@query("agg17_heading_coverage", f"""WITH {LINE_SQL}, c AS (SELECT doc_id, count(*) FILTER (starts_with(line, '### ')) AS candidates,
    count(*) FILTER (regexp_matches(line, '^###\\s*제\\s*\\p{{Nd}}+(?:-\\p{{Nd}}+)?\\s*조(?:\\s*의\\s*\\p{{Nd}}+)?\\s*\\((?:[^()]|\\([^()]*\\))*\\)\\s*$')) AS matched FROM ln GROUP BY doc_id)
  SELECT doc_id, candidates, matched, candidates - matched AS missed FROM c WHERE candidates > 0""")  # fmt: skip
def heading_coverage(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith("### "))
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.count(T.article_heading(F.col("line"))).alias("matched"))
    return counted.select("*", (F.col("candidates") - F.col("matched")).alias("missed"))


@query("set13_contents_sets", """WITH a AS (SELECT DISTINCT stem, rider_name FROM chunks WHERE rider_type = 'rider' AND rider_name IS NOT NULL), b AS (SELECT DISTINCT stem, source_section AS rider_name FROM nodes WHERE source_section IS NOT NULL)
  SELECT coalesce(a.stem, b.stem) AS stem, count(*) FILTER (a.stem IS NOT NULL AND b.stem IS NOT NULL) AS matched, count(*) FILTER (b.stem IS NULL) AS missing, count(*) FILTER (a.stem IS NULL) AS extra
  FROM a FULL JOIN b ON a.stem = b.stem AND a.rider_name = b.rider_name GROUP BY 1""")  # fmt: skip
def contents_sets(spark, d):
    a = table(spark, d, "chunks").where("rider_type = 'rider' and rider_name is not null").select("stem", "rider_name").distinct().withColumn("a", F.lit(True))
    b = table(spark, d, "nodes").where("source_section is not null").select("stem", F.col("source_section").alias("rider_name")).distinct().withColumn("b", F.lit(True))
    both = a.join(b, ["stem", "rider_name"], "full_outer")
    return both.groupBy("stem").agg(F.count_if(F.col("a") & F.col("b")).alias("matched"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


#: Texts with a page marker after every line, whose number comes from the line's length.
PAGED_SQL = """ln AS (SELECT chunk_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL),
  pg AS (SELECT chunk_id, 2 * k - 1 AS line_no, NULL AS mark FROM ln UNION ALL SELECT chunk_id, 2 * k, CAST(length(line) % 50 + 1 AS INT) FROM ln),
  lp AS (SELECT chunk_id, line_no, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 1) AS page FROM pg)"""


def _paged(spark, d):
    marked = F.flatten(F.transform(F.split("text", "\n"), lambda x: F.array(x, F.concat(F.lit("<!-- page: "), (F.length(x) % 50 + 1).cast("string"), F.lit(" -->")))))
    lines = table(spark, d, "chunks").where("text is not null").select("chunk_id", F.posexplode(marked).alias("k", "line"))
    return K.line_pages(lines.select("chunk_id", (F.col("k") + 1).alias("line_no"), "line"), ["chunk_id"])


@query("win12_line_pages", f"WITH {PAGED_SQL} SELECT chunk_id, line_no, page FROM lp")
def line_pages(spark, d):
    return _paged(spark, d)


@query("win13_page_lines", f"WITH {PAGED_SQL} SELECT chunk_id, page, min(line_no) AS first_line, max(page) OVER (PARTITION BY chunk_id) AS n_pages FROM lp GROUP BY chunk_id, page")
def page_lines(spark, d):
    return K.page_starts(_paged(spark, d), ["chunk_id"])


@query("src31_chunk_items", """WITH w AS (SELECT goods_code || '_none' AS stem, min(text) AS text FROM documents WHERE text <> '' AND goods_code IS NOT NULL GROUP BY 1)
  SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY chunk_id) - 1 AS item_index, length(text) AS n_chars FROM chunks UNION ALL SELECT stem, 0, length(text) FROM w""")  # fmt: skip
def chunk_items(spark, d):
    """Documents with chunks give these in order; documents without give their whole text as one item."""
    whole = table(spark, d, "documents").where("text <> '' and goods_code is not null").groupBy(F.concat("goods_code", F.lit("_none")).alias("stem")).agg(F.min("text").alias("text"))
    items = K.chunk_items(table(spark, d, "chunks"), whole, "stem", "chunk_id")
    return items.select("stem", F.col("item_index").cast("long").alias("item_index"), F.length("text").cast("long").alias("n_chars"))


@query("msc04_chunking_report")
def chunking_report(spark, d):
    return K.chunking_report(K.chunking_scores(table(spark, d, "documents")))


CUT_TAIL = "chr(10) || '[section content truncated]'"


@query("str19_compact_documents", f"""WITH long AS (SELECT doc_id, regexp_replace(text, '\\n$', '') AS t FROM documents WHERE length(text) > 2000),
  ln AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS k, unnest(string_split(t, chr(10))) AS line FROM long),
  h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+') AS head, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS sec FROM ln),
  s AS (SELECT doc_id, sec, coalesce(max(line) FILTER (head), '') AS heading, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT head), '') AS body FROM h GROUP BY ALL),
  n AS (SELECT *, count(*) OVER w AS n, sum(length(heading)) OVER w AS heads, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS idx FROM s WINDOW w AS (PARTITION BY doc_id)),
  r AS (SELECT *, CAST(2000 - heads - 2 * (n - 1) AS BIGINT) AS rest FROM n), sh AS (SELECT *, rest // n + CASE WHEN idx < rest % n THEN 1 ELSE 0 END AS share FROM r),
  b AS (SELECT *, CASE WHEN length(body) <= share THEN body WHEN share <= 28 THEN left(body, share) ELSE left(body, share - 28) || {CUT_TAIL} END AS cut FROM sh),
  d AS (SELECT doc_id, left(CASE WHEN any_value(rest) <= 0 THEN string_agg(heading, chr(10) || chr(10) ORDER BY sec) FILTER (heading <> '') ELSE string_agg(heading || CASE WHEN heading <> '' AND cut <> '' THEN chr(10) ELSE '' END || cut, chr(10) || chr(10) ORDER BY sec) END, 2000) AS text FROM b GROUP BY doc_id)
  SELECT doc_id, md5(text) AS digest FROM d UNION ALL SELECT doc_id, md5(text) FROM documents WHERE length(text) <= 2000""")  # fmt: skip
def compact_documents(spark, d):
    return K.compact_documents(table(spark, d, "documents"), 2000).select("doc_id", F.md5("text").alias("digest"))


@query("str13_contents_entries", """WITH n AS (SELECT DISTINCT stem, trim(rider_name) AS name FROM chunks WHERE trim(rider_name) <> ''), f AS (SELECT stem, min(chunk_id) AS doc_id FROM chunks GROUP BY stem)
  SELECT doc_id, 'main' AS kind, 'G' || stem AS name, 0 AS position FROM f UNION ALL SELECT doc_id, 'rider', name, row_number() OVER (PARTITION BY doc_id ORDER BY name) FROM n JOIN f USING (stem)""")  # fmt: skip
def contents_entries(spark, d):
    """Contents written from each document's rider names, long ones wrapped over a page break, and read back."""
    chunks = table(spark, d, "chunks")
    names = chunks.where("trim(rider_name) <> ''").groupBy("stem").agg(F.array_sort(F.collect_set(F.trim("rider_name"))).alias("names"))
    first = chunks.groupBy("stem").agg(F.min("chunk_id").alias("doc_id"))
    # A name of more than twelve letters breaks where no blank stands on either side.
    entry = lambda x, i: F.when((F.length(x) > 12) & ~F.contains(x, F.lit(" ")) & F.contains(F.substr(x, F.lit(1), F.lit(9)), F.lit("특약")) & F.contains(F.substr(x, F.lit(1), F.lit(9)), F.lit("(")) & ~F.contains(F.substr(x, F.lit(1), F.lit(9)), F.lit(")")), F.concat(F.substr(x, F.lit(1), F.lit(9)), F.lit("\n---\n"), F.substr(x, F.lit(10)))).otherwise(x)
    lines = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x, i: F.concat(entry(x, i), F.lit(" "), (i % 900 + 1).cast("string")))
    text = F.concat(F.lit("앞\n상품 목차\n주계약\nG"), "stem", F.lit(" 1\n특약 ※ 안내\n"), F.array_join(lines, "\n"))
    return K.contents_entries(first.join(names, "stem", "left").select("doc_id", text.alias("text")))


RIDER_KEY_SQL = "translate(regexp_replace(regexp_replace(regexp_replace({}, '^\\s*#*', ''), '\\s+', '', 'g'), '약관$', ''), '∙ㆍ•‧·', '')"


@query("agg16_rider_names", f"""WITH s AS (SELECT stem, section_index, arg_min(rider_type, chunk_id) AS rider_type, arg_min(coalesce(rider_name, section_label, ''), chunk_id) AS name, arg_min(coalesce(rider_name_source, ''), chunk_id) AS source FROM chunks WHERE section_index IS NOT NULL GROUP BY ALL),
  r AS (SELECT stem, count(*) FILTER (rider_type IS DISTINCT FROM 'appendix') AS n_sections, count(*) FILTER (rider_type = 'appendix') AS n_appendix, count(*) FILTER (rider_type IS DISTINCT FROM 'appendix' AND source = 'fallback') AS n_fallback,
    count(*) FILTER (rider_type IS DISTINCT FROM 'appendix' AND source <> 'fallback' AND coalesce(rider_type, 'rider') <> 'main' AND (trim(name) = '' OR regexp_matches(trim(name), '^[-#※·|]') OR length(trim(name)) > 90 OR regexp_matches(trim(name), '(?:다\\.|니다)$') OR NOT contains(name, '특약'))) AS n_suspicious FROM s GROUP BY stem),
  f AS (SELECT DISTINCT stem, {RIDER_KEY_SQL.format("name")} AS k FROM s WHERE rider_type IS DISTINCT FROM 'appendix' AND section_index > (SELECT min(section_index) FROM s x WHERE x.stem = s.stem AND x.rider_type IS DISTINCT FROM 'appendix')),
  e AS (SELECT DISTINCT stem, {RIDER_KEY_SQL.format("source_section")} AS k FROM nodes WHERE source_section <> ''),
  c AS (SELECT coalesce(e.stem, f.stem) AS stem, count(*) FILTER (e.k IS NOT NULL AND f.k IS NOT NULL) AS matched, count(*) FILTER (f.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS extra FROM e FULL JOIN f ON e.stem = f.stem AND e.k = f.k GROUP BY 1)
  SELECT r.stem, n_sections, n_appendix, n_fallback, n_suspicious, c.matched, c.missing, c.extra FROM r LEFT JOIN c ON c.stem = r.stem AND r.stem IN (SELECT stem FROM e)""")  # fmt: skip
def rider_names(spark, d):
    """Delivered sections scored against contents made of the sections that nodes name."""
    first = F.struct("rider_type", F.coalesce("rider_name", "section_label", F.lit("")).alias("name"), F.coalesce("rider_name_source", F.lit("")).alias("rider_name_source"))
    sections = table(spark, d, "chunks").where("section_index is not null").groupBy("stem", "section_index").agg(F.min_by(first, "chunk_id").alias("s")).select("stem", "section_index", "s.*")
    named = table(spark, d, "nodes").where("source_section <> ''").select("stem", F.col("source_section").alias("name")).distinct()
    entries = named.select("stem", F.lit("rider").alias("kind"), "name").union(named.select("stem", F.lit("main"), F.lit("main")).distinct())
    riders, contents = K.rider_scores(sections, entries, "stem")
    return riders.join(contents, "stem", "left")


@query("str26_quote_pages", f"""WITH {PAGED_SQL}, q AS (SELECT quote_id, chunk_id, 1 + length(left(text, strpos(text, quote) - 1)) - length(replace(left(text, strpos(text, quote) - 1), chr(10), '')) AS k FROM goldenset JOIN chunks USING (chunk_id) WHERE quote <> '' AND strpos(text, quote) > 0)
  SELECT quote_id, page FROM q JOIN lp ON lp.chunk_id = q.chunk_id AND lp.line_no = 2 * k - 1""")  # fmt: skip
def quote_pages(spark, d):
    """The page on which a quote begins."""
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    q = table(spark, d, "goldenset").where("quote <> ''").join(texts, "chunk_id").select("quote_id", "chunk_id", T.line_span(F.col("text"), F.col("quote")).alias("s")).where("s is not null")
    return q.select("quote_id", "chunk_id", (2 * F.col("s.line_start") - 1).alias("line_no")).join(_paged(spark, d), ["chunk_id", "line_no"]).select("quote_id", "page")


@query("str26_quote_items", """WITH q AS (SELECT quote_id, text, strpos(text, quote) - 1 AS s, strpos(text, quote) - 1 + length(quote) AS e FROM goldenset JOIN chunks USING (chunk_id) WHERE quote <> '' AND strpos(text, quote) > 0),
  i AS (SELECT quote_id, s, e, generate_subscripts(string_split(text, ' '), 1) - 1 AS k, unnest(string_split(text, ' ')) AS item FROM q), o AS (SELECT *, sum(length(item)) OVER (PARTITION BY quote_id ORDER BY k) AS upto FROM i)
  SELECT quote_id, min(k) AS first_item, max(k) AS last_item, count(*) AS n FROM o WHERE upto - length(item) < e AND upto > s GROUP BY quote_id""")  # fmt: skip
def quote_items(spark, d):
    """The pieces of a text, laid end to end without blanks, that a range of it touches."""
    texts = table(spark, d, "chunks").select("chunk_id", "text")
    q = table(spark, d, "goldenset").where("quote <> ''").join(texts, "chunk_id").withColumn("at", T.find(F.col("text"), F.col("quote"))).where("at is not null")
    hit = T.items_in_range(F.split("text", " "), F.col("at"), F.col("at") + F.length("quote"))
    rows = q.select("quote_id", hit.alias("h")).where("size(h) > 0")
    return rows.select("quote_id", F.array_min("h").cast("long").alias("first_item"), F.array_max("h").cast("long").alias("last_item"), F.size("h").cast("long").alias("n"))
