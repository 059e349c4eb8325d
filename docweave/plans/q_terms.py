"""Catalogue queries over samsung_life_term."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import terms as M
from .registry import query, table

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
KEY = f"lower(translate(trim(name), '{WIDE}', '{NARROW}'))"
VALID = "coalesce(trim(name) <> '', false) AND coalesce(trim(goods_code) <> '', false) AND coalesce(trim(sale_date) <> '', false) AND coalesce(trim(document_id) <> '', false)"
UNIQUE = f"u AS (SELECT *, {KEY} AS name_key FROM samsung_life_term WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY term_id) = 1)"
LISTED = f"""u AS (SELECT *, {KEY} AS name_key, coalesce(currently_listed, false) AS cur FROM samsung_life_term WHERE {VALID}
    QUALIFY row_number() OVER (PARTITION BY {KEY}, coalesce(currently_listed, false) ORDER BY term_id) = 1),
  l AS (SELECT *, CASE WHEN cur THEN 0 ELSE 1 END AS listing FROM u WHERE cur OR name_key NOT IN (SELECT name_key FROM u WHERE cur))"""


def _terms(spark, d):
    return table(spark, d, "samsung_life_term")


@query("flt17_valid_terms", f"SELECT term_id FROM samsung_life_term WHERE {VALID}")
def valid_terms(spark, d):
    return _terms(spark, d).where(M.is_valid()).select("term_id")


@query("flt20_facet_filter", "SELECT term_id FROM samsung_life_term WHERE category = '보장성' AND currently_listed")
def facet_filter(spark, d):
    return _terms(spark, d).where((F.col("category") == "보장성") & F.col("currently_listed")).select("term_id")


@query("str24_name_keys", f"SELECT term_id, {KEY} AS key FROM samsung_life_term WHERE name IS NOT NULL")
def name_keys(spark, d):
    return M.keyed(_terms(spark, d).where("name is not null")).select("term_id", F.col("name_key").alias("key"))


@query("str24_safe_file_names", """SELECT term_id, left(trim(regexp_replace(regexp_replace(name, '[\\\\/:*?"<>|]', '_', 'g'), '\\s+', ' ', 'g')), 180) AS file FROM samsung_life_term""")
def safe_file_names(spark, d):
    return _terms(spark, d).select("term_id", T.safe_file_name(F.col("name")).alias("file"))


@query("set15_unique_terms", f"WITH {UNIQUE} SELECT term_id, name_key FROM u")
def unique_terms(spark, d):
    return M.unique_terms(_terms(spark, d)).select("term_id", "name_key")


@query("join12_current_then_historical", f"WITH {LISTED} SELECT term_id, listing FROM l")
def current_then_historical(spark, d):
    return M.current_then_historical(_terms(spark, d)).select("term_id", "listing")


@query("srt03_terms_by_date", f"WITH {UNIQUE} SELECT term_id, row_number() OVER (PARTITION BY category ORDER BY sale_date DESC, term_id) AS place FROM u WHERE category IS NOT NULL")
def terms_by_date(spark, d):
    w = Window.partitionBy("category").orderBy(F.desc("sale_date"), "term_id")
    return M.unique_terms(_terms(spark, d)).where("category is not null").select("term_id", F.row_number().over(w).cast("long").alias("place"))


OLD, NEW = "loaded_at < TIMESTAMP '2022-01-01'", "loaded_at >= TIMESTAMP '2022-01-01'"


@query("set14_upsert_records", f"""WITH k AS (SELECT *, {KEY} AS name_key FROM samsung_life_term WHERE {VALID}),
  o AS (SELECT * FROM k WHERE {OLD} QUALIFY row_number() OVER (PARTITION BY category, name_key ORDER BY term_id) = 1),
  n AS (SELECT * FROM k WHERE {NEW} QUALIFY row_number() OVER (PARTITION BY category, name_key ORDER BY term_id) = 1)
  SELECT coalesce(n.goods_code, o.goods_code) AS goods_code, coalesce(n.status, CASE WHEN n.term_id IS NULL THEN o.status END) AS status,
    CASE WHEN o.term_id IS NULL THEN 1 ELSE 0 END AS appended, coalesce(o.term_id, n.term_id) AS at
  FROM o FULL JOIN n ON o.category IS NOT DISTINCT FROM n.category AND o.name_key = n.name_key""")  # fmt: skip
def upsert_records(spark, d):
    rows = M.keyed(_terms(spark, d).where(M.is_valid()))
    first = lambda df: df.groupBy("category", "name_key").agg(F.min_by(F.struct("term_id", "goods_code", "status"), "term_id").alias("t")).select("category", "name_key", "t.*")
    old, new = (first(rows.where(F.expr(c))) for c in (OLD, NEW))
    done = M.upsert(old, new, ["category", "name_key"], "term_id")
    return done.select("goods_code", "status", F.col("place.appended").alias("appended"), F.col("place.at").alias("at"))


@query("agg21_facet_counts", """SELECT v.value, count(t.term_id) AS n FROM (VALUES ('보장성'), ('저축성'), ('어린이'), ('연금'), ('변액')) v(value)
  LEFT JOIN samsung_life_term t ON t.category = v.value GROUP BY v.value""")  # fmt: skip
def facet_counts(spark, d):
    return M.facet_counts(_terms(spark, d), "category", ["보장성", "저축성", "어린이", "연금", "변액"])


@query("msc11_resolve_names", f"""WITH k AS (SELECT term_id, category, {KEY} AS name_key FROM samsung_life_term WHERE {VALID}),
  w AS (SELECT DISTINCT name, {KEY} AS name_key FROM samsung_life_term WHERE name IS NOT NULL AND term_id % 20 = 0)
  SELECT w.name, CASE count(k.term_id) WHEN 0 THEN 'not found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome,
    coalesce(string_agg(DISTINCT k.category, ',' ORDER BY k.category), '') AS categories FROM w LEFT JOIN k USING (name_key) GROUP BY w.name""")  # fmt: skip
def resolve_names(spark, d):
    terms = _terms(spark, d)
    return M.resolve_names(terms, terms.where("name is not null and term_id % 20 = 0"))


@query("msc12_search_terms", f"WITH {LISTED} SELECT term_id, name, listing FROM l WHERE contains(name_key, '건강')")
def search_terms(spark, d):
    return M.search(_terms(spark, d), "건강").select("term_id", "name", "listing")


@query("src11_incremental_growth", f"""WITH {UNIQUE} SELECT term_id, category, place FROM (
  SELECT term_id, category, row_number() OVER (PARTITION BY category ORDER BY sale_date DESC, term_id) AS place FROM u
  WHERE document_id NOT IN (SELECT document_id FROM samsung_life_term WHERE currently_listed AND document_id IS NOT NULL)) WHERE place <= 3""")  # fmt: skip
def incremental_growth(spark, d):
    terms = _terms(spark, d)
    return M.growth(terms, terms.where("currently_listed"), 3).select("term_id", "category", F.col("place").cast("long").alias("place"))


@query("msc09_toggle_chip", """WITH c AS (SELECT coalesce(status, '-') AS status, list_sort(list_distinct(list(category))) AS chips FROM samsung_life_term WHERE category IS NOT NULL GROUP BY 1)
  SELECT status, array_to_string(CASE WHEN NOT list_contains(chips, '보장성') THEN list_append(chips, '보장성') WHEN len(chips) = 1 THEN chips
    ELSE list_filter(chips, lambda x: x <> '보장성') END, ',') AS chips FROM c""")  # fmt: skip
def toggle_chip(spark, d):
    chips = _terms(spark, d).where("category is not null").groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.array_sort(F.collect_set("category")).alias("chips"))
    has, one = F.array_contains("chips", "보장성"), F.size("chips") == 1
    return chips.select("status", F.array_join(F.when(~has, F.array_append("chips", F.lit("보장성"))).when(one, F.col("chips")).otherwise(F.array_remove("chips", "보장성")), ",").alias("chips"))
