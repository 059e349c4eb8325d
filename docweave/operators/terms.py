"""Catalogue terms: validity, unique names, merging of listings, search and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key


def is_valid() -> Column:
    """Name, code, date and document id are all there."""
    test = F.lit(True)
    for name in ("name", "goods_code", "sale_date", "document_id"):
        test = test & F.coalesce(F.trim(F.col(name)) != "", F.lit(False))
    return test


def keyed(terms: DataFrame) -> DataFrame:
    """terms with name_key; as many rows, one Arrow pass."""
    return terms.withColumn("name_key", name_key(F.trim(F.col("name"))))


def unique_terms(terms: DataFrame, order: str = "term_id") -> DataFrame:
    """The first valid row of every name key; invalid rows do not claim a key."""
    valid = keyed(terms.where(is_valid()))
    columns = [c for c in valid.columns if c != "name_key"]
    return valid.groupBy("name_key").agg(F.min_by(F.struct(*columns), order).alias("t")).select("name_key", "t.*")


def current_then_historical(terms: DataFrame) -> DataFrame:
    """Current terms, and the historical ones whose names no current term has; `listing` is 0 or 1."""
    unique = {flag: unique_terms(terms.where(F.coalesce("currently_listed", F.lit(False)) == flag)) for flag in (True, False)}
    rest = unique[False].join(unique[True].select("name_key"), "name_key", "left_anti")
    return unique[True].withColumn("listing", F.lit(0)).unionByName(rest.withColumn("listing", F.lit(1)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """New records replace old ones of the same keys at the old position; others are appended behind, in their order."""
    values = [c for c in new.columns if c not in (*keys, position)]
    a = old.select(*keys, F.col(position).alias("old_position"), F.struct(*values).alias("old"))
    b = new.select(*keys, F.col(position).alias("new_position"), F.struct(*values).alias("new"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.alias("a").join(b.alias("b"), same, "full_outer")
    chosen = F.coalesce("new", "old")
    return joined.select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys),
        F.struct(F.when(F.col("old_position").isNotNull(), 0).otherwise(1).alias("appended"), F.coalesce("old_position", "new_position").alias("at")).alias("place"),
        *(chosen[v].alias(v) for v in values),
    )


def search(terms: DataFrame, part: str, categories: list[str] | None = None) -> DataFrame:
    """Terms whose name key contains the key of `part`, current first."""
    found = current_then_historical(terms if categories is None else terms.where(F.col("category").isin(*categories)))
    return found.where(F.contains("name_key", name_key(F.lit(part)))).orderBy("listing", F.desc("sale_date"), "term_id")


def resolve_names(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted name: found, not found or ambiguous, and the categories it occurs in."""
    keys = wanted.select("name").distinct().withColumn("name_key", name_key(F.trim(F.col("name"))))
    joined = keys.join(keyed(terms.where(is_valid())).select("name_key", "category", "term_id"), "name_key", "left")
    hits = F.count("term_id")
    return joined.groupBy("name").agg(
        F.when(hits == 0, "not found").when(hits == 1, "found").otherwise("ambiguous").alias("outcome"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )


def facet_counts(terms: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows per value, values without rows included."""
    spark = terms.sparkSession
    counted = terms.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(v,) for v in values], "value string").join(counted, "value", "left").fillna(0, ["n"])


def growth(terms: DataFrame, held: DataFrame, per_category: int) -> DataFrame:
    """The next `per_category` unique terms of each category that are not held yet, newest sales first."""
    from pyspark.sql import Window

    fresh = unique_terms(terms).join(held.select("document_id").distinct(), "document_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("sale_date"), "term_id"))
    return fresh.withColumn("place", place).where(F.col("place") <= per_category)
