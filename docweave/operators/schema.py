"""Ontology schemas as tables: normalization, validation, versions, merging and evolution.

A schema version is a set of rows (schema_id, kind node_type or edge_type, pos, name, description, source, target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm

IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*\z"
DATATYPES = ("string", "number", "integer", "boolean", "date")


def issue(rule: str, element: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), element.alias("element"), F.lit("error").alias("severity")]


def validate_types(types: DataFrame, scope: list[str]) -> DataFrame:
    """One row an issue: invalid identifiers, node types repeated without regard to case, edge ends that are no node type."""
    nodes, edges = (types.where(F.col("kind") == k) for k in ("node_type", "edge_type"))
    invalid = types.where(~F.coalesce(F.col("name").rlike(IDENTIFIER), F.lit(False))).select(*scope, *issue("invalid_identifier", F.col("name")))
    key = F.lower("name")
    repeated = nodes.groupBy(*scope, key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(*scope, *issue("duplicate_type", F.col("key")))
    declared = nodes.select(*scope, key.alias("end_key")).distinct()
    ends = edges.select(*scope, F.explode(F.array("source", "target")).alias("end")).where("end is not null").distinct().withColumn("end_key", F.lower("end"))
    unknown = ends.join(declared, [*scope, "end_key"], "left_anti").select(*scope, *issue("unknown_endpoint", F.col("end")))
    return invalid.union(repeated).union(unknown)


def validate_properties(properties: DataFrame, scope: list[str]) -> DataFrame:
    """properties: scope, type, name, datatype. Invalid or repeated names within a type and unsupported data types."""
    invalid = properties.where(~F.coalesce(F.col("name").rlike(IDENTIFIER), F.lit(False))).select(*scope, *issue("invalid_property", F.concat_ws(".", "type", "name")))
    repeated = properties.groupBy(*scope, "type", F.lower("name").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(*scope, *issue("duplicate_property", F.concat_ws(".", "type", "key")))
    odd = properties.where(~F.coalesce(F.col("datatype").isin(*DATATYPES), F.lit(False))).select(*scope, *issue("unsupported_datatype", F.concat_ws(".", "type", "name")))
    return invalid.union(repeated).union(odd)


def normalized(types: DataFrame) -> DataFrame:
    """Defaults for what a schema may leave out; applying it again changes nothing."""
    return types.withColumns({"description": F.coalesce("description", F.lit("")), "category": F.col("category"), "properties": F.coalesce("properties", F.create_map().cast("map<string,string>"))})


def goals(names: DataFrame, mapping: DataFrame, kind: str, column: str = "name") -> DataFrame:
    """names with `goal`, what the mapping (kind, old, new or null) makes of the column: null is removed, unlisted names stay."""
    side = mapping.where(F.col("kind") == kind).select(F.col("old").alias(column), "new", F.lit(True).alias("listed"))
    return names.join(side, column, "left").withColumn("goal", F.when(F.col("listed"), F.col("new")).otherwise(F.col(column))).drop("new", "listed")


def merged_types(types: DataFrame, mapping: DataFrame, scope: list[str]) -> DataFrame:
    """Node types (scope, name, pos, description, properties) under the mapping.

    Descriptions are joined with " / " in order, the target's own first. Properties are united; on a clash the target's
    own declaration wins, then that of the earlier type.
    """
    joined = goals(types, mapping, "node_type").where("goal is not null").withColumn("o", F.when(F.col("name") == F.col("goal"), 0).otherwise(1))
    parts = F.array_sort(F.collect_list(F.struct("o", "pos", F.col("description").alias("d"))))
    text = F.array_join(F.filter(F.transform(parts, lambda x: x["d"]), lambda x: F.coalesce(x != "", F.lit(False))), " / ")
    merged = joined.groupBy(*scope, F.col("goal").alias("name")).agg(F.min("pos").alias("pos"), text.alias("description"))
    if "properties" not in types.columns:
        return merged
    each = joined.select(*scope, F.col("goal").alias("name"), "o", "pos", F.explode("properties").alias("key", "value"))
    first = each.groupBy(*scope, "name", "key").agg(F.min_by("value", F.struct("o", "pos")).alias("value"))
    united = first.groupBy(*scope, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return merged.join(united, [*scope, "name"], "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def merged_edge_types(types: DataFrame, mapping: DataFrame, scope: list[str]) -> DataFrame:
    """Edge types under the mapping: merged and removed ones go, the ends of the others follow the node types."""
    stays = types.join(mapping.where("kind = 'edge_type'").select(F.col("old").alias("name")), "name", "left_anti")
    for end in ("source", "target"):
        stays = goals(stays, mapping, "node_type", end).drop(end).withColumnRenamed("goal", end)
    return stays.select(types.columns)


def mapping_problems(mapping: DataFrame, names: DataFrame) -> DataFrame:
    """kind, old, problem: unknown old or new names, a name merged into itself, chains of merges, edge types whose ends differ.

    names: kind, name and, of edge types, source and target; the ends of two merged edge types are compared after the
    node types are mapped.
    """
    own = names.select("kind", "name", *((F.col(c) if c in names.columns else F.lit(None).cast("string")).alias(c) for c in ("source", "target"))).distinct()
    for end in ("source", "target"):
        own = goals(own, mapping, "node_type", end).drop(end).withColumnRenamed("goal", end)
    ends = own.groupBy("kind", "name").agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("ends"))
    known_old = ends.select("kind", F.col("name").alias("old"), F.col("ends").alias("old_ends"), F.lit(True).alias("has_old"))
    known_new = ends.select("kind", F.col("name").alias("new"), F.col("ends").alias("new_ends"), F.lit(True).alias("has_new"))
    targets = mapping.select("kind", F.col("old").alias("new"), F.lit(True).alias("is_old")).distinct()
    m = mapping.join(known_old, ["kind", "old"], "left").join(known_new, ["kind", "new"], "left").join(targets, ["kind", "new"], "left")
    tests = {
        "unknown_old": F.col("has_old").isNull(),
        "unknown_new": F.col("new").isNotNull() & F.col("has_new").isNull(),
        "self_merge": F.coalesce(F.col("old") == F.col("new"), F.lit(False)),
        "chain": F.coalesce(F.col("is_old"), F.lit(False)) & (F.col("old") != F.col("new")),
        "ends_differ": (F.col("kind") == "edge_type") & F.coalesce(F.col("old_ends") != F.col("new_ends"), F.lit(False)),
    }
    found = F.filter(F.array(*(F.when(t, F.lit(p)) for p, t in tests.items())), lambda x: x.isNotNull())
    return m.select("kind", "old", F.explode(found).alias("problem"))


def apply_changes(types: DataFrame, changes: DataFrame, scope: list[str]) -> DataFrame:
    """Ordered type changes: DEPRECATE prefixes the description of a present type, others replace by name or append.

    types: scope, name, pos, description; changes: scope, name, seq, decision, description. Of a name's changes only
    those from the last replacement on matter: it sets the description, each later deprecation adds a prefix.
    """
    replace = F.col("decision") != "DEPRECATE"
    last = changes.groupBy(*scope, "name").agg(
        F.max(F.when(replace, F.col("seq"))).alias("at"), F.max_by("description", F.when(replace, F.col("seq"))).alias("new"), F.min(F.when(replace, F.col("seq"))).alias("first")
    )
    marks = changes.where(~replace).join(last, [*scope, "name"]).where("at is null or seq > at").groupBy(*scope, "name").agg(F.count("*").alias("marks"))
    joined = types.join(last, [*scope, "name"], "full_outer").join(marks, [*scope, "name"], "left").where("pos is not null or at is not null")
    base = F.coalesce(F.when(F.col("at").isNotNull(), F.col("new")).otherwise(F.col("description")), F.lit(""))
    prefixed = F.concat(F.repeat(F.lit("[DEPRECATED] "), F.coalesce("marks", F.lit(0)).cast("int")), base)
    place = F.struct(F.col("pos").isNull().cast("int").alias("appended"), F.coalesce("pos", "first").alias("at"))
    return joined.select(*scope, "name", place.alias("place"), prefixed.alias("description"))


def content_key(types: DataFrame, scope: list[str]) -> DataFrame:
    """scope and the digest of the schema's names, order-free."""
    return types.groupBy(*scope).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "name"))), "\n"), 256).alias("digest"))


def next_versions(versions: DataFrame) -> DataFrame:
    """Per stem the next version number and the fallback when the newest is deleted."""
    by = Window.partitionBy("stem").orderBy(F.desc("version"))
    ranked = versions.select("stem", "version").distinct().withColumn("k", F.row_number().over(by))
    return ranked.groupBy("stem").agg((F.max("version") + 1).alias("next_version"), F.max(F.when(F.col("k") == 2, F.col("version"))).alias("fallback"))


def redundant_types(types: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of types of one kind (name_a before name_b in pos) whose vectors have a cosine of at least the threshold; a zero vector is like nothing.

    types: kind, pos, name, vector. Schemas have some hundred types, so a kind is compared with itself.
    """
    v = types.where("vector is not null").withColumn("norm", norm(F.col("vector")))
    a, b = (v.select("kind", *(F.col(c).alias(f"{c}_{x}") for c in ("pos", "name", "vector", "norm"))) for x in "ab")
    scored = a.join(b, "kind").where("pos_a < pos_b").withColumn("score", F.round(cosine(F.col("vector_a"), F.col("vector_b"), F.col("norm_a"), F.col("norm_b")), 6))
    return scored.where(F.col("score") >= threshold).select("kind", "name_a", "name_b", "score")


#: Operators a property filter may use.
FILTER_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte")


def valid_analyses(analyses: DataFrame, types: DataFrame, properties: DataFrame, scope: list[str]) -> DataFrame:
    """Question analyses reduced to what the schema of their scope has.

    analyses: key, scope, node_types, edge_types (arrays), keywords (map of type to array), property_filters (map of type
    to struct of property, operator, value). types: scope, kind, name; properties: scope, type, name. Types keep their
    order and repeats; keywords stay for chosen node types only, filters for chosen types with a declared property, a
    known operator and a value.
    """
    names = lambda kind, out: types.where(F.col("kind") == kind).groupBy(*scope).agg(F.collect_set("name").alias(out))
    declared = properties.groupBy(*scope).agg(F.collect_set(F.struct("type", "name")).alias("declared"))
    a = analyses.join(names("node_type", "own_nodes"), scope, "left").join(names("edge_type", "own_edges"), scope, "left").join(declared, scope, "left")
    known = lambda own: F.coalesce(F.col(own), F.array().cast("array<string>"))
    keep = lambda c, own: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.array_contains(known(own), t)).alias(c)
    a = a.select("key", *scope, keep("node_types", "own_nodes"), keep("edge_types", "own_edges"), "keywords", "property_filters", "declared")
    chosen = lambda t: F.array_contains("node_types", t)
    passes = lambda t, f: chosen(t) & f["operator"].isin(*FILTER_OPERATORS) & f["value"].isNotNull() & F.exists(F.coalesce("declared", F.array().cast("array<struct<type:string,name:string>>")), lambda p: (p["type"] == t) & (p["name"] == f["property"]))
    return a.select(
        "key", *scope, "node_types", "edge_types",
        F.map_filter("keywords", lambda t, k: chosen(t) & k.isNotNull()).alias("keywords"), F.map_filter("property_filters", lambda t, f: F.coalesce(passes(t, f), F.lit(False))).alias("property_filters"),
    )


def unfinished_copies(types: DataFrame, active: DataFrame, graphs: DataFrame) -> DataFrame:
    """stem, version, copy_of: active versions without a graph and the newest other version of the same schema.

    types: stem, version, kind, name; active and graphs: stem, version.
    """
    key = content_key(types, ["stem", "version"])
    bare = active.join(graphs.select("stem", "version").distinct(), ["stem", "version"], "left_anti").join(key, ["stem", "version"])
    other = key.select("stem", "digest", F.col("version").alias("other"))
    return bare.join(other, ["stem", "digest"]).where("other <> version").groupBy("stem", "version").agg(F.max("other").alias("copy_of"))


def reused_schemas(types: DataFrame, active: DataFrame, pairs: DataFrame) -> DataFrame:
    """The active schema of `source` as the next version of `stem`, for every pair (stem, source); sources without one give nothing.

    types: stem, version and a schema's columns; active: stem, version.
    """
    rest = [c for c in types.columns if c not in ("stem", "version")]
    own = types.join(active.select("stem", "version"), ["stem", "version"], "left_semi").select(F.col("stem").alias("source"), *rest)
    last = types.groupBy("stem").agg(F.max("version").alias("last"))
    return pairs.join(own, "source").join(last, "stem", "left").select("stem", (F.coalesce("last", F.lit(0)) + 1).alias("version"), *rest)
