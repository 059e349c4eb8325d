"""Graph rewriting: verification of extracted items, coreference merge, mapping-driven refinement, supplements.

Order is carried by a sequence column, and "first" always means least in it, so no result hangs on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def filled(*names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.coalesce(F.col(n) != "", F.lit(False))
    return test


def declared_properties(properties: Column, declared: dict[str, str]) -> Column:
    """Properties whose name is declared, compared without case, under the declared spelling; null values become empty."""
    names = F.create_map(*(F.lit(x) for k, v in declared.items() for x in (k.lower(), v)))
    known = F.map_filter(properties, lambda k, v: F.array_contains(F.map_keys(names), F.lower(k)))
    # Two spellings of one name: the first in the order of the map stays.
    entries = F.transform(F.map_entries(known), lambda e: F.struct(F.element_at(names, F.lower(e["key"])).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value")))
    once = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,string>"))


def known_confidence(confidence: Column) -> Column:
    return F.when(confidence.isin(*CONFIDENCES), confidence)


def evidence_span(evidence: Column, text: Column) -> Column:
    """struct(start, end) of the first verbatim occurrence, null when there is none."""
    at = T.find(text, evidence)
    return F.when(at.isNotNull(), F.struct(at.cast("long").alias("start"), (at + F.length(evidence)).cast("long").alias("end")))


def section_labels(text: Column) -> Column:
    """Labels of lines that consist of a label in square brackets."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\[(.+)\]$"), F.lit(1))


def merge_groups(nodes: DataFrame, edges: DataFrame, scope: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Coreference merge over the groups of a scope.

    nodes: scope, id, type, label, seq, more. Of nodes with equal type and label the first stays, without filling its
    gaps; edges (scope, source, target, type, seq) are pointed to the one that stayed, unknown ends drop them, and of
    equal ones the first stays. Self-loops stay.
    """
    rest = [c for c in nodes.columns if c not in (*scope, "type", "label")]
    kept = nodes.groupBy(*scope, "type", "label").agg(F.min_by(F.struct(*rest), seq).alias("n"))
    merged = kept.select(*scope, "type", "label", "n.*")
    target = kept.select(*scope, "type", "label", F.col("n.id").alias("kept_id"))
    same = _null_safe("n", "t", [*scope, "type", "label"])
    # An id repeated in a scope points to where its last row went.
    id_map = nodes.alias("n").join(target.alias("t"), same).groupBy(*(F.col(f"n.{c}").alias(c) for c in scope), "n.id").agg(F.max_by("t.kept_id", F.col(f"n.{seq}")).alias("kept_id"))
    return merged, repoint(edges, id_map, scope, seq)


def repoint(edges: DataFrame, id_map: DataFrame, scope: list[str], seq: str, keep_made_loops: bool = True) -> DataFrame:
    """Edges with both ends replaced by id_map (scope, id, kept_id); the first of equal (source, target, type) stays."""
    m = {s: id_map.select(*scope, F.col("id").alias(s), F.col("kept_id").alias(f"new_{s}")) for s in ("source", "target")}
    moved = edges.join(m["source"], [*scope, "source"]).join(m["target"], [*scope, "target"])
    if not keep_made_loops:
        moved = moved.where((F.col("source") == F.col("target")) | (F.col("new_source") != F.col("new_target")))
    rest = [c for c in edges.columns if c not in (*scope, "source", "target", "type")]
    first = moved.groupBy(*scope, F.col("new_source").alias("source"), F.col("new_target").alias("target"), "type").agg(F.min_by(F.struct(*rest), seq).alias("e"))
    return first.select(*scope, "source", "target", "type", "e.*")


def mapped(value: str, kind: str, mapping: DataFrame) -> tuple[DataFrame, Column]:
    """The side to join and the mapped value; a null target means removal, no row means unchanged."""
    side = mapping.where(F.col("kind") == kind).select(F.col("old").alias(value), F.col("new"), F.lit(True).alias("listed"))
    return side, F.when(F.col("listed"), F.col("new")).otherwise(F.col(value))


def apply_mapping(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, scope: list[str], seq: str, fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """Retype by mapping (kind, old, new or null), merge nodes of equal type and label, let edges follow.

    Of merged nodes the first stays, its empty `fill` columns taken from the next that has them. Types mapped to null
    are removed. Self-loops that the merge makes are removed, those that were there stay.
    """
    side, new_type = mapped("type", "node_type", mapping)
    retyped = nodes.join(side, "type", "left").withColumn("new_type", new_type).where("new_type is not null")
    order = F.col(seq)
    truthy = {c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & ~F.col(c).cast("string").isin("0", "false"), F.col(c)) for c in fill}
    merged = retyped.groupBy(*scope, F.col("new_type").alias("type"), "label").agg(
        F.min_by("id", order).alias("id"), F.min(order).alias(seq), *(F.min_by(truthy[c], F.when(truthy[c].isNotNull(), order)).alias(c) for c in fill)
    )
    same = _null_safe("n", "t", [*scope, "label"])
    id_map = retyped.alias("n").join(merged.alias("t"), same & (F.col("n.new_type") == F.col("t.type"))).groupBy(*(F.col(f"n.{c}").alias(c) for c in scope), "n.id").agg(
        F.max_by("t.id", F.col(f"n.{seq}")).alias("kept_id")
    )
    side, new_type = mapped("type", "edge_type", mapping)
    rest = [c for c in edges.columns if c != "type"]
    moved = edges.join(side, "type", "left").withColumn("new_type", new_type).where("new_type is not null").select(*rest, F.col("new_type").alias("type"))
    return merged, repoint(moved, id_map, scope, seq, keep_made_loops=False)


def supplement(base: DataFrame, extra: DataFrame, scope: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Rows of extra whose type and label the base lacks, the first of each, and where every id of extra went (scope, id, kept_id).

    A new row keeps its id in `new_id` if the base has no such id, else it becomes s<n>_<id> with the least n that is
    free; of several new rows of one id each takes the next free one.
    """
    key = [*scope, "type", "label"]
    known = base.groupBy(*key).agg(F.max_by("id", seq).alias("known_id"))
    rest = [c for c in extra.columns if c not in key]
    fresh = extra.join(known, key, "left_anti").groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("n")).select(*key, "n.*")
    # Names taken by the base: 0 is the id itself, n is s<n>_<id>.
    prefixed = base.where(F.col("id").rlike(r"^s\d+_")).select(*scope, F.regexp_extract("id", r"^s\d+_(.*)$", 1).alias("id"), F.regexp_extract("id", r"^s(\d+)_", 1).cast("int").alias("k"))
    taken = base.select(*scope, "id", F.lit(0).alias("k")).union(prefixed).groupBy(*scope, "id").agg(F.collect_set("k").alias("taken"))
    turn = F.row_number().over(Window.partitionBy(*scope, "id").orderBy(seq))
    named = fresh.withColumn("turn", turn).join(taken, [*scope, "id"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(0), F.size("taken") + F.col("turn")), lambda k: ~F.array_contains("taken", k))
    n = F.element_at(free, F.col("turn").cast("int"))
    added = named.withColumn("new_id", F.when(n == 0, F.col("id")).otherwise(F.concat(F.lit("s"), n.cast("string"), F.lit("_"), "id"))).select(*fresh.columns, "new_id")
    went = extra.join(known.select(*key, F.col("known_id").alias("kept_id")).union(added.select(*key, "new_id")), key)
    return added, went.groupBy(*scope, "id").agg(F.max_by("kept_id", seq).alias("kept_id"))


def supplemented_edges(base: DataFrame, extra: DataFrame, id_map: DataFrame, scope: list[str], seq: str) -> DataFrame:
    """Edges of extra with their ends where their nodes went, ends it did not declare as they are; the first of each that the base lacks."""
    for end in ("source", "target"):
        side = id_map.select(*scope, F.col("id").alias(end), "kept_id")
        extra = extra.join(side, [*scope, end], "left").withColumn(end, F.coalesce("kept_id", end)).drop("kept_id")
    key = [*scope, "source", "target", "type"]
    rest = [c for c in extra.columns if c not in key]
    new = extra.join(base.select(*key), key, "left_anti")
    return new.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("e")).select(*key, "e.*")


def evolved_nodes(nodes: DataFrame, changes: DataFrame, scope: list[str]) -> DataFrame:
    """Nodes after ordered changes (scope, seq, decision and the node's columns): the last change of an id replaces, adds or, deprecating, removes it."""
    rest = [c for c in nodes.columns if c not in (*scope, "id")]
    last = changes.groupBy(*scope, "id").agg(F.max_by(F.struct("decision", *rest), "seq").alias("c"))
    stays = nodes.join(last.select(*scope, "id"), [*scope, "id"], "left_anti")
    return stays.unionByName(last.where("c.decision <> 'DEPRECATE'").select(*scope, "id", *(F.col(f"c.{c}").alias(c) for c in rest)))


def evolved_edges(edges: DataFrame, changes: DataFrame, scope: list[str]) -> DataFrame:
    """Edges after ordered changes: deprecating removes all edges of that source, target and type so far, any other decision appends one."""
    key = [*scope, "source", "target", "type"]
    gone = changes.where("decision = 'DEPRECATE'").groupBy(*key).agg(F.max("seq").alias("gone"))
    stays = edges.join(gone, key, "left_anti")
    added = changes.where("decision <> 'DEPRECATE'").join(gone, key, "left").where("gone is null or seq > gone")
    return stays.unionByName(added.select(edges.columns))


def verified(nodes: DataFrame, texts: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Extracted nodes with what their text bears out: complete ones, with declared properties, known confidence, verbatim evidence and known section.

    nodes: text_id and the node's columns; texts: text_id, text, headed (the text under its section label), base (its
    place in the document). start and end are places in the document.
    """
    seen = nodes.where(filled("id", "label", "type")).join(texts, "text_id", "left").withColumn("span_", evidence_span(F.col("evidence_text"), F.col("text")))
    return seen.withColumns({
        "confidence": known_confidence(F.col("confidence")), "evidence_text": F.when(F.col("span_").isNotNull(), F.col("evidence_text")),
        "start": F.col("base") + F.col("span_.start"), "end": F.col("base") + F.col("span_.end"), "properties": declared_properties(F.col("properties"), declared),
        "source_section": F.when(F.array_contains(section_labels(F.col("headed")), F.col("source_section")), F.col("source_section")),
    }).drop("text", "headed", "base", "span_")


def extracted(nodes: DataFrame, edges: DataFrame, texts: DataFrame, declared: dict[str, str], scope: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """Replies of all groups as one graph a scope: verified nodes, complete edges with known ends, merged over the groups."""
    return merge_groups(verified(nodes, texts, declared), edges.where(filled("source", "target", "type")), scope, seq)


def _null_safe(a: str, b: str, names: list[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return test
