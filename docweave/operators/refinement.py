"""New versions of schema and graph together: refinement by a merge mapping, evolution by reviewed changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed
from . import rewriting as W
from . import schema as S


@dataclass
class Version:
    """What a step makes of each stem's version: its types and graph under the next version number."""

    node_types: DataFrame
    edge_types: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _under(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows of the versions in numbers (stem, version, next) under the next number."""
    return rows.join(numbers, ["stem", "version"]).drop("version").withColumnRenamed("next", "version")


def refined(old: Version, numbers: DataFrame, mapping: DataFrame, seq: str, fill: list[str]) -> Version:
    """The versions of numbers (stem, version, next) with a mapping (kind, old, new) applied to schema and graph.

    A mapping that any of the schemas rules out raises ValueError before anything is made.
    """
    own = old.node_types.select(F.lit("node_type").alias("kind"), "name", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"))
    names = own.union(old.edge_types.select(F.lit("edge_type"), "name", "source", "target")).distinct()
    wrong = S.mapping_problems(mapping, names).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].kind} {wrong[0].old}: {wrong[0].problem}")
    scope = ["stem", "version"]
    take = lambda rows: rows.join(numbers.select(*scope), scope, "left_semi")
    nodes, edges = W.apply_mapping(take(old.nodes), take(old.edges), mapping, scope, seq, fill)
    made = S.merged_types(take(old.node_types), mapping, scope), S.merged_edge_types(take(old.edge_types), mapping, scope), nodes, edges
    return Version(*(_under(x, numbers) for x in made))


def size_changes(old: Version, new: Version, numbers: DataFrame) -> DataFrame:
    """stem, version (the new one), part, before, after: how many types, nodes and edges there were and are."""
    out = None
    for part in ("node_types", "edge_types", "nodes", "edges"):
        before = getattr(old, part).join(numbers, ["stem", "version"]).groupBy("stem", F.col("next").alias("version")).agg(F.count("*").alias("before"))
        after = getattr(new, part).groupBy("stem", "version").agg(F.count("*").alias("after"))
        both = before.join(after, ["stem", "version"], "full_outer").fillna(0, ["before", "after"]).select("stem", "version", F.lit(part).alias("part"), "before", "after")
        out = both if out is None else out.union(both)
    return out


def evolved(old: Version, numbers: DataFrame, type_changes: DataFrame, node_changes: DataFrame, edge_changes: DataFrame) -> Version:
    """The versions of numbers with reviewed changes, in their order (seq), applied to types and graph.

    Changes carry stem, version and decision; type changes also kind, name and description.
    """
    scope = ["stem", "version"]
    take = lambda rows: rows.join(numbers.select(*scope), scope, "left_semi")
    types = []
    for kind, own in (("node_type", old.node_types), ("edge_type", old.edge_types)):
        own = checkpointed(take(own))
        told = S.apply_changes(own, take(type_changes.where(F.col("kind") == kind)), scope)
        more = [c for c in own.columns if c not in (*scope, "name", "pos", "description")]
        types.append(told.join(own.select(*scope, "name", *more), [*scope, "name"], "left"))
    nodes = W.evolved_nodes(take(old.nodes), take(node_changes), scope)
    edges = W.evolved_edges(take(old.edges), take(edge_changes), scope)
    return Version(*(_under(x, numbers) for x in (*types, nodes, edges)))
