"""Property-graph reads: scopes, filters, edge matching, k-hop expansion and induced subgraphs.

Nodes are rows (stem, version, id, type, label, detail, properties, ...); edges (stem, version, source, target, type,
...). Every read is scoped by stem and version, and edges never cross scopes. Set-oriented variants take a table of
queries (query_id, stem, version, ...) and answer all of them in one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed
from .spreading import salted_join

SCOPE = ["stem", "version"]
MAX_HOPS = 5
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte")


def scoped(df: DataFrame, stem: str, version: int = 1) -> DataFrame:
    return df.where((F.col("stem") == stem) & (F.col("version") == version))


def of_types(df: DataFrame, types: list[str]) -> DataFrame:
    """Rows of the given types; an empty list gives none."""
    return df.where(F.col("type").isin(*types)) if types else df.where(F.lit(False))


def keyword_hit(label: Column, keyword: Column) -> Column:
    """The label contains the keyword or the reverse, without regard to case. Empty strings are contained in everything."""
    a, b = F.lower(label), F.lower(keyword)
    return F.contains(a, b) | F.contains(b, a)


def keyword_matches(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """query_id, id of nodes whose label matches a keyword given for their type. keywords: query_id, stem, version, type, keyword."""
    k = keywords.select("query_id", "stem", "version", "type", "keyword")
    joined = salted_join(nodes.select(*SCOPE, "type", "id", "label"), k, [*SCOPE, "type"], "id")
    return joined.where(keyword_hit(F.col("label"), F.col("keyword"))).select("query_id", "id").distinct()


def property_test(properties: Column, name: str, operator: str, value: str) -> Column:
    """eq and ne compare text, the others numbers; a missing property or a value that is no number never passes."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")
    held = F.try_element_at(properties, F.lit(name))
    if operator in ("eq", "ne"):
        test = held == F.lit(value) if operator == "eq" else held != F.lit(value)
    else:
        number, bound = held.try_cast("double"), F.lit(value).try_cast("double")
        test = {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[operator]
    return F.coalesce(test, F.lit(False))


def confidence_passes(confidence: Column, least: str | None) -> Column:
    """LOW < MEDIUM < HIGH; without a threshold and without a confidence everything passes, an unknown one ranks lowest."""
    if least is None:
        return F.lit(True)
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in RANKS.items() for x in p)), confidence), F.lit(0))
    return confidence.isNull() | (rank >= RANKS.get(least, 0))


def resolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends exist in their scope."""
    ids = nodes.select(*SCOPE, "id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), [*SCOPE, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [*SCOPE, "target"], "left_semi")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select(*SCOPE, "id").distinct()
    ends = edges.join(ids.withColumn("has_source", F.lit(True)).withColumnRenamed("id", "source"), [*SCOPE, "source"], "left")
    ends = ends.join(ids.withColumn("has_target", F.lit(True)).withColumnRenamed("id", "target"), [*SCOPE, "target"], "left")
    return ends.where("has_source is null or has_target is null").drop("has_source", "has_target")


def matching_edges(edges: DataFrame, seeds: DataFrame, types: DataFrame) -> DataFrame:
    """Edges of a query's types with either end among its seeds. seeds: query_id, stem, version, id; types: query_id, type."""
    scopes = seeds.select("query_id", *SCOPE).distinct()
    wanted = edges.join(types.join(scopes, "query_id"), [*SCOPE, "type"])
    at_source = wanted.join(seeds.withColumnRenamed("id", "source"), ["query_id", *SCOPE, "source"], "left_semi")
    at_target = wanted.join(seeds.withColumnRenamed("id", "target"), ["query_id", *SCOPE, "target"], "left_semi")
    return at_source.unionByName(at_target).distinct()


def both_ways(edges: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Each edge as two directed links, without self-loops."""
    keep = [*extra, *SCOPE]
    there = edges.select(*keep, F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(*keep, F.col("target").alias("a"), F.col("source").alias("b"))
    return there.union(back).where("a <> b").distinct()


def expand_hops(edges: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None) -> DataFrame:
    """query_id, stem, version, id, hop: nodes reached from a query's seeds in at most `hops` undirected steps.

    hops is clamped to 0..5. types None follows any edge, an empty list none. The hop is the least number of steps.
    A round shuffles only the frontier against the links; its result is checkpointed once per round.
    """
    hops = max(0, min(MAX_HOPS, hops))
    key = ["query_id", *SCOPE, "id"]
    frontier = seeds.select(key).distinct()
    reached = frontier.withColumn("hop", F.lit(0))
    if types is not None and not types:
        return reached
    links = both_ways(edges if types is None else of_types(edges, types))
    for k in range(1, hops + 1):
        step = frontier.withColumnRenamed("id", "a").join(links, [*SCOPE, "a"]).select("query_id", *SCOPE, F.col("b").alias("id")).distinct()
        frontier = checkpointed(step.join(reached.select(key), key, "left_anti"))
        reached = reached.union(frontier.withColumn("hop", F.lit(k)))
        if k < hops and frontier.isEmpty():
            break
    return reached


def induced_edges(edges: DataFrame, reached: DataFrame, types: list[str] | None = None) -> DataFrame:
    """query_id and edge columns of edges with both ends reached by the query, self-loops included."""
    own = edges if types is None else of_types(edges, types)
    ids = reached.select("query_id", *SCOPE, "id").distinct()
    first = own.join(ids.withColumnRenamed("id", "source"), [*SCOPE, "source"])
    return first.join(ids.withColumnRenamed("id", "target"), ["query_id", *SCOPE, "target"], "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """Edge ends per node; a self-loop counts twice."""
    ends = edges.select(*SCOPE, F.col("source").alias("id")).union(edges.select(*SCOPE, F.col("target").alias("id")))
    return ends.groupBy(*SCOPE, "id").agg(F.count("*").alias("degree"))


def read_nodes(nodes: DataFrame) -> DataFrame:
    """Envelope as read: empty details become absent, offsets stand only beside an evidence text."""
    has = F.col("evidence_text").isNotNull()
    return nodes.withColumns(
        {
            "detail": F.nullif(F.col("detail"), F.lit("")),
            "start_offset": F.when(has, F.col("start_offset")),
            "end_offset": F.when(has, F.col("end_offset")),
        }
    )


def visible_subgraph(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    shown = of_types(nodes, node_types)
    return shown, resolved_edges(shown, of_types(edges, edge_types))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
