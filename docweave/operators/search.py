"""Graph search for many questions at once: tiered matching, edge matching, expansion, ranking and context.

analysis (one row a question and wanted node type): query_id, stem, version, pos, type, keywords ARRAY<STRING>,
property, operator, value. edge_types: query_id, type. A type is answered by the first tier that finds anything:
keywords, then its property filter, then vectors, then all its nodes; different types may be answered by different
tiers. Questions without types give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from . import graph as G

KEYWORD, PROPERTY, VECTOR, EVERY = 1, 2, 3, 4


def _property_hits() -> Column:
    held = F.try_element_at("properties", F.col("property"))
    number, bound = held.try_cast("double"), F.col("value").try_cast("double")
    op = F.col("operator")
    test = (
        F.when(op == "eq", held == F.col("value")).when(op == "ne", held != F.col("value")).when(op == "gt", number > bound).when(op == "gte", number >= bound).when(op == "lt", number < bound).when(op == "lte", number <= bound)
    )
    return F.coalesce(test, F.lit(False))


def tiered_matches(nodes: DataFrame, analysis: DataFrame, vectors: DataFrame | None = None, questions: DataFrame | None = None, top_k: int = 5, min_score: float = 0.3) -> DataFrame:
    """query_id, stem, version, id, pos, tier of the matches of each question's types.

    vectors: id, vector; questions: query_id, vector. Both are needed for the vector tier.
    """
    scope = ["stem", "version", "type"]
    joined = nodes.select(*scope, "id", "label", "properties").join(analysis, scope)
    by_keyword = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: G.keyword_hit(F.col("label"), k))
    tier = F.when(by_keyword, KEYWORD).when(_property_hits(), PROPERTY).otherwise(EVERY)
    hits = joined.select("query_id", "stem", "version", "type", "id", "pos", tier.alias("tier"))
    if vectors is not None and questions is not None:
        # Only types that neither keywords nor a property answer are compared by vector.
        open_types = hits.groupBy("query_id", *scope).agg(F.min("tier").alias("least")).where(F.col("least") == EVERY).drop("least")
        scored = hits.join(open_types, ["query_id", *scope], "left_semi").join(vectors.withColumnRenamed("vector", "v"), "id").join(questions.withColumnRenamed("vector", "q"), "query_id").withColumn("score", F.round(cosine(F.col("q"), F.col("v")), 6))
        place = F.row_number().over(Window.partitionBy("query_id", "stem", "version", "type").orderBy(F.desc("score"), "id"))
        near = scored.withColumn("k", place).where((F.col("k") <= top_k) & (F.col("score") >= min_score))
        hits = hits.union(near.select("query_id", "stem", "version", "type", "id", "pos", F.lit(VECTOR).alias("tier")))
    # A node of the last tier also stands for "all nodes of the type"; the least tier present decides for the type.
    best = hits.groupBy("query_id", *scope).agg(F.min("tier").alias("best"))
    kept = hits.join(best, ["query_id", *scope]).where(F.col("tier") == F.col("best"))
    return kept.select("query_id", "stem", "version", "id", "pos", "tier").distinct()


class Search:
    """The parts of a search result for every question; each is a DataFrame keyed by query_id."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, analysis: DataFrame, edge_types: DataFrame, hops: int = 1, least_confidence: str | None = None, **tiers):
        scope = ["query_id", "stem", "version"]
        nodes = G.checkpointed(nodes.select("stem", "version", "id", "type", "label", "detail", "properties", "confidence", "evidence_text", "source_section"))
        self.nodes = nodes.select("stem", "version", "id", "label")
        matches = G.checkpointed(tiered_matches(nodes, analysis, **tiers))
        self.matches = matches
        scopes = analysis.select(*scope).distinct()
        wanted = G.checkpointed(edges.join(edge_types.join(scopes, "query_id"), ["stem", "version", "type"]))
        seeds = matches.select(*scope, "id").distinct()
        touched = [wanted.join(seeds.withColumnRenamed("id", s), [*scope, s], "left_semi") for s in ("source", "target")]
        columns = [*scope, "source", "target", "type"]
        hit = touched[0].select(columns).union(touched[1].select(columns))
        # Questions none of whose types matched fall back to all edges of their edge types.
        bare = wanted.join(matches.select("query_id").distinct(), "query_id", "left_anti").select(columns)
        ends = hit.union(bare).select(*scope, F.explode(F.array("source", "target")).alias("id")).distinct()
        start = G.checkpointed(seeds.union(ends).distinct())
        self.reached = self._expand(wanted.select(columns).distinct(), start, hops)
        both = wanted.join(self.reached.withColumnRenamed("id", "source"), [*scope, "source"], "left_semi").join(self.reached.withColumnRenamed("id", "target"), [*scope, "target"], "left_semi")
        passes = G.confidence_passes(F.col("confidence"), least_confidence)
        self.edges = both.where(passes)
        ranked = matches.groupBy(*scope, "id").agg(F.min("pos").alias("rank"))
        found = self.reached.join(ranked, [*scope, "id"], "left").join(nodes.select("stem", "version", "id", "label", "type", "detail", "confidence", "evidence_text", "source_section"), ["stem", "version", "id"])
        self.related_nodes = found.where(passes)

    @staticmethod
    def _expand(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
        """Only the question's own edge types are followed; without any the start is all there is."""
        scope = ["query_id", "stem", "version"]
        both = links.select(*scope, F.col("source").alias("a"), F.col("target").alias("b")).union(links.select(*scope, F.col("target"), F.col("source"))).where("a <> b").distinct()
        reached = frontier = start
        for _ in range(max(0, min(G.MAX_HOPS, hops))):
            step = frontier.withColumnRenamed("id", "a").join(both, [*scope, "a"]).select(*scope, F.col("b").alias("id")).distinct()
            frontier = G.checkpointed(step.join(reached, [*scope, "id"], "left_anti"))
            reached = reached.union(frontier)
        return reached

    def context(self) -> DataFrame:
        """query_id, context: entity lines in rank order, unranked ones last, then relation lines; null where no line is left."""
        evidence, section = F.col("evidence_text"), F.col("source_section")
        notes = F.array_join(F.filter(F.array(F.concat(F.lit("근거: "), evidence), F.concat(F.lit("출처: "), section)), lambda x: x.isNotNull()), "; ")
        noted = F.when(notes != "", F.concat(F.lit(" ["), notes, F.lit("]"))).otherwise("")
        detail = F.when(F.length("detail") > 0, F.concat(F.lit(": "), "detail")).otherwise("")
        line = F.concat(F.lit("- "), "label", F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")"), detail, noted)
        n = self.related_nodes.select("query_id", F.struct(F.lit(0).alias("part"), F.coalesce("rank", F.lit(1 << 30)).alias("rank"), F.col("id").alias("key"), line.alias("line")).alias("x"))
        labels = self.nodes
        e = self.edges.join(labels.withColumnsRenamed({"id": "source", "label": "a"}), ["stem", "version", "source"]).join(labels.withColumnsRenamed({"id": "target", "label": "b"}), ["stem", "version", "target"])
        relation = F.concat(F.lit("- "), "a", F.lit(" --"), "type", F.lit("--> "), "b", detail)
        r = e.select("query_id", F.struct(F.lit(1).alias("part"), F.lit(0).alias("rank"), F.concat_ws("|", "type", "source", "target").alias("key"), relation.alias("line")).alias("x"))
        listed = n.union(r).groupBy("query_id").agg(F.array_sort(F.collect_set("x")).alias("xs"))

        def part(k: int, title: str) -> Column:
            own = F.filter("xs", lambda x: x["part"] == k)
            return F.when(F.size(own) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(own, lambda x: x["line"]), "\n")))

        return listed.select("query_id", F.concat_ws("\n\n", part(0, "Entities:"), part(1, "Relations:")).alias("context"))
