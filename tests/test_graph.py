from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.operators import graph as G
from docweave.operators.search import Search, tiered_matches
from docweave.plans.q_graph import keyword_matches_all_versions
from docweave.plans.q_pipelines import extracted_versions

from .conftest import SMALL

NODE = "stem string, version long, id string, type string, label string, detail string, properties map<string,string>, confidence string, evidence_text string, start_offset long, end_offset long, source_section string"
EDGE = "stem string, version long, source string, target string, type string, detail string, confidence string"


@pytest.fixture(scope="module")
def people(spark):
    n = [
        ("d", 1, "a", "Person", "Ada", "", {"age": "50"}, "HIGH", "Ada is", 0, 6, None),
        ("d", 1, "b", "Person", "Bob", "a man", {"age": "50%"}, None, None, 3, 5, None),
        ("d", 1, "c", "Concept", "Adage", None, None, "LOW", None, None, None, "S1"),
        ("d", 1, "o", "Org", "Org", None, {"age": "7"}, "odd", None, None, None, None),
        ("d", 2, "a", "Person", "Ada", None, None, None, None, None, None, None),
    ]
    e = [("d", 1, "a", "b", "KNOWS", None, None), ("d", 1, "b", "o", "IN", "since", "LOW"), ("d", 1, "o", "o", "IN", None, None), ("d", 1, "a", "x", "KNOWS", None, None)]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_keywords_match_both_ways_and_empty_ones_everything(spark, people):
    k = spark.createDataFrame([("q", "d", 1, "Person", "ADA LOVELACE"), ("r", "d", 1, "Person", "")], "query_id string, stem string, version long, type string, keyword string")
    got = {(r.query_id, r.id) for r in G.keyword_matches(people[0], k).collect()}
    assert got == {("q", "a"), ("r", "a"), ("r", "b")}


def test_keyword_searches_reach_every_version(spark, tmp_path):
    rows = [(20, "n20", "d", 1, "Coverage", "암보장"), (21, "n21", "d", 2, "Coverage", "암보장"), (22, "n22", "d", 3, "Coverage", "암보장"), (23, "n23", "d", 7, "Coverage", "암보장")]
    spark.createDataFrame(rows, "node_no long, id string, stem string, version long, type string, label string").write.parquet(f"{tmp_path}/nodes.parquet")
    got = ids(keyword_matches_all_versions(spark, str(tmp_path)))
    assert got == ["n20", "n21", "n22", "n23"]


def test_property_operators(people):
    held = lambda op, v: ids(people[0].where(G.property_test(F.col("properties"), "age", op, v)))
    assert held("gte", "30") == ["a"]
    assert held("lt", "30") == ["o"]
    assert held("eq", "50%") == ["b"]
    assert held("ne", "50") == ["b", "o"]
    with pytest.raises(ValueError):
        G.property_test(F.col("properties"), "age", "like", "5")


def test_confidence_threshold(people):
    n = people[0].where("version = 1")
    assert ids(n.where(G.confidence_passes(F.col("confidence"), "MEDIUM"))) == ["a", "b"]
    assert ids(n.where(G.confidence_passes(F.col("confidence"), None))) == ["a", "b", "c", "o"]


def test_dangling_and_resolved_edges(people):
    assert [r.target for r in G.dangling_edges(*people).collect()] == ["x"]
    assert G.resolved_edges(*people).count() == 3


def test_expansion_and_induced_subgraph(spark, people):
    seeds = spark.createDataFrame([("q", "d", 1, "a")], "query_id string, stem string, version long, id string")
    edges = G.resolved_edges(*people)
    hops = lambda k, t=None: {r.id: r.hop for r in G.expand_hops(edges, seeds, k, t).collect()}
    assert hops(0) == {"a": 0}
    assert hops(1) == {"a": 0, "b": 1}
    assert hops(99) == {"a": 0, "b": 1, "o": 2}
    assert hops(2, []) == {"a": 0}
    assert hops(2, ["IN"]) == {"a": 0}
    found = G.induced_edges(edges, G.expand_hops(edges, seeds, 2))
    assert sorted((r.source, r.target) for r in found.collect()) == [("a", "b"), ("b", "o"), ("o", "o")]


def test_degree_counts_loops_twice(people):
    assert {r.id: r.degree for r in G.degree(people[1]).collect()} == {"a": 2, "b": 2, "o": 3, "x": 1}


def test_reading_drops_empty_details_and_offsets_without_evidence(people):
    got = {r.id: (r.detail, r.start_offset) for r in G.read_nodes(people[0].where("version = 1")).collect()}
    assert got["a"] == (None, 0) and got["b"] == ("a man", None)


def test_search_tiers_and_context(spark, people):
    schema = "query_id string, stem string, version long, pos int, type string, keywords array<string>, property string, operator string, value string"
    rows = [("q", "d", 1, 0, "Person", ["ada"], None, None, None), ("q", "d", 1, 1, "Org", [], "age", "gt", "9"), ("q", "d", 1, 2, "Nothing", [], None, None, None)]
    analysis = spark.createDataFrame(rows, schema)
    got = {(r.id, r.tier) for r in tiered_matches(people[0], analysis).collect()}
    assert got == {("a", 1), ("o", 4)}
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("o", [0.0, 1.0])], "id string, vector array<float>")
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vector array<float>")
    assert {(r.id, r.tier) for r in tiered_matches(people[0], analysis, vectors, asked).collect()} == {("a", 1), ("o", 3)}
    types = spark.createDataFrame([("q", "KNOWS")], "query_id string, type string")
    s = Search(people[0], G.resolved_edges(*people), analysis, types)
    text = s.context().first().context
    assert text.startswith("Entities:\n- Ada (Person) [근거: Ada is]") and "- Ada --KNOWS--> Bob" in text and "Bob (Person): a man" in text


def test_search_falls_back_to_all_edges_of_the_types(spark, people):
    schema = "query_id string, stem string, version long, pos int, type string, keywords array<string>, property string, operator string, value string"
    analysis = spark.createDataFrame([("q", "d", 1, 0, "Nothing", [], None, None, None)], schema)
    s = Search(people[0], G.resolved_edges(*people), analysis, spark.createDataFrame([("q", "KNOWS")], "query_id string, type string"))
    assert ids(s.related_nodes) == ["a", "b"]


def test_extraction_covers_every_version(spark):
    nodes = spark.read.parquet(f"{SMALL}/nodes.parquet")
    got = extracted_versions(spark, SMALL)
    assert {r.version for r in got.select("version").distinct().collect()} == {r.version for r in nodes.select("version").distinct().collect()} >= {1, 2, 3}
    assert {"source_section", "amount", "start", "end"} <= set(got.columns)
    assert not got.where("amount is not null").isEmpty() and not got.where("source_section is not null").isEmpty()
