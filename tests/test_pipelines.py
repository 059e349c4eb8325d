"""Whole stages with deterministic providers."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from docweave.operators import graph as G
from docweave.operators import schema as S
from docweave.plans import pipelines as P

CHUNKS = "stem string, chunk_id long, path string, text string"


def test_discovery_of_long_and_short_documents(spark, tmp_path):
    chunks = spark.createDataFrame([("long", k, None, f"{k}" * 7000) for k in range(3)] + [("short", 9, "p", "text")], CHUNKS)
    asked = tmp_path / "asked"
    asked.mkdir()

    def provider(operation, prompt):
        if operation == "consolidate_discovery":
            (asked / "consolidated").write_text(prompt)
            return json.dumps({"classes": [{"name": "All"}], "relationships": []})
        return "```json\n" + json.dumps({"domain_model": {"domain": prompt[:3]}, "classes": [{"name": f"C{prompt[0]}", "definition": "d", "more": 1}], "relationships": [], "warnings": ["w"]}) + "\n```"

    got = {(r.stem, r.field, r.position): r.item for r in P.discover_documents(chunks, provider, str(tmp_path / "cache")).collect()}
    assert got[("long", "domain", 1)] == "000" and got[("short", "domain", 1)] == "[p]" and got[("long", "warnings", 1)] == "w"
    assert json.loads(got[("long", "classes", 1)]) == {"name": "All"} and json.loads(got[("short", "classes", 1)])["name"] == "C["
    sent = json.loads((asked / "consolidated").read_text())
    assert [g["classes"] for g in sent] == [[{"name": f"C{k}", "definition": "d"}] for k in range(3)]


def test_schemas_and_document_types(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 1, None, "x" * 9000), ("d", 2, None, "y" * 9000), ("e", 3, None, "z")], CHUNKS)

    def provider(operation, prompt):
        if operation == "generate_schema":
            return json.dumps({"node_types": [{"name": prompt[0].upper(), "description": "one"}], "edge_types": [{"name": "R", "source": "X", "target": "Y"}]})
        schemas = [json.loads(x) for x in json.loads(prompt)]
        return json.dumps({"node_types": [t for s in schemas for t in s["node_types"]], "edge_types": schemas[0]["edge_types"]})

    got = {(r.stem, r.kind, r.pos): (r.name, r.source) for r in P.schema_for_documents(chunks, provider, str(tmp_path / "cache"), "legal").collect()}
    assert got == {("d", "node_type", 0): ("X", None), ("d", "node_type", 1): ("Y", None), ("d", "edge_type", 0): ("R", "X"), ("e", "node_type", 0): ("Z", None), ("e", "edge_type", 0): ("R", "X")}
    with pytest.raises(ValueError):
        P.schema_for_documents(chunks, provider, str(tmp_path / "cache"), "poem")


def test_proposals_need_their_fields(spark):
    good = {"changes": [{"decision": "ADD", "element_type": "node", "element": {"id": "n"}}]}
    rows = P.proposed_changes(spark.createDataFrame([("a", json.dumps(good))], "key string, reply string")).collect()
    assert [(r.decision, r.element_type, json.loads(r.element)) for r in rows] == [("ADD", "node", {"id": "n"})]
    with pytest.raises(ValueError):
        P.proposed_changes(spark.createDataFrame([("a", json.dumps({"changes": [{"decision": "ADD", "element": {}}]}))], "key string, reply string"))


def test_golden_sets(spark):
    q = lambda *x: spark.createDataFrame(x, "stem string, position long, id string, question string, question_type string")
    a = lambda *x: spark.createDataFrame(x, "stem string, id string, seq int, answer string, answerable boolean, quote string")
    docs, two = spark.createDataFrame([("d", "the text")], "stem string, text string"), spark.createDataFrame([("d", 2)], "stem string, n int")
    asked = q(("d", 1, "q1", "What?", "list"), ("d", 2, "q2", "what? ", "entity"))
    told = a(("d", "q1", 1, "old", True, "nope"), ("d", "q1", 2, "new", True, "text"), ("d", "q2", 1, "x", True, "nowhere"))
    assert [tuple(r) for r in P.golden_sets(asked, told, docs, two).collect()] == [("d", "q001", "What?", "list", "new", True, "text")]
    with pytest.raises(ValueError, match="count"):
        P.golden_sets(asked, told, docs, two.withColumn("n", F.lit(3)))
    with pytest.raises(ValueError, match="type"):
        P.golden_sets(q(("d", 1, "q1", "What?", "odd"), ("d", 2, "q2", "b", "list")), told, docs, two)
    with pytest.raises(ValueError, match="differ"):
        P.golden_sets(asked, a(("d", "q1", 1, "x", True, "text"), ("d", "q3", 1, "x", True, "text")), docs, two)


def test_analyses_keep_what_the_schema_has(spark):
    asked = spark.createDataFrame(
        [("k", "d", ["A", "No", "A"], ["R", "No"], {"A": ["x"], "B": ["y"]}, {"A": ("p", "gte", "5"), "B": ("p", "eq", "1"), "No": ("p", "eq", "1")}), ("l", "d", ["B"], None, None, {"B": ("p", "like", "1")}), ("m", "d", ["B"], [], {}, {"B": ("p", "eq", None)})],
        "key string, stem string, node_types array<string>, edge_types array<string>, keywords map<string,array<string>>, property_filters map<string,struct<property:string,operator:string,value:string>>",
    )
    types = spark.createDataFrame([("d", "node_type", "A"), ("d", "node_type", "B"), ("d", "edge_type", "R")], "stem string, kind string, name string")
    props = spark.createDataFrame([("d", "A", "p"), ("d", "B", "p")], "stem string, type string, name string")
    got = {r.key: r for r in S.valid_analyses(asked, types, props, ["stem"]).collect()}
    assert got["k"].node_types == ["A", "A"] and got["k"].edge_types == ["R"] and got["k"].keywords == {"A": ["x"]} and set(got["k"].property_filters) == {"A"}
    assert got["l"].edge_types == [] and not got["l"].property_filters and not got["m"].property_filters


def test_unfinished_copies_and_matching_edges(spark):
    t = spark.createDataFrame([("d", v, "node_type", n) for v, n in ((1, "A"), (2, "B"), (3, "A"), (4, "A"))], "stem string, version long, kind string, name string")
    scopes = lambda *x: spark.createDataFrame(x, "stem string, version long")
    assert [tuple(r) for r in S.unfinished_copies(t, scopes(("d", 4)), scopes(("d", 1), ("d", 3))).collect()] == [("d", 4, 3)]
    assert S.unfinished_copies(t, scopes(("d", 3)), scopes(("d", 3))).isEmpty()
    e = spark.createDataFrame([("d", 1, "a", "b", "R"), ("d", 1, "b", "c", "R"), ("d", 2, "a", "b", "R"), ("d", 1, "a", "b", "S")], "stem string, version long, source string, target string, type string")
    seeds, types = spark.createDataFrame([("q", "d", 1, "b")], "query_id string, stem string, version long, id string"), spark.createDataFrame([("q", "R")], "query_id string, type string")
    assert {(r.version, r.source, r.target, r.type) for r in G.matching_edges(e, seeds, types).collect()} == {(1, "a", "b", "R"), (1, "b", "c", "R")}


def test_golden_sets_of_documents_in_parts(spark):
    asked = spark.createDataFrame([("d", k, f"q{k}", f"What {k}?", "list") for k in range(5)], "stem string, position long, id string, question string, question_type string")
    told = spark.createDataFrame([("d", f"q{k}", 1, "x", True, q) for k, q in enumerate(("one", "e\n\ntwo", "o\n\n\n\nfour", "one\n\nfour", None))], "stem string, id string, seq int, answer string, answerable boolean, quote string")
    parts = spark.createDataFrame([("d", 4, "four"), ("d", 3, None), ("d", 2, "two"), ("d", 1, "one")], "stem string, part long, text string")
    rows = P.golden_sets(asked, told, parts, spark.createDataFrame([("d", 5)], "stem string, n int")).collect()
    assert sorted((r.new_id, r.answerable, r.evidence) for r in rows) == [("q001", True, "one"), ("q002", True, "e\n\ntwo"), ("q003", True, "o\n\n\n\nfour"), ("q004", False, None), ("q005", False, None)]


def test_golden_sets_read_a_long_document_once(spark):
    """8,000 quotes in one text of 1.5 million characters: 12 billion characters where the text is read once a quote."""
    rng, n = random.Random(1), 8000
    text = "".join(rng.choices("가나다라마바사아자차카타파하", k=1_500_000))
    quotes = [text[at : at + 40] if k % 2 else text[at : at + 40] + "x" for k, at in enumerate(rng.sample(range(1_499_000), n))]
    asked = spark.createDataFrame([("d", k, str(k), f"What {k}?", "list") for k in range(n)], "stem string, position long, id string, question string, question_type string")
    told = spark.createDataFrame([("d", str(k), 1, "x", True, q) for k, q in enumerate(quotes)], "stem string, id string, seq int, answer string, answerable boolean, quote string")
    docs = spark.createDataFrame([("d", text)], "stem string, text string")
    began = time.monotonic()
    rows = P.golden_sets(asked, told, docs, spark.createDataFrame([("d", n)], "stem string, n int")).collect()
    assert {r.question: r.evidence for r in rows} == {f"What {k}?": q if k % 2 else None for k, q in enumerate(quotes)}
    assert time.monotonic() - began < 90
