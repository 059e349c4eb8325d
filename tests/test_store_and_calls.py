from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docweave.operators import discovery as D
from docweave.operators import refinement as R
from docweave.operators import rewriting as W
from docweave.operators import schema as S
from docweave.plans import providers as M
from docweave.sources import files as X
from docweave.sources.catalog_source import register, store_download, with_retries
from docweave.sources.store import GraphStore, NotFound, with_envelope

NODE = "stem string, version long, id string, original_id string, label string, type string"
EDGE = "stem string, version long, source string, target string, type string"


def graph(spark, rows, edges=()):
    return spark.createDataFrame(rows, NODE), spark.createDataFrame(list(edges), EDGE)


def test_store_replaces_deletes_and_marks(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    assert store.load_graph("d") is None and not store.has_graph("d")
    n, e = graph(spark, [("d", 1, "a", "a", "A", "T"), ("d", 1, "b", "b", "B", "T"), ("x", 1, "z", "z", "Z", "T")], [("d", 1, "a", "b", "R")])
    store.write_graphs(n, e)
    store.write_graphs(*graph(spark, [("d", 1, "c", "c", "C", "T")]))
    nodes, edges = store.load_graph("d")
    assert [r.id for r in nodes.collect()] == ["c"] and edges.isEmpty()
    store.write_graphs(n.limit(0), e.limit(0), scopes=n.where("stem = 'd'"))
    assert store.has_graph("d") and store.load_graph("d")[0].isEmpty()
    store.delete_version("d", 1)
    assert not store.has_graph("d") and store.has_graph("x")
    store.update_embeddings(spark.createDataFrame([("x", 1, "z", [1.0])], "stem string, version long, id string, embedding array<float>"))
    assert store.load_graph("x")[0].first().embedding == [1.0]
    store.compact()
    assert store.nodes().count() == 1 and store.has_graph("x")
    store.reset()
    assert store.tables() == []


def test_store_refuses_bad_graphs_before_writing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    n, e = graph(spark, [("d", 1, "a", "a", "A", "T")], [("d", 1, "a", "nowhere", "R")])
    with pytest.raises(ValueError):
        store.write_graphs(n, e)
    with pytest.raises(ValueError):
        store.write_graphs(*graph(spark, [("d", 1, "a", "a", "A", "no name")]))
    assert store.tables() == []


def test_schema_versions_and_manifests(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    with pytest.raises(NotFound):
        store.active_version("d")
    assert [store.create_schema_version("d", "legal", h) for h in "ab"] == [1, 2]
    assert store.active_version("d") == 2
    store.activate_version("d", 1)
    store.delete_schema_version("d", 1)
    assert store.active_version("d") == 2
    store.save_manifest("d", original_filename="x.pdf", converter="c")
    store.save_manifest("d", converter="e")
    assert [tuple(r) for r in store.manifests().collect()] == [("d", "x.pdf", "e")]
    q = spark.createDataFrame([("d", "q1", "a?")], "stem string, id string, question string")
    assert not store.save_goldenset(q, "d") and not store.save_goldenset(q, "d")
    assert store.save_goldenset(q.withColumn("question", F.lit("b?")), "d")


def test_bulk_versions_manifests_and_question_sets(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    schemas = spark.createDataFrame([("a", "legal", "x"), ("b", "general", "y")], "stem string, document_type string, digest string")
    for _ in range(2):
        store.create_schema_versions(schemas)
    scopes = lambda *x: spark.createDataFrame(x, "stem string, version long")
    store.activate_versions(scopes(("a", 1)))
    store.delete_schema_versions(scopes(("b", 2), ("nobody", 1)))
    state = lambda: {(r.stem, r.version): r.is_active for r in store.schema_versions().collect()}
    assert state() == {("a", 1): True, ("a", 2): False, ("b", 1): True}
    with pytest.raises(NotFound):
        store.activate_versions(scopes(("b", 2)))
    q = spark.createDataFrame([("a", "q1"), ("a", "q1"), ("b", "q1")], "stem string, id string")
    assert store.save_goldensets(q).isEmpty()
    assert [r.stem for r in store.save_goldensets(q.dropDuplicates()).collect()] == ["a"]
    assert store.goldensets(q.schema).count() == 2
    store.save_manifests(spark.createDataFrame([("a", "f"), ("b", "g")], "stem string, original_filename string"))
    store.delete_document("b")
    assert [r.stem for r in store.manifests().collect()] == ["a"] and state() == {("a", 1): True, ("a", 2): False}
    store.compact()
    assert [r.stem for r in store.manifests().collect()] == ["a"] and state() == {("a", 1): True, ("a", 2): False} and store.goldensets(q.schema).count() == 2


def test_a_failed_compaction_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path))
    store.write_graphs(*graph(spark, [("d", 1, "a", "a", "A", "T"), ("d", 1, "b", "b", "B", "T")], [("d", 1, "a", "b", "R")]))
    store.write_graphs(*graph(spark, [("d", 1, "c", "c", "C", "T")]))
    renew = GraphStore._renew

    def fails(self, name, rows):
        if name == "edges":
            rows.write.parquet(f"{self.root}/{name}/{9:020d}")
            (tmp_path / name / f"{9:020d}" / "_SUCCESS").unlink()
            raise OSError("disk full")
        renew(self, name, rows)

    monkeypatch.setattr(GraphStore, "_renew", fails)
    with pytest.raises(OSError):
        store.compact()
    assert [r.id for r in store.nodes().collect()] == ["c"] and store.edges().isEmpty() and store.has_graph("d")
    store.write_graphs(*graph(spark, [("d", 1, "a", "a", "A", "T"), ("d", 1, "b", "b", "B", "T")], [("d", 1, "a", "b", "R")]))
    assert store.edges().count() == 1
    monkeypatch.undo()
    store.compact()
    store.compact()
    assert store.edges().count() == 1 and store.nodes().count() == 2


def test_old_layouts(spark):
    got = with_envelope(spark.createDataFrame([("d::v1::n7", "L")], "id string, label string")).first()
    assert got.original_id == "n7" and got.detail is None


def test_files(spark, tmp_path):
    (tmp_path / "B.md").write_text("## b")
    (tmp_path / "a.md").write_text("a\nb")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    assert [r.stem for r in X.markdown_files(spark, str(tmp_path), limit=2).orderBy("path").collect()] == ["b", "a"]
    good, bad = X.registered_uploads(spark, str(tmp_path))
    assert {r.stem for r in good.collect()} == {"a", "b"} and bad.count() == 1
    done = spark.createDataFrame([("a",)], "stem string")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in X.converted_files(spark, str(tmp_path), "*.md", lambda b: b.decode("utf-8").upper(), done).collect()}
    assert got["B.md"] == ("## B", None) and got["bad.md"][0] is None and "Unicode" in got["bad.md"][1] and "a.md" not in got
    pages = spark.createDataFrame([("p", 2, [(1.0, 0.0, "low"), (0.5, 0.0, "high")]), ("p", 1, [(0.0, 0.0, "one")])], "path string, page int, bands array<struct<top:double,left:double,text:string>>")
    assert X.paged_markdown(pages).first().text == "<!-- page: 1 -->\n\none\n\n---\n\n<!-- page: 2 -->\n\nhigh\n\nlow"
    X.dual_write(pages, str(tmp_path / "raw"), str(tmp_path / "raw0"))
    assert spark.read.parquet(str(tmp_path / "raw0")).count() == 2


def test_catalogue_source(spark, tmp_path):
    rows = [{"category": c, "name": f"{c}{k}", "goods_code": "g", "sale_date": "2020", "document_id": "d", "status": "s"} for c in "AB" for k in range(5)]
    (tmp_path / "terms.json").write_text(json.dumps(rows))
    register(spark)
    load = lambda: spark.read.format("term_catalog").option("path", str(tmp_path / "terms.json")).option("pageSize", 2).load()
    # Spark keeps a pushed filter with the loaded relation, so each filter gets a relation of its own.
    assert load().count() == 10 and load().where("name = 'A3'").count() == 1 and load().rdd.getNumPartitions() == 6
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert with_retries(flaky) == "ok"
    assert store_download(b"%PDF-1.7 x", tmp_path / "t.pdf")[0] == 10
    with pytest.raises(ValueError):
        store_download(b"<html>", tmp_path / "u.pdf")
    assert not (tmp_path / "u.pdf").exists()


def test_replies():
    assert M.parse_reply('```json\n{"a": 1} \n```\ntrailing', ("a",)) == {"a": 1}
    assert M.parse_reply('{"a": 1} and more')["a"] == 1
    assert M.parse_reply([{"type": "thinking"}, {"type": "text", "text": '{"a": 2}'}]) == {"a": 2}
    for bad in ("no", "[1]", '{"b": 1}'):
        with pytest.raises(M.MalformedReply):
            M.parse_reply(bad, ("a",))


def test_map_resumes_after_a_failure(spark, tmp_path):
    groups = spark.createDataFrame([("g1",), ("g2",), ("bad",), ("g1",)], "text string")
    op = M.OPERATIONS["extract_graph"]
    marked = M.with_fingerprints(groups, op, "extract", {"prompt": "1"}, "m")
    ok = '{"nodes": [{"id": "1", "label": "L", "type": "T"}], "edges": []}'
    cache = str(tmp_path / "cache")

    def first(operation, prompt):
        return "broken" if prompt == "bad" else ok

    with pytest.raises(RuntimeError):
        M.run_groups(marked, first, op, cache, pause=0)

    def second(operation, prompt):
        if prompt != "bad":
            raise AssertionError("asked again")
        return ok

    got = M.run_groups(marked, second, op, cache, pause=0)
    assert got.count() == 4
    assert M.unbundled(got, "nodes").count() == 4 and M.unbundled(got, "edges").count() == 0
    changed = M.with_fingerprints(groups, op, "extract", {"prompt": "2"}, "m").select("fingerprint").intersect(marked.select("fingerprint"))
    assert changed.isEmpty()


def test_embedding_batches(spark):
    texts = spark.createDataFrame([(k, "x" * k) for k in range(5)], "id long, text string")
    got = M.embedded(texts, lambda t: [[float(len(x))] for x in t], batch=2).collect()
    assert {r.id: r.vector for r in got}["4"] == [4.0]


def test_mapping_fills_gaps_and_drops_made_loops(spark):
    n = spark.createDataFrame([("d", "a", "X", "L", "", 1), ("d", "b", "Y", "L", "filled", 2), ("d", "c", "Z", "M", None, 3)], "stem string, id string, type string, label string, detail string, seq long")
    e = spark.createDataFrame([("d", "a", "b", "R", 1), ("d", "c", "c", "R", 2), ("d", "a", "a", "S", 3)], "stem string, source string, target string, type string, seq long")
    m = spark.createDataFrame([("node_type", "Y", "X"), ("edge_type", "S", None)], "kind string, old string, new string")
    nodes, edges = W.apply_mapping(n, e, m, ["stem"], "seq", ["detail"])
    assert {(r.id, r.type, r.detail) for r in nodes.collect()} == {("a", "X", "filled"), ("c", "Z", None)}
    assert [(r.source, r.target) for r in edges.collect()] == [("c", "c")]


def test_supplement_ids_are_free_and_edges_follow(spark):
    node, edge = "stem string, id string, type string, label string, seq long", "stem string, source string, target string, type string, seq long"
    base = spark.createDataFrame([("d", "n", "T", "one", 1), ("d", "s1_n", "T", "old", 2)], node)
    extra = spark.createDataFrame([("d", "n", "T", "new", 1), ("d", "m", "T", "old", 2), ("d", "n", "T", "newer", 3), ("d", "k", "T", "new", 4), ("d", "f", "T", "free", 5)], node)
    added, went = W.supplement(base, extra, ["stem"], "seq")
    assert {(r.label, r.new_id) for r in added.collect()} == {("new", "s2_n"), ("newer", "s3_n"), ("free", "f")}
    assert {(r.id, r.kept_id) for r in went.collect()} == {("n", "s3_n"), ("m", "s1_n"), ("k", "s2_n"), ("f", "f")}
    old = spark.createDataFrame([("d", "n", "s1_n", "R", 1)], edge)
    more = spark.createDataFrame([("d", "k", "m", "R", 1), ("d", "k", "m", "R", 2), ("d", "outside", "m", "R", 3), ("d", "f", "f", "R", 4)], edge)
    got = {(r.source, r.target, r.seq) for r in W.supplemented_edges(old, more, went, ["stem"], "seq").collect()}
    assert got == {("s2_n", "s1_n", 1), ("outside", "s1_n", 3), ("f", "f", 4)}


def test_refinement_refuses_and_unites(spark):
    kinds = spark.createDataFrame([("d", 1, "A", 1, "a", {"x": "string"}), ("d", 1, "B", 2, "b", {"x": "number", "y": "date"})], "stem string, version long, name string, pos int, description string, properties map<string,string>")
    links = spark.createDataFrame([("d", 1, "R", "A", "B"), ("d", 1, "Q", "B", "B"), ("d", 1, "S", "A", "C")], "stem string, version long, name string, source string, target string")
    n = spark.createDataFrame([("d", 1, "i", "A", "L", 1), ("d", 1, "j", "B", "L", 2)], "stem string, version long, id string, type string, label string, seq long")
    e = spark.createDataFrame([("d", 1, "i", "j", "R", 1), ("d", 1, "j", "j", "Q", 2)], "stem string, version long, source string, target string, type string, seq long")
    numbers = spark.createDataFrame([("d", 1, 2)], "stem string, version long, next long")
    m = lambda *x: spark.createDataFrame(x, "kind string, old string, new string")
    old = R.Version(kinds, links, n, e)
    new = R.refined(old, numbers, m(("node_type", "A", "B"), ("edge_type", "R", "Q")), "seq", [])
    assert [(r.version, r.name, r.description, r.properties) for r in new.node_types.collect()] == [(2, "B", "b / a", {"x": "number", "y": "date"})]
    assert {(r.name, r.source, r.target) for r in new.edge_types.collect()} == {("Q", "B", "B"), ("S", "B", "C")}
    assert [(r.id, r.type) for r in new.nodes.collect()] == [("i", "B")] and [(r.source, r.target, r.type) for r in new.edges.collect()] == [("i", "i", "Q")]
    changes = {r.part: (r.before, r.after) for r in R.size_changes(old, new, numbers).collect()}
    assert changes == {"node_types": (2, 1), "edge_types": (3, 2), "nodes": (2, 1), "edges": (2, 1)}
    for bad in (("node_type", "Z", "A"), ("node_type", "A", "A"), ("edge_type", "R", "S"), ("edge_type", "R", "Nope")):
        with pytest.raises(ValueError):
            R.refined(old, numbers, m(bad), "seq", [])


def test_evolution_in_order(spark):
    kinds = spark.createDataFrame([("d", 1, "A", 1, "a")], "stem string, version long, name string, pos long, description string")
    n = spark.createDataFrame([("d", 1, "i", "L"), ("d", 1, "j", "M")], "stem string, version long, id string, label string")
    e = spark.createDataFrame([("d", 1, "i", "j", "R"), ("d", 1, "j", "i", "R")], "stem string, version long, source string, target string, type string")
    numbers = spark.createDataFrame([("d", 1, 2)], "stem string, version long, next long")
    nodes = spark.createDataFrame([("d", 1, 1, "MODIFY", "i", "new"), ("d", 1, 2, "DEPRECATE", "j", None), ("d", 1, 3, "ADD", "k", "K")], "stem string, version long, seq long, decision string, id string, label string")
    edges = spark.createDataFrame([("d", 1, 1, "ADD", "i", "j", "R"), ("d", 1, 2, "DEPRECATE", "i", "j", "R"), ("d", 1, 3, "ADD", "i", "k", "R")], "stem string, version long, seq long, decision string, source string, target string, type string")
    types = spark.createDataFrame([("d", 1, 1, "DEPRECATE", "node_type", "A", None)], "stem string, version long, seq long, decision string, kind string, name string, description string")
    new = R.evolved(R.Version(kinds, kinds.limit(0), n, e), numbers, types, nodes, edges)
    assert {(r.version, r.id, r.label) for r in new.nodes.collect()} == {(2, "i", "new"), (2, "k", "K")}
    assert {(r.source, r.target) for r in new.edges.collect()} == {("j", "i"), ("i", "k")}
    assert [(r.version, r.description) for r in new.node_types.collect()] == [(2, "[DEPRECATED] a")] and new.edge_types.isEmpty()


def test_discovery_reports(spark):
    one = {"domain_model": {"domain": "", "subdomains": ["s"]}, "classes": [{"name": "C", "definition": "d", "noise": 1}], "attributes": [{"name": "a", "defined_on": "X"}, {"name": "a", "defined_on": "Y"}], "warnings": ["w", "w"]}
    two = {"domain_model": {"domain": "insurance", "subdomains": ["t", "s"]}, "attributes": [{"name": "a", "defined_on": "X", "later": True}], "terminology": [{"canonical_term": "T"}], "competency_questions": ["q?"]}
    rows = spark.createDataFrame([("d", 1, json.dumps(one)), ("d", 2, json.dumps(two)), ("x", 1, "{}")], "stem string, k int, report string")
    got = {(r.stem, r.field, r.position): r.item for r in D.reduced_reports(rows, ["stem"], "k").collect()}
    assert got[("d", "domain", 1)] == "insurance" and [got[("d", "subdomains", k)] for k in (1, 2)] == ["s", "t"] and got[("d", "warnings", 1)] == "w"
    assert json.loads(got[("d", "attributes", 1)]) == {"name": "a", "defined_on": "X"} and len(got) == 8
    sent = {r.stem: json.loads(r.payload) for r in D.consolidation_payloads(rows, ["stem"], "k").collect()}
    assert sent["d"][0] == {"group": 1, "classes": [{"name": "C", "definition": "d"}], "relationships": []} and len(sent["d"]) == 2


def test_schema_rules(spark):
    t = spark.createDataFrame([("d", "node_type", "Ok", None, None), ("d", "node_type", "ok", None, None), ("d", "node_type", "no good\n", None, None), ("d", "edge_type", "R", "OK", "Gone")], "stem string, kind string, name string, source string, target string")
    got = {(r.rule, r.element) for r in S.validate_types(t, ["stem"]).collect()}
    assert got == {("duplicate_type", "ok"), ("invalid_identifier", "no good\n"), ("unknown_endpoint", "Gone")}
    p = spark.createDataFrame([("d", "T", "a", "string"), ("d", "T", "A", "text")], "stem string, type string, name string, datatype string")
    assert {r.rule for r in S.validate_properties(p, ["stem"]).collect()} == {"duplicate_property", "unsupported_datatype"}


def test_type_changes(spark):
    t = spark.createDataFrame([("d", "A", 1, "a"), ("d", "B", 2, "b")], "stem string, name string, pos long, description string")
    c = spark.createDataFrame([("d", "A", 1, "DEPRECATE", None), ("d", "A", 2, "DEPRECATE", None), ("d", "B", 3, "MODIFY", "bb"), ("d", "B", 4, "DEPRECATE", None), ("d", "C", 5, "ADD", "c"), ("d", "D", 6, "DEPRECATE", None)], "stem string, name string, seq long, decision string, description string")
    got = {r.name: r.description for r in S.apply_changes(t, c, ["stem"]).collect()}
    assert got == {"A": "[DEPRECATED] [DEPRECATED] a", "B": "[DEPRECATED] bb", "C": "c"}


def test_jobs(spark):
    import threading

    from docweave.streaming.jobs import Jobs

    jobs, gate = Jobs(spark), threading.Event()
    assert jobs.status("d") == ("idle", None)
    assert jobs.start("d", lambda: gate.wait(20) and spark.range(3).count()) and not jobs.start("d", lambda: 1)
    assert jobs.status("d")[0] == "running"
    gate.set()
    assert jobs.futures["d"].result(30) == 3 and jobs.status("d") == ("done", None)
    assert jobs.start("d", lambda: 1 / 0)
    jobs.futures["d"].exception(30)
    assert jobs.status("d")[0] == "error"
