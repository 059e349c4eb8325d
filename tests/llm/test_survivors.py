from __future__ import annotations

import datetime as dt
import itertools
import random

from docweave.llm.survivors import GROUP, Bundle, best_assignment, best_bundles, surviving_fields, surviving_records, with_thing_keys

SCHEMA = "node_no long, stem string, version long, label string, type string, detail string, confidence string, extracted_at timestamp, evidence_text string, start_offset long, end_offset long, chunk_id long, source_section string, rank_ string"
T0 = dt.datetime(2024, 1, 1)


def node(no, label, type_, detail=None, confidence="HIGH", day=0, stem="s", version=1, evidence=None, chunk=None, section=None):
    return (no, stem, version, label, type_, detail, confidence, T0 + dt.timedelta(days=day) if day is not None else None, evidence, None, None, chunk, section, "clash")


def run(spark, rows):
    return {(r.group_no, r.field_name): r.from_no for r in surviving_fields(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_field_by_confidence_time_length_and_number(spark):
    rows = [
        node(5, "Ａ B", "Insured_Event", "N/A", "LOW", 9),
        node(6, "a-b", "insuredevent", "long text", "medium", 1),
        node(7, "「A b」", "UNKNOWN", "longest text", "Medium", 1),
        node(8, "AB", None, None, "CERTAIN", 30),
        node(9, "A B", "Other", "x"),
        node(10, "A B", "Insured Event", " 해당 없음 ", None, None, version=2),
    ]
    assert run(spark, rows) == {(5, "label"): 7, (5, "type"): 6, (5, "detail"): 7} or run(spark, rows)[(5, "detail")] == 7
    single = [r for r in rows if r[0] not in (7, 8)]
    got = run(spark, single)
    assert got == {(5, "label"): 6, (5, "type"): 6, (5, "detail"): 6}


def test_ties_nulls_and_unusable_values(spark):
    rows = [node(1, "x", "T", "-"), node(2, "X", "t", "없음"), node(3, None, "T", "d"), node(4, "-", "T", "d"), node(6, "y", "-", "d"), node(7, "Y", "", "e", day=1), node(8, "y", None, "ee", day=1)]
    assert run(spark, rows) == {(1, "label"): 1, (1, "type"): 1, (6, "label"): 7, (6, "detail"): 8}
    assert run(spark, []) == {}
    assert run(spark, [node(1, "solo", "T", "d")]) == {}


def test_null_scopes_group_together(spark):
    rows = [node(1, "x", "T", "d", stem=None), node(2, "x", None, "d", stem=None), node(3, "x", "T", "d", stem="s")]
    assert run(spark, rows) == {(1, "label"): 1, (1, "type"): 1, (1, "detail"): 1}


def test_branching_keeps_the_dependency(spark):
    # The best section is stated with another passage; the best evidence implies its own section.
    rows = [node(1, "x", "T", confidence="HIGH", evidence="e1", chunk=1, section="S1", day=1), node(2, "x", "T", confidence="HIGH", evidence=None, section="S2", day=5), node(3, "x", "T", confidence="LOW", evidence="e3", chunk=3, section="S3")]
    got = surviving_records(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.group_no, r.evidence_text, r.chunk_id, r.source_section) for r in got] == [(1, "e1", 1, "S1")]


def test_branch_and_bound_equals_trying_everything(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        rows.append(node(k + 1, f"thing{k % 40}", "T", rng.choice(["p", "q", "r", None]), rng.choice(["HIGH", "MEDIUM", "LOW", None]), rng.randrange(20), evidence=rng.choice(["e1", "e2", "e3", None]), section=rng.choice(["S1", "S2", "S3", None])))
    bundles = [Bundle("detail", ("detail",)), Bundle("evidence", ("evidence_text",)), Bundle("section", ("source_section",))]
    keyed = with_thing_keys(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in best_bundles(keyed, GROUP, "node_no", "confidence", "extracted_at", bundles, [("evidence", "section"), ("section", "detail")]).collect():
        got.setdefault(r.group_no, {})[r.bundle] = r.from_no
    by_no = {r[0]: r for r in rows}
    column = {"detail": 5, "evidence": 8, "section": 12}
    rank = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, None: 0}
    trust = lambda r, c: (rank[r[6]], r[7], len(r[c]), -r[0])
    for g in range(40):
        own = [r for r in rows if r[3] == f"thing{g}"]
        best = {n: {v: max((r for r in own if r[c] == v), key=lambda r: trust(r, c)) for v in {r[c] for r in own} - {None}} for n, c in column.items()}
        implied = lambda x, y: {v: max((r for r in own if r[column[x]] == v and r[column[y]] is not None), key=lambda r: trust(r, column[y]), default=None) for v in best[x]}
        rules = {(x, y): {v: r[column[y]] for v, r in implied(x, y).items() if r} for x, y in (("evidence", "section"), ("section", "detail"))}

        def score(pick):
            for (x, y), f in rules.items():
                if f.get(pick[x], pick[y]) != pick[y]:
                    return None
            held = [trust(best[n][v], column[n]) for n, v in pick.items()]
            return sum(t[0] for t in held), held

        picks = [dict(zip(column, vs)) for vs in itertools.product(*(best[n] for n in column))]
        possible = [p for p in picks if score(p) is not None]
        chosen = {n: by_no[no][column[n]] for n, no in got.get(min(r[0] for r in own), {}).items()}
        assert chosen == (max(possible, key=score) if possible else {})


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(8)
    rows = [
        node(k, "thing", "T", rng.choice("pqr"), "LOW", rng.randrange(3), evidence=rng.choice(["e1", "e2", "e3"]), section=rng.choice(["S1", "S2", "S3"])) for k in range(1, 25)
    ]
    results = set()
    for _ in range(3):
        rng.shuffle(rows)
        results.add(tuple(surviving_records(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert len(results) == 1


def test_search_without_rules_takes_every_best_value():
    options = [[(1, None, 3, 7, None), (3, 5, None, 9, None), (3, 5, None, 4, None)], [], [(0, 2, 1, 1, None)]]
    assert [c and c[3] for c in best_assignment(options, [], {})] == [4, None, 1]
