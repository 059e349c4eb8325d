"""Golden-set evaluation, judged questions, parts in texts, replies: small cases against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from docweave.operators import evaluation as E
from docweave.plans import providers as M


def test_parts_are_found_in_all_texts_that_hold_them(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("가나다라마바사아") for _ in range(n))
    texts = [("s" if k % 3 else "t", k, noise(rng.randrange(0, 400))) for k in range(60)] + [("s", 90, None), ("s", 91, ""), ("u", 92, "가나다")]
    parts = []
    for k in range(80):
        scope, _, text = texts[rng.randrange(60)]
        n = rng.choice((1, 2, 5, 11, 12, 13, 23, 24, 25, 80))
        at = rng.randrange(max(1, len(text) - n))
        parts.append((scope, k, text[at : at + n] if k % 4 else noise(n)))
    parts += [("s", 900, None), ("s", 901, ""), ("nowhere", 902, "가")]
    got = {(r.part_id, r.text_id) for r in E.containing_texts(spark.createDataFrame(parts, "stem string, part_id long, part string"), spark.createDataFrame(texts, "stem string, text_id long, text string"), "stem").collect()}
    want = {(i, j) for s, i, p in parts for t, j, x in texts if s == t and p and x and p in x}
    assert got == want and len(want) > 100


def test_no_key_is_lost_at_any_length():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(200))
    for n in range(1, 60):
        for at in range(0, 200 - n, 7):
            part = text[at : at + n]
            assert np.int64(E._part_key(part)) in E._text_keys(text, [n] if n < E.PART_GRAM + E.PART_WINDOW - 1 else []).view(np.int64)


def test_answer_facts(spark):
    df = spark.createDataFrame([(1, [("a", "b", "o1"), ("a", "b", "")], "x"), (2, None, "x"), (3, [], ""), (4, None, None)], "k int, facts array<struct<subject:string,predicate:string,object:string>>, answer string")
    assert {r.k: r.f for r in df.select("k", E.answer_facts(F.col("facts"), F.col("answer")).alias("f")).collect()} == {1: ["o1"], 2: ["x"], 3: [], 4: []}


def test_judge_is_not_asked_without_context(spark):
    asked = []
    q = spark.createDataFrame([(1, "q", "text"), (2, "q", ""), (3, "q", None), (4, "q", "lost")], "key long, question string, context string")

    def verdicts(rows):
        asked.extend(r.key for r in rows.collect())
        return spark.createDataFrame([(1, True)], "key long, answerable boolean")

    got = {r.key: r.answerable for r in E.judged(q, verdicts).collect()}
    assert got == {1: True, 2: False, 3: False, 4: None} and sorted(asked) == [1, 4]


def test_readings_and_probe(spark):
    questions = spark.createDataFrame([("q1", True, "list"), ("q2", True, None), ("q3", False, "list")], "question_id string, answerable boolean, question_type string")
    parts = spark.createDataFrame([("q1", "strict", True, True), ("q1", "strict", False, True), ("q2", "strict", False, False), ("q1", "answer", False, True)], "question_id string, reading string, cited boolean, in_graph boolean")
    got = {(r.reading, r.question_id): (r.outcome, r.recall) for r in E.score_readings(questions, parts, ["strict", "answer"]).collect()}
    assert got == {("strict", "q1"): ("hit", 0.5), ("strict", "q2"): ("extraction_miss", 0.0), ("strict", "q3"): ("unanswerable", None), ("answer", "q1"): ("retrieval_miss", 0.0), ("answer", "q2"): ("unscorable", None), ("answer", "q3"): ("unanswerable", None)}
    span = "question_id string, chunk_id long, a_id long, s long, e long"
    passages = spark.createDataFrame([("q1", 1, 1, 0, 10), ("q1", 1, 2, 50, 60), ("q2", 2, 3, 0, 10)], span)
    found = spark.createDataFrame([(1, 7, 4, 12), (2, 8, 9, 30)], "chunk_id long, b_id long, s long, e long")
    missed = spark.createDataFrame([("q1",), ("q2",), ("q9",)], "question_id string")
    assert tuple(E.probe_summary(missed, passages, found).first()) == (3, 1, 1, 1)


def test_replies_and_ordered_map(spark):
    rows = spark.createDataFrame([(1, 'text\n{"a": 1}'), (2, '```json\n{"a": {"b": [1]}}\n``` tail'), (3, "nothing"), (4, None), (5, '{"b": 1} {"a": 2}')], "k long, reply string")
    got = {r.k: (r.value, r.error is None) for r in M.parsed_replies(rows, "k", ("a",)).collect()}
    assert got[2] == ('{"a": {"b": [1]}}', True) and not any(got[k][1] for k in (3, 4, 5))
    items = spark.createDataFrame([(k, "x" * (k % 4)) for k in range(20)], "k long, t string")
    assert {r.k: r.reply for r in M.map_concurrently(items, "k", "t", lambda t: str(len(t)), at_once=2).collect()} == {k: str(k % 4) for k in range(20)}


def test_quotes_are_anchored_at_their_first_place(spark):
    texts = spark.createDataFrame([("d", 1, "abc", 0), ("d", 2, "xx the quote", 5), ("d", 3, "the quote", 19), ("e", 4, "the quote", 0)], "stem string, text_id long, text string, base long")
    quotes = spark.createDataFrame([(1, "d", "the quote"), (2, "d", "the quote"), (3, "d", "nowhere"), (4, "e", "quote"), (5, "d", ""), (6, "d", None)], "k int, stem string, quote string")
    got = {r.k: (r.start, r.end) for r in E.anchored(quotes, texts, "stem").collect()}
    assert got[1] == got[2] == (8, 17) and got[3] == (None, None) and got[4] == (4, 9) and got[5][0] is None and got[6] == (None, None)


def test_readiness_by_stage(spark):
    stems = lambda *x: spark.createDataFrame([(s,) for s in x], "stem string")
    held = {"text": stems("a", "b"), "chunks": stems("a"), "graph": stems("a"), "active version": stems(), "golden set": stems("a")}
    got = {(r.stem, r.stage, r.problem) for r in E.readiness(stems("a", "b", "b"), held).collect()}
    assert got == {("a", "reextract", "no active version"), ("b", "schema", "no chunks"), ("b", "reextract", "no chunks"), ("b", "reextract", "no graph"), ("b", "reextract", "no active version"), ("b", "score", "no golden set"), ("b", "score", "no graph")}


def test_held_quotes_against_whole_texts(spark):
    rng = random.Random(9)
    noise = lambda n, letters="가나다\n ": "".join(rng.choice(letters) for _ in range(n))
    parts = [("a", k * 40_000, noise(rng.randrange(120))) for k in range(80)] + [("a", 7, None), ("a", 8, ""), ("a", None, "끝이다"), ("b", 1, noise(9000, "가나다라😀")), ("b", 2, "x"), ("b", 2, "a"), ("c", 1, "text"), (None, 1, "text")]
    whole = {}
    for s, _, t in sorted((p for p in parts if p[0]), key=lambda p: (p[0], p[1] is None, p[1] or 0, p[2] or "")):
        whole[s] = f"{whole[s]}\n\n{t or ''}" if s in whole else t or ""
    quotes = [("a", whole["a"]), ("a", "x" + whole["a"]), ("a", whole["a"] + "\n"), ("a", "\n" + whole["a"]), ("a", "\n\n끝이다"), ("b", "a\n\nx"), ("b", "x\n\na"), ("b", "\n"), ("b", whole["b"][40:8000]), ("b", whole["b"][40:8000] + "!"), ("c", "text"), ("c", "text\n\n"), ("c", ""), ("c", None), (None, "text"), ("d", "text")]
    for k in range(1200):
        s = rng.choice("aab")
        n = rng.choice((1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 31, 40, 64, 100, 300))
        at = rng.randrange(len(whole[s]) - n)
        q = whole[s][at : at + n]
        quotes.append((s, q if k % 3 else q[: n // 2] + rng.choice("가나다x") + q[n // 2 + 1 :]))
    want = {(s, q) for s, q in quotes if s and q and q in whole.get(s, "")}
    q, t = spark.createDataFrame(quotes, "stem string, quote string"), spark.createDataFrame(parts, "stem string, part long, text string")
    for room in (1, E.ROOM):
        got = [tuple(r) for r in E.held_quotes(q, t, "stem", "part", room).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert E.held_quotes(q, t.where("false"), "stem", "part").isEmpty() and E.held_quotes(q.where("false"), t, "stem", "part").isEmpty()


def test_quotes_are_looked_up_by_hashes_and_compared():
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(3000)) + "a" * 300
    quotes = list({text[i : i + n] for n in range(1, 130, 3) for i in range(0, 3000, 97)} | {"a" * n for n in range(1, 400)} | {"c", "abc", "b" * 70})
    assert {quotes[i] for i in E._Quotes(quotes).within(text)} == {q for q in quotes if q in text}
    index = E._Quotes(["ab", "ba"])
    index.quotes = ["xx", "ba"]  # the hash of another text
    assert index.within("ab") == set()
