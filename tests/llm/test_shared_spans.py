from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from docweave.llm.shared_spans import SharedSpans, _common, compact_windows

SPAN, GRAM = 24, 10
SCHEMA = "rec_kind string, rec_id long, text string"


def noise(rng, n):
    return "".join(rng.choice("가나다라마바사아자차 .abc") for _ in range(n))


def brute(rows, span):
    found = set()
    grams = {}
    for kind, i, text in rows:
        for s in range(len(text or "") - span + 1):
            grams.setdefault((kind, text[s : s + span]), set()).add(i)
    for (kind, _), ids in grams.items():
        ids = sorted(ids)
        found |= {(kind, a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
    return found


def corpus():
    rng = random.Random(5)
    shared = [noise(rng, n) for n in (23, 24, 25, 60)]
    rows = [("doc", k, noise(rng, 80)) for k in range(30)]
    rows += [("doc", 100 + k, noise(rng, 30) + shared[k % 4] + noise(rng, 20)) for k in range(24)]
    rows += [("chunk", 100 + k, shared[3] + noise(rng, 9)) for k in range(4)]
    rows += [("doc", 200 + k, "같은 글 " * 9) for k in range(5)] + [("doc", 210, "ab" * 40), ("doc", 211, "ab" * 30 + "x"), ("doc", 212, "a" * 50), ("doc", 213, "a" * 23)]
    return rows + [("doc", 300, None), ("doc", 301, ""), ("chunk", 302, "kurz"), ("doc", 303, "a" * 20_000)]


def found(o):
    return {(r.rec_kind, r.id_a, r.id_b) for r in o.record_pairs().collect()}


def test_equals_brute_force_on_the_usual_and_the_hot_path(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit("clash"))
    want = brute(rows, SPAN)
    assert len(want) > 50
    assert found(SharedSpans(df, SPAN, GRAM)) == want
    assert found(SharedSpans(df, SPAN, GRAM, hot=1)) == want
    assert found(SharedSpans(df.union(df).repartition(7), SPAN, GRAM, hot=3)) == want


def test_coverage(spark):
    rows = [("doc", 1, "x" * 10 + "0123456789abcdefghijklmnop"), ("doc", 2, "0123456789abcdefghijklmnop" + "yz"), ("doc", 3, "allein" * 9), ("doc", 4, "gleich" * 5), ("doc", 5, "gleich" * 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (64, 1):
        got = {r.rec_id: r.shared_chars for r in SharedSpans(df, SPAN, GRAM, hot).coverage().collect()}
        assert got == {1: 26, 2: 26, 3: 0, 4: 30, 5: 30}


def test_coverage_has_a_row_for_every_record(spark):
    rows = [("doc", 1, "kurz"), ("doc", 2, "kurz"), ("doc", 3, "kur"), ("chunk", 1, "kurz"), ("doc", 4, ""), ("doc", 5, None), ("doc", 6, "allein" * 9)]
    o = SharedSpans(spark.createDataFrame(rows, SCHEMA), SPAN, GRAM)
    got = {(r.rec_kind, r.rec_id): (r.n_chars, r.shared_chars, r.shared_share) for r in o.coverage().collect()}
    none = (0, 0, 0.0)
    assert got == {("doc", 1): (4, 4, 1.0), ("doc", 2): (4, 4, 1.0), ("doc", 3): (3, 0, 0.0), ("chunk", 1): (4, 0, 0.0), ("doc", 4): none, ("doc", 5): none, ("doc", 6): (54, 0, 0.0)}
    assert o.record_pairs().isEmpty()


def test_empty_table(spark):
    o = SharedSpans(spark.createDataFrame([], SCHEMA))
    assert o.record_pairs().isEmpty() and o.coverage().isEmpty()


def test_windows_are_those_whose_centre_is_the_minimum():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 9, 60), rng.integers(0, 2, 60), np.zeros(60, int), rng.integers(0, 10**9, 200)):
        h, t = values.astype(np.uint64), 7
        got = {(l, c, r) for l, c, r in compact_windows(h, t)}
        want = {s + int(h[s : s + t].argmin()) for s in range(len(h) - t + 1)}
        assert {c for _, c, _ in got} == want
        for l, c, r in got:
            assert r - l + 1 >= t and h[c] == h[l : r + 1].min() and not (h[l:c] == h[c]).any()


def test_common_prefix():
    assert [_common(a, b) for a, b in (("", "a"), ("abc", "abd"), ("a" * 500, "a" * 499 + "b"), ("x" * 300, "x" * 300))] == [0, 2, 499, 300]
