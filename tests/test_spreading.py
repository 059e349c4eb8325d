from __future__ import annotations

import random

from docweave.operators import domain as D
from docweave.operators import schema as S
from docweave.operators.spreading import salted_join, sums_before


def test_sums_over_buckets(spark):
    rng = random.Random(2)
    rows = [(s, k, rng.randrange(9)) for s in ("a", "b") for k in rng.sample(range(500), 120)]
    got = {(r.s, r.k): r.before for r in sums_before(spark.createDataFrame(rows, "s string, k long, n int"), "s", "k", "n", "before", bucket=16).collect()}
    assert got == {(s, k): sum(n for t, j, n in rows if t == s and j < k) for s, k, _ in rows}


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([("a", k) for k in range(50)] + [("b", 1), (None, 2)], "key string, x long")
    right = spark.createDataFrame([("a", "u"), ("a", "v"), ("c", "w"), (None, "z")], "key string, y string")
    for block in (3, 1000):
        got = sorted((r.key, r.x, r.y) for r in salted_join(left, right, ["key"], "x", block).collect())
        assert got == sorted(("a", k, y) for k in range(50) for y in "uv")


def test_domain_store(spark, tmp_path):
    store = D.DomainStore(spark, str(tmp_path))
    assert store.stems().isEmpty() and store.history().isEmpty() and store.pending().isEmpty()
    stems = spark.createDataFrame([("m", "a"), ("m", "b")], "domain string, stem string")
    queue = spark.createDataFrame([("m", "c1"), ("m", None), ("m", "c2")], "domain string, change_id string")
    store.append_run(stems, stems, queue)
    store.resolve(queue.where("change_id is null or change_id = 'c1'"))
    store.append_run(stems.limit(1), stems.limit(1), queue.where("change_id = 'c1'"))
    assert store.stems().count() == 2 and store.history().count() == 3 and sorted(r.change_id for r in store.pending().collect()) == ["c1", "c2"]


def test_reused_schemas(spark):
    t = spark.createDataFrame([("a", 1, "X"), ("a", 2, "Y"), ("b", 5, "Z")], "stem string, version long, name string")
    active = spark.createDataFrame([("a", 2)], "stem string, version long")
    pairs = spark.createDataFrame([("b", "a"), ("new", "a"), ("c", "nobody")], "stem string, source string")
    assert {tuple(r) for r in S.reused_schemas(t, active, pairs).collect()} == {("b", 6, "Y"), ("new", 1, "Y")}
