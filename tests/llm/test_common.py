from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from docweave.llm import common as C


def test_pairs_within_groups_of_any_size(spark):
    rows = [("hot", k) for k in range(25)] + [("two", 1), ("two", 2), ("two", 2), ("one", 7), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key string, id long").withColumn("a", F.lit("clash"))
    want = {("hot", *p) for p in itertools.combinations(range(25), 2)} | {("two", 1, 2)}
    for block in (4, 1000):
        got = {(r.key, r.a, r.b) for r in C.pairs_within(df, ["key"], "id", block).collect()}
        assert got == want
    assert C.pairs_within(df.limit(0), ["key"], "id").isEmpty()
