from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import common as C
from docweave.llm import leakage as K
from docweave.llm import mixing as M
from docweave.llm import reading_level as R

LETTERS = "가나다라마바사아자차카타파하abcdef"


def noise(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def brute(docs, items, share=K.SHARE):
    out = set()
    for d, text in docs:
        t = C.letters_only(text or "")
        for i, p, _ in items:
            x = C.letters_only(p or "")
            if x and K.longest_run(x, t) >= round(share * len(x), 6):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(k, noise(rng, rng.randrange(40, 160)), "무엇인가?") for k in range(40)] + [(50, "", None), (51, None, "x"), (52, "짧은", "?"), (53, "the A-bc, DEF!", None)]
    items += [(60, items[3][1], "again")]
    docs = []
    for k in range(120):
        x = items[k % 40][1]
        n = round(len(x) * rng.choice((0.4, 0.53, 0.56, 0.7, 1)))
        s = rng.randrange(len(x) - n + 1)
        part = " ".join(x[s : s + n]).upper() if k % 2 else x[s : s + n]
        docs.append((k, noise(rng, rng.randrange(3000)) + part + noise(rng, rng.randrange(1500))))
    docs += [(200, None), (201, ""), (202, "이 짧은 글"), (203, "THE abcｄｅｆ"), (204, items[0][1])]
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items + items[:2], "item_id long, passage string, question string").withColumn("text", F.lit("clash"))
    got = K.leaked_items(d, i).collect()
    want = brute(docs, items)
    assert len(want) > 60
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.passage_share >= K.SHARE for r in got)


def test_leaks_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "passage", "q")], "item_id long, passage string, question string")
    assert K.leaked_items(d, i.limit(0)).isEmpty() and K.leaked_items(d.limit(0), i).isEmpty()


def test_parts_of_the_items_give_the_same_leaks(spark):
    rng = random.Random(5)
    items = [(k, noise(rng, rng.randrange(1, 90)), None) for k in range(60)]
    docs = [(k, noise(rng, 200) + items[k][1][: len(items[k][1]) * 2 // 3 + 1] + noise(rng, 50)) for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string")
    want = brute(docs, items)
    for chars in (K.PART_CHARS, 900):
        assert {(r.doc_id, r.item_id) for r in K.leaked_items(d, i, part_chars=chars).collect()} == want


def test_thresholds_are_the_least_of_all_windows_and_long_items_are_quick():
    rng = random.Random(2)
    passages = ["".join(rng.choice("가나다") for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    index = K.ItemIndex(list(range(25)), passages, [""] * 25)
    first, item, weight = index.by_item
    for k, x in enumerate(index.texts):
        numbers = index.numbers(C.gram_hashes(C.prefix_sums(C.code_points(x)), index.gram))[1].tolist()
        own = {g: w for g in set(numbers) for i, w in zip(item[first[g] : first[g + 1]], weight[first[g] : first[g + 1]]) if i == k}
        width = index.need[k] - index.gram + 1
        sums = [sum(own[g] for g in set(numbers[s : s + width])) for s in range(len(numbers) - width + 1)] if width > 0 else []
        assert abs(index.threshold[k] - min(sums)) < 1e-5 if sums else np.isinf(index.threshold[k])
    began = time.time()
    K.ItemIndex(list(range(50)), [noise(rng, 4000) for _ in range(50)], [""] * 50)
    assert time.time() - began < 10


DOCS = "doc_id long, source string, text string"
TARGETS = "source string, target_weight double, max_repeats int"


def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    docs = [(k, "abc"[k % 3] if k % 10 else "a", "word " * rng.randrange(1, 60)) for k in range(600)] + [(900, None, "x"), (901, "zzz", "x"), (902, "a", None), (903, "b", "")]
    targets = [("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.25, 1), ("gone", 0.05, 4), (None, 0.1, 1)]
    mix = M.Mix(spark.createDataFrame(docs, DOCS).withColumn("tokens", F.lit("clash")), spark.createDataFrame(targets, TARGETS))
    shares = {r.source: r for r in mix.shares().collect()}
    uses = mix.uses().collect()
    longest = max(r.tokens for r in uses)
    limits = {"a": 2, "b": 3, "c": 1}
    for s, most in limits.items():
        r = shares[s]
        goal = min(r.wanted, r.available)
        assert goal - longest < r.reached <= goal
        assert all(u.n_uses <= most for u in uses if u.source == s)
        assert r.short == (r.available < r.wanted)
    assert shares["gone"].short and shares["gone"].reached == 0
    assert len({u.doc_id for u in uses}) == len(uses) and abs(sum(r.share for r in shares.values()) - 1) < 1e-9
    # Which documents are taken in the last epoch hangs on the hash only.
    again = M.Mix(spark.createDataFrame(docs[::-1], DOCS).repartition(5), spark.createDataFrame(targets, TARGETS)).uses().collect()
    assert {(u.doc_id, u.n_uses) for u in again} == {(u.doc_id, u.n_uses) for u in uses}


def test_mix_of_nothing(spark):
    mix = M.Mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 2)], TARGETS))
    assert mix.uses().isEmpty() and {r.source: r.short for r in mix.shares().collect()} == {"a": False, "b": False}


def test_token_sizes_are_the_tokenizers(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER, "rb"))}
    own = tiktoken.Encoding("t", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["보험금을 지급합니다. 12", "plain words", "", None, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("a"))
    assert {r.doc_id: r.tokens for r in M.token_sizes(df).collect()} == {k: len(own.encode_ordinary(t or "")) for k, t in enumerate(texts)}


EASY, HARD = ["표를 고르세요.", "돈은 12원이에요.", "편지를 찾으세요."], ["귀책사유로 경합하는 범위에서 정산한다.", "준용함에 있어 소멸한다.", "산입하지 아니하고 심사한다."]


def test_levels_of_held_out_documents(spark):
    rng = random.Random(6)
    docs, truth = [], {}
    for k in range(400):
        level = rng.randrange(1, 6)
        truth[k] = level
        docs.append((k, " ".join(rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(60))))
    docs += [(900, None), (901, ""), (902, "...")]
    labels = [(k, "r", min(5, max(1, truth[k] + rng.choice((0, 0, 0, 0, 1, -1)))), ) for k in range(0, 400, 2)] + [(3, "r", None), (777, "r", 2)]
    levels = R.reading_levels(spark.createDataFrame(docs, "doc_id long, text string").withColumn("level", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, rater string, level int"))
    got = {r.doc_id: r.level for r in levels.collect()}
    assert set(got) == {k for k, t in docs if t}
    held_out = [k for k in range(1, 400, 2)]
    assert sum((got[k] >= R.DEMANDING) == (truth[k] >= 4) for k in held_out) / len(held_out) >= 0.93
    assert all(1 <= v <= 5 for v in got.values())


def test_levels_without_grades_or_documents(spark):
    d = spark.createDataFrame([(1, "text here")], "doc_id long, text string")
    l = spark.createDataFrame([(1, 3)], "doc_id long, level int")
    assert R.reading_levels(d, l.limit(0)).isEmpty() and R.reading_levels(d.limit(0), l).isEmpty()
    assert [r.level for r in R.reading_levels(d, l).collect()] == [3.0]


def test_monotone_fit():
    x, y = R.monotone_fit(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]))
    assert (x, y) == ([1.0, 1.0, 2.0, 3.0, 4.0, 4.0], [1.0, 1.0, 2.5, 2.5, 5.0, 5.0])


def test_part_of_a_short_item(spark):
    d = spark.createDataFrame([(1, "앞 가나다라마바 뒤"), (2, "가나다라마"), (3, "아자차카타파하거")], "doc_id long, text string")
    i = spark.createDataFrame([(7, "가나다라마바사아자차", "")], "item_id long, passage string, question string")
    assert {(r.doc_id, r.item_id, r.passage_share) for r in K.leaked_items(d, i).collect()} == {(1, 7, 0.6)}
