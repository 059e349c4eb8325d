from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import common as C
from docweave.llm import near_duplicates as N

LETTERS = "가나다라마바사아자차카타파하거너더러머버서어저처"


def noise(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def edited(rng, text, edits):
    x = list(text)
    for _ in range(edits):
        k = rng.randrange(len(x))
        rng.choice((lambda: x.__setitem__(k, "뷁"), lambda: x.insert(k, "뷁"), lambda: x.pop(k)))()
    return "".join(x)


def corpus():
    rng = random.Random(11)
    rows = [(k, noise(rng, rng.randrange(150, 500))) for k in range(60)]
    for k in range(40):
        base = rows[k][1]
        half = len(base) // 2
        rows.append((100 + k, edited(rng, base, 3) if k % 3 else base[half:] + base[:half]))
    rows += [(200, rows[0][1]), (201, " ".join(rows[0][1])), (202, unicodedata.normalize("NFD", rows[1][1])), (203, "짧다"), (204, "짧 다"), (205, "짧은글"), (206, None), (207, ""), (208, "  \n"), (209, "ＡＢＣ" * 60), (210, "ABC" * 60)]
    return rows


def brute(rows):
    texts = {i: C.compact(t) for i, t in rows if t}
    points = {i: C.code_points(t) for i, t in texts.items() if t}
    ids = sorted(points)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if texts[a] == texts[b] or min(N.covered(points[a], points[b], N.RUN), N.covered(points[b], points[a], N.RUN)) >= N.SHARE:
                out.add((a, b))
    return out


def pairs(o):
    return {(r.id_a, r.id_b) for r in o.pairs().collect()}


def test_texts_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string").withColumn("cls", F.lit("clash"))
    want = brute(rows)
    assert len(want) > 40
    assert pairs(N.near_duplicate_texts(df)) == want
    assert pairs(N.near_duplicate_texts(df, cap=2)) == want


def test_scattered_edits_and_repeated_texts(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        base = noise(rng, 1300)
        rows += [(k, base), (100 + k, "".join("뷁" if rng.random() < 0.08 else c for c in base))]
    base = noise(rng, 400)
    rows += [(300, base), (301, base * 4)]
    want = brute(rows)
    assert len(want) > 35 and (300, 301) in want
    got = pairs(N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string")))
    assert got <= want and len(got) >= 0.97 * len(want) and (300, 301) in got


def test_classes_and_links(spark):
    rng = random.Random(2)
    base = noise(rng, 300)
    rows = [(1, base), (2, base), (3, edited(rng, base, 2)), (4, noise(rng, 300)), (5, None)]
    got = {r.id: (r.class_id, r.n_links) for r in N.near_duplicate_texts(spark.createDataFrame(rows, "id long, text string")).classes().collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0)}


def test_long_chain_is_one_class(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "a long, b long")
    members = spark.createDataFrame([(k, k) for k in range(1, 42)], "id long, rep long")
    got = {r.id: r.class_id for r in N.NearDuplicates(links, members).classes().collect()}
    assert got == {k: 1 for k in range(1, 41)} | {41: 41}


def test_listings(spark):
    rows = [
        (1, "가나다라건강보험(1011)(무배당)", "20101101"), (2, "무배당 가나다라 건강보험_1011 약관", "2010-11-01"), (3, "가나다건강라보험（1011）", "2010.11.01"), (4, "가나다라건강보험(1012)(무배당)", "20101101"),
        (5, "가나다라건강보험(1011) 2종", "20101101"), (6, "가나다라건강보험(1011)", "20101102"), (7, "가나마바사보험(1011)", "20101101"), (8, "", "20101101"), (9, None, None), (10, "가나다라건강보험", "2010/11/01"), (11, "가나다라건강보험(1011)(무배당)", "20101101"),
    ]
    df = spark.createDataFrame(rows, "id long, name string, sale_date string")
    same = {(1, 2), (1, 3), (2, 3), (1, 11), (2, 11), (3, 11), (1, 10), (2, 10), (3, 10), (4, 10), (10, 11)}
    for cap in (1500, 2):
        assert pairs(N.near_duplicate_names(df, cap=cap)) == same


def test_empty_tables(spark):
    assert not pairs(N.near_duplicate_texts(spark.createDataFrame([], "id long, text string")))
    assert not pairs(N.near_duplicate_names(spark.createDataFrame([], "id long, name string, sale_date string")))


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_what_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, (9, 2))
    prints = []
    for _ in range(300):
        low, high = map(int, centres[rng.integers(9)])
        for bit in rng.integers(0, 64, rng.integers(0, 9)):
            low ^= 1 << int(bit)
        prints.append(((high << 64) | low,))
    tree = N.VantageTree(len(prints), N.hamming_metric(prints))
    for q in range(0, 300, 17):
        assert sorted(tree.within(q, 12)) == [k for k, p in enumerate(prints) if N.one_hamming(p, prints[q]) <= 12]


def test_edit_distances_agree():
    rng = random.Random(4)
    names = ["".join(rng.choice("가나다") for _ in range(rng.randrange(9))) for _ in range(50)]
    many = N.edit_metric(names)
    for i in range(0, 50, 7):
        assert many(i, np.arange(50)).tolist() == [N.one_edit(names[i], x) for x in names]


def test_marks_are_learnt_and_dates_read(spark):
    rows = [(k, f"가나다라건강보험{k}(1011)(신상품,우대형)", "20101101") for k in range(40)]
    rows += [(100, "우대형 가나다라건강보험3(1011)신상품", "2010-11-1"), (101, "가나다라건강보험3(1011)", "2010년 11월 1일"), (102, "가나다라건강보험3", "2010"), (103, "가나다라건강보험3", "10-11-1")]
    df = spark.createDataFrame(rows, "id long, name string, sale_date string")
    assert N.usual_marks(df) == ["신상품", "우대형"]
    got = pairs(N.near_duplicate_names(df))
    assert {(3, 100), (3, 101), (100, 101)} <= got and not any(102 in p or 103 in p for p in got)
    assert [N.calendar_day(x) for x in ("2010.1.5", "２０１０/01/05", "20100105120000", None, "", "5.1.2010")] == ["20100105"] * 3 + [""] * 3


def test_short_runs_alike_by_chance_are_no_copy():
    rng = random.Random(3)
    stock = [noise(rng, 12) for _ in range(30)]
    one, two = ("".join(rng.choice(stock) for _ in range(60)) for _ in range(2))
    a, b = C.code_points(one), C.code_points(two)
    assert N.covered(a, b, N.RUN) > N.SHARE and N.covered(a, b, N.LONG_RUN) < N.LONG_SHARE


def test_sketch_keeps_all_that_is_asked_for(spark):
    rows, ids = spark.range(5000), spark.range(0, 5000, 7)
    got = {r.id for r in C.likely_in(rows, ids, "id").collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800
    assert C.likely_in(rows, ids.limit(0), "id").isEmpty()
