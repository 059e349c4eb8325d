from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docweave.llm import lookalikes as L
from docweave.llm import splitting as S


def cuttable(text, room, overlap):
    """Whether natural cuts alone keep every piece within the room: reachable cuts, tried one after the other."""
    ends = S.boundaries(text)[0].tolist()
    reached = [0 if len(text) <= room else None]
    reach = {0}
    if reached[0] == 0:
        return True
    for e in ends:
        if any((p == 0 and e <= room) or (p > 0 and e - (p - overlap) <= room) for p in reach):
            if e > overlap:
                reach.add(e)
    return any(p > 0 and len(text) - (p - overlap) <= room for p in reach)


@pytest.mark.parametrize("seed", range(40))
def test_pieces(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["가", "나다", "라마바 ", "3.5", "끝. ", "\n", "\n\n", "아" * rng.randrange(30)]) for _ in range(rng.randrange(1, 160)))
    room, overlap = rng.randrange(25, 90), rng.randrange(0, 12)
    spans, natural = S.pieces(text, room, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(e - s <= room for s, e in spans)
    assert all(b[0] == a[1] - overlap for a, b in zip(spans, spans[1:]))
    ends = set(S.boundaries(text)[0].tolist())
    assert natural == all(e in ends for _, e in spans[:-1])
    assert natural == cuttable(text, room, overlap)


def test_boundaries():
    at = lambda t: S.boundaries(t)[0].tolist()
    assert at("값은 3.5이다. 끝") == [9]
    assert at("가.나") == [2] and at("1.2.3") == [] and at("그는 \"예.\" 했다") == [7]
    assert dict(zip(*map(list, S.boundaries("a\n\nb\nc")))) == {3: S.PARAGRAPH, 5: S.LINE}


def test_strongest_cut_is_rightmost():
    import numpy as np

    best = S.StrongestCut(np.array([3, 5, 9, 12]), np.array([1, 3, 3, 2]))
    assert best.within(0, 20) == 9 and best.within(3, 5) == 5 and best.within(9, 12) == 12 and best.within(12, 20) is None
    assert S.StrongestCut(np.array([], dtype=int), np.array([], dtype=int)).within(0, 9) is None


def test_items(spark):
    rows = [(1, "p", "가" * 60), (2, "p", "나. " * 30), (3, None, "다" * 50), (4, "q" * 80, "라" * 60), (5, "p", None), (6, "p", ""), (7, "p", "마" * 46)]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("cut_kind", F.lit("clash"))
    assert {r.id: r.cut_kind for r in S.cut_kinds(df, 50, 10).collect()} == {1: "hard", 2: "natural", 4: "hard"}
    got = S.split_items(df, 50, 10).orderBy("id", "piece_no").collect()
    assert all(len(r.piece) <= 50 for r in got)
    assert all(r.piece.startswith("[p]\n") for r in got if r.id < 3)
    for i, text in ((1, "가" * 60), (2, "나. " * 30), (4, "라" * 60)):
        own = [r for r in got if r.id == i]
        whole = own[0].piece.removeprefix("[p]\n")
        for r in own[1:]:
            whole += r.piece.removeprefix("[p]\n")[10:]
        assert whole == text
    assert S.cut_kinds(df.limit(0)).isEmpty()


CASES = [
    ("회사는 보험금", "회사는 보험금", True), ("회사는 보험금", "회사는　 보험금", True), ("보험금", "보​험﻿금", True), ("보험금", unicodedata.normalize("NFD", "보험금"), True),
    ("Orléa 12%", "Ｏrlе́а １２％", True), ("CT 기준", "СТ 기준", True), ("CT 기준", "ϹΤ 기준", True), ("① 회사", "1 회사", False), ("① 회사", "(1) 회사", False), ("1. 가", "２. 가", False), ("가 나", "가나", False),
    ("줄\n바꿈", "줄 바꿈", True), ("a", "​", False), ("보험금", "보험금", False), ("m²", "m2", False), ("quote's", "quоtе's", True),
    ("사망·상해", "사망‧상해", True), ("사망·상해", "사망ㆍ상해", True), ("사망·상해", "사망・상해", True), ("사망·상해", "사망･상해", True), ("사망·상해", "사망.상해", False), ("1∼2", "1~2", True),
]


def test_quotes_found_again(spark):
    chunks = spark.createDataFrame([(k, f"앞 {t} 뒤") for k, (t, _, _) in enumerate(CASES)] + [(98, None), (99, "")], "chunk_id long, text string").withColumn("quote", F.lit("clash"))
    quotes = [("node", k, k, q) for k, (_, q, _) in enumerate(CASES)] + [("node", 90, 98, "x"), ("node", 91, 99, "x"), ("node", 92, 0, None), ("node", 93, 0, ""), ("node", 94, None, "앞"), ("node", 95, 777, "앞")]
    df = spark.createDataFrame(quotes + quotes, "rec_kind string, rec_id long, chunk_id long, quote string").withColumn("text", F.lit("clash"))
    got = {r.rec_id for r in L.found_only_alike(df, chunks).collect()}
    assert got == {k for k, (_, _, alike) in enumerate(CASES) if alike}
    assert L.found_only_alike(df.limit(0), chunks).isEmpty()


def test_consistent_text(spark):
    df = spark.createDataFrame([(1, "Ａ​Ｂ"), (2, None), (3, ""), (4, "가" * 100_000)], "id long, t string")
    got = {r.id: r.t for r in L.consistent_text(df, ["t"]).collect()}
    assert got == {1: "AB", 2: None, 3: "", 4: "가" * 100_000}
