from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions.vectors import cosine
from docweave.operators import chunking as K
from docweave.operators import evaluation as E
from docweave.sources.files import table_markdown


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_article_and_section_headings(spark):
    head = lambda x: one(spark, T.article_heading(F.col("t")), t=x)
    assert tuple(head("### 제12조의2(지급(특칙))")) == ("12", "2", "지급(특칙)")
    assert tuple(head("제2-1조[목적]")) == ("2-1", None, "목적")
    assert head("제20조(변경 등) 제1항의 절차") is None
    part = lambda x: one(spark, T.section_heading(F.col("t")), t=x)
    assert tuple(part("## 제 2 관 보험금의 지급")) == ("관", "2", "보험금의 지급")
    assert part("제1관 목적 12") is None


def test_facts(spark):
    stated = lambda f, t: one(spark, T.fact_stated(F.col("f"), F.col("t")), f=f, t=t)
    assert stated("140mmHg 미만", "혈압은 140mmHg 미만으로 한다")
    assert not stated("140mmHg 미만", "혈압은 150mmHg 미만으로 한다")
    assert stated("회사", "보험 회사") and not stated("회사", "회 의 사")
    assert not stated("계약을 해지한 때", "보험금을 지급한다")


def test_lines_and_cells(spark):
    assert one(spark, T.lines_of(F.col("t")), t="a\r\nb c\n") == ["a", "b", "c"]
    assert one(spark, T.clean_text(F.col("t")), t=" a  b \t c  \n d 　") == "a b c\n d"
    assert one(spark, T.clean_cell(F.col("t")), t="a|b\n c") == "a\\|b<br>c"
    assert one(spark, T.file_stem(F.col("t")), t="/x/Y.Z.md") == "y.z"
    assert tuple(one(spark, T.line_span(F.col("t"), F.lit("c\nd")), t="a\nc\nd\ne")) == (2, 3)
    table = spark.createDataFrame([([["a", None, "b"], ["c", "", "d|e"], ["", "", ""]],), ([["a"], ["b"]],)], "c array<array<string>>")
    got = [r[0] for r in table.select(table_markdown(F.col("c"))).collect()]
    assert got[0].splitlines() == ["| a | b |", "| --- | --- |", "| c | d\\|e |"] and got[1] is None
    page = "제1관 목적\n제1조(목적)\n① 첫째\n② 둘째\n 12 \n\n㈜ 1. 항목\n● 표시\n3 / 9\n제3조(보상) 및 제4조에 따라\n\n- 7 -"
    assert one(spark, T.markdown_lines(F.col("t")), t=page) == ["## 제1관 목적", "", "### 제1조(목적)", "", "① 첫째", "", "② 둘째", "", "- ㈜ 1. 항목", "- 표시", "", "제3조(보상) 및 제4조에 따라"]
    assert one(spark, T.markdown_lines(F.col("t")), t="") == [] and one(spark, T.markdown_lines(F.col("t")), t="3\n\n4") == []


def test_items_of_a_range(spark):
    items = spark.createDataFrame([(["ab", "", "cde", "f"], 1, 3), (["ab", "", "cde", "f"], 2, 5), (["ab"], 5, 6), ([], 0, 1), (["", "a", ""], 0, 9)], "i array<string>, s int, e int")
    assert [r[0] for r in items.select(T.items_in_range(F.col("i"), F.col("s"), F.col("e"))).collect()] == [[0, 1, 2], [2], [], [], [1, 2]]


def test_name_key_and_cosine(spark):
    assert one(spark, T.name_key(F.col("t")), t="ＡＢ（１）") == "ab(1)"
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0


def test_packing(spark):
    assert [K.pack(x, 20) for x in ([10, 10, 1], [15, 30, 5, 15], [10, None, 15], [])] == [[1, 1, 2], [1, 2, 3, 3], [1, 1, 2], []]
    rows = [("d", k, "x" * n) for k, n in ((3, 5), (1, 15), (2, 30), (4, 15))] + [("e", 1, None)]
    got = {(r.stem, r.k): r.group_index for r in K.packed_groups(spark.createDataFrame(rows, "stem string, k long, text string"), "stem", "k", 20).collect()}
    assert got == {("d", 1): 1, ("d", 2): 2, ("d", 3): 3, ("d", 4): 3, ("e", 1): 1}


def test_pages_of_lines(spark):
    lines = ["a", "<!-- page: 3 -->", "b", "<!-- page: 3 -->", "<!-- page: 2 -->", "c"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines, 1)] + [("e", 1, "only")], "stem string, line_no int, line string")
    pages = K.line_pages(df, ["stem"])
    assert [r.page for r in pages.where("stem = 'd'").orderBy("line_no").collect()] == [1, 3, 3, 3, 2, 2]
    assert {(r.stem, r.page, r.first_line, r.n_pages) for r in K.page_starts(pages, ["stem"]).collect()} == {("d", 1, 1, 3), ("d", 3, 2, 3), ("d", 2, 5, 3), ("e", 1, 1, 1)}


POLICY = """표지
주계약 약관
제1관 목적 및 용어의 정의
### 제1조(목적)
본문 하나
---
<!-- page: 2 -->
### 제2조(정의)
본문 둘
제20조(변경 등) 제1항의 절차에 따라
암보장특약(무배
당) 약관
제1조(특약의 체결)
특약 본문
《가입형》
### 제2조(지급)
가
《비가입형》
### 제2조(지급)
나
부록 약관에서 인용된 법령 내용
- 의료법
제1조(목적)
법 본문
"""


def test_policy_chunks():
    chunks = list(K.PolicyFold(POLICY).chunks())
    assert chunks[0]["chunk_index"] == 0 and chunks[0]["text"].startswith("표지")
    got = {c["id"]: c for c in chunks[1:]}
    assert list(got) == ["0::제1조", "0::제2조", "1::제1조", "1::제2조@가입형", "1::제2조@비가입형", "2::제1조"]
    assert got["0::제1조"]["path"] == "주계약 > 제1관 목적 및 용어의 정의 > 제1조(목적)"
    assert got["0::제1조"]["text"] == "본문 하나"
    assert got["1::제1조"]["rider_name"] == "암보장특약(무배당)" and got["1::제1조"]["rider_name_source"] == "title"
    assert got["2::제1조"]["rider_type"] == "appendix" and got["2::제1조"]["section_label"] == "부록 > 의료법"
    assert got["1::제2조@비가입형"]["text"] == "나"


def test_policy_text_without_articles():
    assert [c["chunk_index"] for c in K.PolicyFold("").chunks()] == [0]


def test_product_contents():
    text = "상품 목차\n주계약\n가나종신보험(2601) 7\n특약\n암보장특약(갱신형,\n무배당) 31\n유첨\n별표 90"
    assert K.product_contents(text) == [("main", "가나종신보험(2601)"), ("rider", "암보장특약(갱신형,무배당)"), ("attachment", "별표")]
    assert K.product_contents("없음") == [] and K.product_contents("상품 목차\n특약\n암특약 3") == []


def test_product_contents_over_pages():
    lines = [
        "상품 목차", "안내", "상품 목차", "", "주계약", "가나보험(무배당) 1", "특약일반사항", "[특약약관]제1편일반사항 5", "특약 ※납입한 경우에만 적용합니다.", "다라특약C(무배당) 10", "---", "<!-- page: 37 -->", "",
        "마바사특약(상급", "병원,무배당) 462", "---", "아자특약(갱신형)", "※ 참고", "부록", "[부록]인용된법령내용 600", "---", "<!-- page: 38 -->", "주계약 약관", "차카특약 700",
    ]
    assert K.product_contents("\n".join(lines)) == [
        ("main", "가나보험(무배당)"), ("general", "[특약약관]제1편일반사항"), ("rider", "다라특약C(무배당)"), ("rider", "마바사특약(상급병원,무배당)"), ("rider", "아자특약(갱신형)"), ("appendix", "[부록]인용된법령내용"),
    ]
    # A name that is being read goes on over the page break.
    assert K.product_contents("상품 목차\n주계약\n가 1\n특약\n나특약(다\n---\n라) 9") == [("main", "가"), ("rider", "나특약(다라)")]


def test_titles_wrapped_guessed_and_contracts():
    text = "\n".join([
        "### 제1조(목적)", "가", "### 제2조(정의)", "나", "라마특약 안내", "(무배당)", "### 제1조(목적)", "다", "사아보험 2종 약관", "### 제1조(목적)", "라", "### 제3조(지급)", "마", "### 제1조(목적)", "바",
    ])
    got = [(c["rider_name"], c["rider_name_source"], c["rider_type"]) for c in K.PolicyFold(text).chunks() if c["chunk_index"]]
    assert got == [("주계약", "main", "main")] * 2 + [("라마특약 안내(무배당)", "guess", "rider")] + got[3:]
    assert [g[1] for g in got[3:]] == ["title", "title", "fallback"]


def test_contents_blocks_hold_no_articles():
    text = "상황별 목차\n제2조(정의)\n제3조(지급)\n암특약(무배당) 약관\n### 제1조(목적)\n가\n### 제2조(정의)\n나"
    assert [c["id"] for c in K.PolicyFold(text).chunks() if c["chunk_index"]] == ["0::제1조", "0::제2조"]


def test_chunking_scores(spark):
    toc = "상품 목차\n주계약\n가나보험 7\n특약\n암보장특약(무배당) 31\n없는특약 40\n---\n본문이 시작됩니다.\n"
    rows = [(1, toc + POLICY.replace("### 제2조(정의)", "### 제3조(정의)")), (2, POLICY), (3, None)]
    got = {r.doc_id: r.asDict() for r in K.chunking_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pick = lambda k, *names: tuple(got[k][n] for n in names)
    names = ("contents", "matched", "missing", "extra", "n_chunks", "n_sections", "n_appendix", "gaps", "duplicates", "heading_lines", "chunked", "missed")
    assert pick(1, *names) == (True, 1, 1, 0, 6, 2, 1, 1, 0, 6, 6, 0)
    assert pick(2, *names) == (False, None, None, None, 6, 2, 1, 0, 0, 6, 6, 0)
    assert pick(3, "contents", "n_chunks", "missed") == (False, 0, 0)


def test_article_sequence(spark):
    rows = [("d", 0, 1, "1", None, None, "main"), ("d", 0, 2, "3", None, None, "main"), ("d", 0, 3, "2", None, None, "main"), ("d", 0, 4, "2", None, None, "main"), ("d", 0, 5, "9", None, "가", "main")]
    df = spark.createDataFrame(rows, "stem string, section_index int, k int, article_no string, sub_no string, variant string, rider_type string")
    got = {r.k: (r.duplicate, r.regression, r.gap) for r in K.article_sequence(df, ["stem", "section_index"], "k").collect()}
    assert got == {1: (False, False, False), 2: (False, False, True), 3: (False, True, False), 4: (True, False, False), 5: (False, False, False)}


def test_evidence_span_prefers_recorded_lines(spark):
    df = spark.createDataFrame([("a\nsame\nb\nsame", "same", 4, 4), ("a\nsame\nb\nsame", "same", 3, 3), ("abc", "zz", 1, 1), ("ab", "b", -3, 99)], "t string, q string, s int, e int")
    got = [r[0] and tuple(r[0]) for r in df.select(E.evidence_span(F.col("t"), F.col("q"), F.col("s"), F.col("e"))).collect()]
    assert got == [(9, 13), (2, 6), None, (1, 2)]


def test_overlaps_over_bucket_borders(spark):
    a = spark.createDataFrame([("d", 1, 500, 1100), ("d", 2, 0, 10)], "stem string, a_id int, s long, e long")
    b = spark.createDataFrame([("d", 7, 600, 1200), ("d", 8, 5, 15), ("d", 9, 6, 16), ("x", 1, 0, 9)], "stem string, b_id int, s long, e long")
    got = sorted((r.a_id, r.b_id, r.shared) for r in E.overlap_pairs(a, b, ["stem"]).collect())
    assert got == [(1, 7, 500), (2, 8, 5)]


def test_renumbering_keeps_four_digits(spark):
    df = spark.createDataFrame([("d", k, f"Q {k}") for k in range(1, 1002)] + [("d", 2000, " q  1 ")], "stem string, k int, question string")
    got = {r.k: r.new_id for r in E.renumbered(df, ["stem"], "k").collect()}
    assert got[1] == "q001" and got[1001] == "q1001" and 2000 not in got


def test_cover_pages(spark):
    style = lambda *x: one(spark, T.cover_page(F.col("t")), t=list(x))
    assert style("", "LY0816002(260626)", "이름", "둘째 줄", "※ 설명", "더", "제 1 관 목적", "끝") == ["**보험코드:** LY0816002(260626)", "", "# 이름", "둘째 줄", "", "> ※ 설명", "> 더", "", "제 1 관 목적", "끝"]
    for lines in (["이름", "제1관 목적"], ["LY0816002", "제1관 목적"], ["LY0816002", "이름"], ["LY0816002", "※ 설명", "제1관"]):
        assert style(*lines) == lines


def test_compact_documents():
    text = "intro\n# A\n" + "a" * 50 + "\n## B\n" + "b" * 400
    got = K.compact_document(text, 150)
    assert len(got) <= 150 and got.startswith("intro\n\n# A\n") and "## B\n" in got and got.endswith(K.TRUNCATED)
    assert K.compact_document(text, 1000) == text and K.compact_document(text, 5) == "# A\n\n"
    assert K.compact_document(text, 150, 1) != got and "# A" in K.compact_document(text, 150, 1)
    with pytest.raises(ValueError):
        K.compact_document("x", 0)


def test_items_guard_and_report(spark):
    chunks = spark.createDataFrame([("a", 5, "two"), ("a", 3, "one")], "stem string, k long, text string")
    whole = spark.createDataFrame([("a", "whole"), ("b", "whole")], "stem string, text string")
    assert {tuple(r) for r in K.chunk_items(chunks, whole, "stem", "k").collect()} == {("a", 0, "one"), ("a", 1, "two"), ("b", 0, "whole")}
    with pytest.raises(Exception, match="text too long"):
        whole.select(T.length_guarded(F.col("text"), 3)).collect()
    scores = K.chunking_scores(spark.createDataFrame([(2, POLICY)], "doc_id long, text string"))
    r = K.chunking_report(scores).first()
    assert (r.sections, r.match, r.coverage) == ("2/?", "no-toc", "6/6")
