"""Hand-computed cases for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.operators import aggregates as A
from inkstone.operators import positions as P
from inkstone.operators import ranking as RK
from inkstone.operators import retrieval as RT
from inkstone.operators import stability as ST
from inkstone.operators import text_ops as O


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("fn, given, want", [
    (X.strip_trailing_paren, "왜관도(국립 중앙 박물관 소장)", "왜관도"),
    (X.strip_trailing_paren, "유정(사명대사) 영정", "유정(사명대사) 영정"),
    (X.first_sentence, "가다. 나다.", "가다."),
    (X.first_sentence, "A. 가다. 끝", "A. 가다."),
    (X.first_sentence, ". no", ". no"),
    (X.first_sentence, "one. two", "one."),
    (X.surface_variants, "A B.", ["A B.", "AB.", "A B"]),
    (X.clean_lines, "﻿a \r\n\r\n\r\nb\t\n\n", "a\n\nb\n"),
    (X.clean_lines, "\n\n\nx", "\nx\n"),
    (X.normalize_title, " 지수 분포 (x) ", "지수_분포_x"),
    (X.normalize_title, "!!", "unnamed"),
    (X.topic_tokens, "조선은 퀴즈 a 무역을", ["조선은", "조선", "무역을", "무역"]),
    (X.strip_footer, "조운선 모형 134 V. 조선의 성립과 발전", "조운선 모형"),
    (X.page_markers, "<!-- page 3–4 -->a<!-- PageBreak -->b<!-- page 07-8 -->c<!-- PageBreak -->d", "[page3]a[page8]b[page7]c[page9]d"),
    (X.id_list, "['a', 'b']", ["a", "b"]),
    (X.id_list, None, []),
    (X.id_list, "x deadbeef-01 y", ["deadbeef-01"]),
    (lambda c: X.cited_numbers(c, "reports"), "[Data: Reports (1, 2, +more); Entities (5)]", [1, 2]),
    (lambda c: X.cited_numbers(c, "entities"), "[Data: Reports (1, 2, +more); Entities (5)]", [5]),
    (X.delimited_fields, '("entity"<|>"A B"<|> T <|>d)', ["entity", "A B", "T", "d"]),
    (X.clean_evidence, ". 본문 [Data: Entities (2)] . 중요도: 8.5. 끝", "본문. 끝"),
    (X.escape_html, "<a & \"b\">", "&lt;a &amp; \"b\"&gt;"),
])
def test_text(spark, fn, given, want):
    assert one(spark, fn, given) == want


@pytest.mark.parametrize("given, title", [
    ("태조 어진(전북 전주 경기전 소장)", "태조 어진"), ("4군과 6진", "4군과 6진"),
    ("교지 왕이 신하에게 벼슬, 시호, 토지 등을 내려 주는 문서이다.", ""), ("가 | 나", "가"), ("", "")])
def test_printed_caption(spark, given, title):
    r = one(spark, X.printed_caption, given)
    assert (r["title"], r["caption"]) == (title, given)


def test_joined_caption(spark):
    r = one(spark, X.joined_captions, "A(x) | 김 B | 이")
    assert [(x["title"], x["caption"]) for x in r] == [("A", "A(x) | 김"), ("B", "B | 이")]
    assert len(one(spark, X.joined_captions, "A | 김홍도")) == 1


def test_lenient_json(spark):
    r = one(spark, X.lenient_json, '```json\n{"caption_title": " a  b", "caption": "c"}\n```')
    assert (r["title"], r["caption"], r["parsed"]) == ("a b", "c", True)
    r = one(spark, X.lenient_json, "그냥 문장 {")
    assert (r["title"], r["caption"], r["parsed"]) == ("", "그냥 문장 {", False)


def test_pii(spark):
    r = one(spark, X.pii_scrub, "a 010-1234-5678 b")
    assert (r["text"], r["n"]) == ("a b", 1)
    assert one(spark, X.pii_flag, "1234 5678 9012 3456") is True
    assert one(spark, X.pii_scrub, "1234567890123")["n"] == 0  # the long-digit shape only flags


def test_lists(spark):
    r = spark.range(1).select(X.summarize_list(F.array(*[F.lit(str(i)) for i in range(12)])).alias("a"), X.summarize_list(F.array().cast("array<string>")).alias("b")).first()
    assert r["a"].endswith(" 외 2개") and r["b"] == "없음"


def test_paragraph_packing(spark):
    t = "a" * 6 + "\n\n" + "b" * 6 + "\n\n" + "c" * 30
    got = spark.createDataFrame([(t,)], "v string").select(X.chunk_paragraphs(F.col("v"), 16)).first()[0]
    assert "".join(got) == t and got == ["a" * 6 + "\n\n" + "b" * 6 + "\n\n", "c" * 30]


def test_body_caption(spark):
    md = "# h\n영조 어진 | 서울\n이어진 줄\n\n본문 | 김홍도\n<!-- PageBreak -->\n녹우단 | 전남 해남"
    rows = O.body_captions(spark.createDataFrame([(1, md)], "doc_id long, text string"), 3).orderBy("start").collect()
    assert [(r["page"], r["caption"]) for r in rows] == [(3, "영조 어진 | 서울 이어진 줄"), (4, "녹우단 | 전남 해남")]


def test_split_pages_last_body_wins(spark):
    d = spark.createDataFrame([(1, "pre[page1]\na[page2]\nb[page1]\nc")], "doc_id long, text string")
    assert {r["page"]: r["body"] for r in O.split_pages(d).collect()} == {1: "c", 2: "b"}


def test_chunk_spans(spark):
    d = spark.createDataFrame([(1, "xx abc", [(0, " abc"), (1, "zz")])], "doc_id long, text string, chunks array<struct<chunk_no:int,text:string>>")
    assert {r["chunk_no"]: (r["cs"], r["ce"]) for r in P.chunk_spans(d, F.col("chunks")).collect()} == {0: (3, 7), 1: (-1, -1)}


def test_mention_counts_sum_overlapping_variants(spark):
    d = spark.createDataFrame([(1, "X. X")], "doc_id long, text string")
    t = spark.createDataFrame([("X.",)], "title string")
    assert P.postings(d, t, 10, 0).first()["cnt"] == 3


@pytest.mark.parametrize("starts, want", [([0, 2, 4], [0, 0, 1, 1, 2, 2]), ([0, -1, 5], [1, 1, 1, 1, 1, 2]), ([3, 4, 9], [0, 0, 0, 0, 1, 1])])
def test_section_asof(spark, starts, want):
    s = spark.createDataFrame([(1, i, p) for i, p in enumerate(starts)], "doc_id long, idx int, start_offset int")
    p = spark.createDataFrame([(1, i) for i in range(6)], "doc_id long, pos int")
    assert [r["section"] for r in P.section_asof(p, s).orderBy("pos").collect()] == want


def test_span_overlap(spark):
    c = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 30)], "doc_id long, chunk_no int, cs int, ce int")
    s = spark.createDataFrame([(1, 0, 5, 20), (1, 1, 20, 9000)], "doc_id long, idx int, start_offset int, end_offset int")
    assert {(r["chunk_no"], r["section"]): r["overlap"] for r in P.span_overlap(c, s, slot=8).collect()} == {(0, 0): 5, (1, 1): 10}


def test_resolve_markers(spark):
    d = spark.createDataFrame([(1, "aa b aa c")], "doc_id long, text string")
    m = spark.createDataFrame([(1, 0, "x", "aa"), (1, 1, "y", "aa\n"), (1, 2, "z", "q"), (1, 3, "w", " c ")], "doc_id long, idx int, name string, start_marker string")
    rows = P.resolve_markers(m, d).orderBy("idx").collect()
    assert [(r["start_offset"], r["strategy"]) for r in rows] == [(0, "forced_zero"), (5, "exact"), (-1, "unresolved"), (8, "stripped")]
    flags = P.section_spans(P.resolve_markers(m, d), d).orderBy("idx").collect()
    assert [r["end_offset"] for r in flags] == [5, -1, 8, 9] and flags[0]["monotonic"] and flags[0]["distinct"]


def _votes(spark, runs):
    rows = [(r, 0, t, i, True) for r, kept in enumerate(runs) for i, t in enumerate(kept)]
    rows += [(r, 0, t, 90, False) for r, kept in enumerate(runs) for t in "abc" if t not in kept]
    return spark.createDataFrame(rows, "run int, room int, title string, ord long, keep boolean")


def test_majority(spark):
    got = {r["title"]: r["status"] for r in ST.majority_keep(_votes(spark, ["ab", "b", "bc"]), 3, 5).collect()}
    assert got == {"a": "demoted", "b": "kept", "c": "demoted"}


def test_jaccard_of_empty_sets(spark):
    v = _votes(spark, ["", ""])
    assert ST.pair_jaccard(v, 2, "one").first()["jaccard"] == 1.0
    assert ST.pair_jaccard(v, 2, "skip").count() == 0


def test_greedy_ties_go_to_larger_ids(spark):
    p = spark.createDataFrame([(0, 1, 0, 0, 0.5), (0, 1, 0, 1, 0.5), (0, 1, 1, 0, 0.5), (0, 1, 1, 1, 0.5)], "run_a int, run_b int, a int, b int, jaccard double")
    got = {(r["a"], r["b"]) for r in ST.greedy_match(p, ["run_a", "run_b"], "a", "b", "jaccard").collect()}
    assert got == {(1, 1), (0, 0)}


def test_unknown_price(spark):
    u = spark.createDataFrame([("j", "gpt-4.1", 1000000, 0), ("j", "nope", 5, 5)], "job string, model string, prompt_tokens long, completion_tokens long")
    assert A.usage_cost(u, "job", "zero").first()["cost"] == 2.0
    assert A.usage_cost(u, "job", "null").first()["cost"] is None


def test_unique_ids(spark):
    t = spark.createDataFrame([("x", 1, "a"), ("y", 2, "a"), ("z", 3, "a_2"), ("w", 4, "a")], "title string, seen long, base string")
    got = {r["title"]: r["uid"] for r in RK.unique_ids(t, "base", "seen", F.col("seen")).collect()}
    assert got == {"x": "a", "y": "a_2", "z": "a_2_2", "w": "a_3"}


def test_route(spark):
    q = spark.createDataFrame([("전체 비교", 1, 0.0, 0.0), ("전체", 1, 0.9, 0.0), ("전체", 0, 0.9, 0.0), ("x", 0, 0.0, 0.05), ("x", 0, 0.03, 0.0)], "q string, n int, l double, g double")
    got = [(r["mode"], r["confidence"]) for r in RT.route(q, "q", "n", "l", "g").collect()]
    assert got == [("local", "ambiguous"), ("global", "clear"), ("global", "clear"), ("global", "clear"), ("basic", "clear")]


def test_ids_are_padded_and_never_cut(spark):
    df = spark.createDataFrame([(7, 7), (10, 99), (100, 999_999), (101, 1_000_000), (1000, 12_345_678)], "section int, rank int")
    got = df.select(RK.padded(F.col("section"), 2).alias("s"), RK.padded(F.col("rank"), 6).alias("r")).collect()
    assert [r.s for r in got] == ["07", "10", "100", "101", "1000"]
    assert [r.r for r in got] == ["000007", "000099", "999999", "1000000", "12345678"]


def test_unknown_member_titles_count_nowhere(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    cites = table([(1, "reports", 5)], "q int, kind string, num long")
    ents = table([(1, "a", 3), (2, "b", 2)], "hr long, title string, degree int")
    members = table([(5, "a", 3), (5, "b", 2), (5, "ghost", 9)], "community long, title string, degree int")
    got = RT.provenance(cites, ["q"], ents, table([], "hr long, source string, target string"), table([], "hr long, title string"), table([(5, 5)], "hr long, community long"), members).collect()
    assert [(r.rank, r.title, r.entities_total) for r in sorted(got)] == [(1, "a", 2), (2, "b", 2)]


def test_placed(spark):
    from inkstone.operators import positions as P

    index = spark.createDataFrame([(1, "a", 0, 5, 2, 3, 0), (1, "a", 1, 40, 2, 3, 30), (1, "a", 2, 70, 1, 3, -1), (1, "b", 1, 30, 1, 30, 30)],
                                  "doc_id long, title string, chunk_no int, at int, cnt int, fine int, cs int")
    ents = spark.createDataFrame([(1, "a", 4), (1, "c", 1), (2, "d", 0)], "doc_id long, title string, degree int")
    secs = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 30), (1, 3, 20)], "doc_id long, idx int, start_offset int")
    got = {r["title"]: r for r in P.placed(index, ents, secs).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["n_text_units"], a["pos_first"], a["pos_mode"], a["pos_centroid"], a["pos_first_fine"], a["graph_degree"], a["section"]) == (3, 0, 0, 15.0, 3, 4, 0)
    assert (b["pos_mode"], b["section"], b["graph_degree"]) == (30, 3, 0)  # starts count by their running maximum
    assert (c["n_text_units"], c["pos_first"], c["pos_mode"], c["pos_first_fine"], c["fine_matched"], c["section"]) == (0, -1, -1, -1, False, None)
    occ = spark.createDataFrame([(1, "a", 0), (1, "c", 1), (2, "d", 0)], "doc_id long, title string, chunk_no int")
    spans = spark.createDataFrame([(1, 0, 0, 25), (1, 1, 25, 60)], "doc_id long, chunk_no int, cs int, ce int")
    ends = secs.where("idx < 3").selectExpr("*", "CASE idx WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 60 END AS end_offset")
    rows = {r["title"]: (r["section"], r["method"], r["ratio"]) for r in P.assign_sections(P.placed(index, ents, secs), lambda: (occ, spans, ends)).collect()}
    assert rows == {"a": (0, "fine_pos", 1.0), "b": (3, "fine_pos", 1.0), "c": (2, "chunk_overlap", 0.8571), "d": (0, "chunk_overlap", 0.0)}
