"""Contents, headings, sections, blocks, forms and the whole build, on small documents."""

import random

import pytest
from pyspark.sql import functions as F

from leafquire.functions import patterns as P
from leafquire.operators import blocks, checks, forms, layout
from leafquire.plans import jobs
from leafquire.sources.tables import SCHEMAS

LINES, PROFILES = SCHEMAS["lines"], SCHEMAS["profiles"]


def line_table(spark, rows):
    """Rows of (page, y0, text) or (page, y0, text, size, bold)."""
    full = [("d", r[0], i, r[2], float(r[3]) if len(r) > 3 else 10.0, bool(r[4]) if len(r) > 4 else False, 72.0, float(r[1]), 842.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LINES)


def profile(spark, **more):
    base = {"doc_id": "d", "short_title": "M", "page_offset": 0, "page_count": 9, "toc_pdf_pages": [1], "body_size": 10.0,
            "level_rules": [{"pattern": p, "level": n} for p, n in P.LEVELS["chapter"]], "alias_map": dict(P.ALIASES), "form_ranges": []}
    return spark.createDataFrame([{**base, **more}], PROFILES)


def test_body_and_footer(spark):
    rows = line_table(spark, [(1, 30, "head"), (1, 100, "text"), (1, 200, "  "), (1, 778, "/ 12 /"), (1, 779, "12 pages"), (1, 800, "13")])
    assert [r.text for r in layout.body_lines(rows).orderBy("line_no").collect()] == ["text", "12 pages"]
    assert layout.footer_lines(rows).count() == 3
    assert [(r.n_equal, r.n_other) for r in checks.page_numbers(rows, profile(spark, page_offset=-12)).collect()] == [(1, 1)]


def test_contents(spark):
    rows = line_table(spark, [(1, 80, "목 차"), (1, 90, "제1장 총"), (1, 100, "칙 ··· 3"), (1, 110, "1. 목적 ·· 4 2. 정의 ·· 5"), (1, 120, "····"), (1, 130, "● 안내 ·· 6"), (1, 140, "[표 1] 가 ··· 7"), (2, 90, "x ··· 9")])
    got = [(r.ord, r.title, r.level, r.page_printed, r.numbered, r.kind) for r in layout.contents_entries(rows, profile(spark)).orderBy("ord").collect()]
    assert got == [(0, "제1장 총 칙", 1, 3, True, "section"), (1, "1. 목적", 2, 4, True, "section"), (2, "2. 정의", 2, 5, True, "section"), (3, "[표 1] 가", 0, 7, True, "caption")]


def test_pinning(spark):
    rows = line_table(spark, [
        (3, 100, "제1장", 14), (3, 120, "총칙규정", 14), (4, 100, "제2절의범위확장판본", 14), (5, 90, "연구개발비 사용기준표", 14), (5, 130, "본문입니다", 10), (6, 100, "ABCDEFGHIJKLMN", 10, True)])
    e = [("d", 0, "제1장 총칙규정", 1, 3, True, "section"), ("d", 1, "연구개발비 사용 기준", 1, 4, True, "section"), ("d", 2, "연구개빌비 사용긔준표", 1, 5, True, "section"), ("d", 3, "없는제목입니다", 1, 8, True, "section"), ("d", 4, "ABCDEFGHIJ", 1, 6, True, "section")]
    entries = spark.createDataFrame(e, SCHEMAS["toc_entries"])
    got = {r.ord: (r.page_pdf, r.y0, r.method) for r in layout.pin_headings(entries, rows, profile(spark)).collect()}
    assert got == {0: (3, 100.0, "exact"), 1: (5, 90.0, "prefix"), 2: (5, 90.0, "fuzzy"), 3: (8, 0.0, "none"), 4: (6, 100.0, "prefix")}


def heading_table(spark, rows):
    return spark.createDataFrame([("d", i, t, lv, p, float(y), "exact") for i, (t, lv, p, y) in enumerate(rows)], SCHEMAS["headings"])


def test_paths(spark):
    h = heading_table(spark, [(t, lv, 1, i) for i, (t, lv) in enumerate(zip("ABCDEF", (1, 2, 3, 2, 1, 3)))])
    assert [r.level_path for r in layout.level_paths(h).orderBy("ord").collect()] == [list(x) for x in ("A", "AB", "ABC", "AD", "E", "EF")]


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_paths_equal_a_stack(spark, coalesced):
    """Any levels, and one document over many tasks."""
    rng = random.Random(8)
    docs = {f"d{k}": [rng.randint(0, 9) for _ in range(rng.randint(1, 25))] for k in range(40)}
    docs["d5"] = [rng.choice([0, 7, 8, 9, 40, -3]) if rng.random() < 0.02 else rng.randint(9, 60) for _ in range(3000)]
    docs["d6"] = list(range(500)) + [None, 2]
    h = spark.createDataFrame([(d, i, None if i == 4 else f"t{i}", lv, 1, float(i), "exact") for d, ls in docs.items() for i, lv in enumerate(ls)], SCHEMAS["headings"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        found = layout.level_paths(h.repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r.doc_id, r.ord): r.level_path for r in found}
    assert len(found) == len(got) == sum(map(len, docs.values()))
    for d, ls in docs.items():
        stack = []
        for i, lv in enumerate(ls):
            lv = 1 if lv is None else lv
            while stack and stack[-1][0] >= lv:
                stack.pop()
            stack.append((lv, None if i == 4 else f"t{i}"))
            assert got[d, i] == [t for _, t in stack if t is not None]


def test_open_headings_compose():
    rng = random.Random(2)
    for _ in range(300):
        runs = [[rng.randint(0, 6) for _ in range(rng.randint(1, 5))] for _ in range(3)]
        sums = []
        for r in runs:
            stack = []
            for i, lv in enumerate(r):
                layout.grown(stack, lv, f"{lv}{i}")
            sums.append((min(r), stack))
        whole = []
        for r in runs:
            for i, lv in enumerate(r):
                layout.grown(whole, lv, f"{lv}{i}")
        (_, a), (lb, b), (lc, c) = sums
        assert layout.joined(layout.joined(a, lb, b), lc, c) == layout.joined(a, min(lb, lc), layout.joined(b, lc, c)) == whole


def test_paths_of_nothing(spark):
    assert layout.level_paths(heading_table(spark, [])).columns[-1] == "level_path" and layout.level_paths(heading_table(spark, [])).count() == 0


def test_dead_zone_and_spans(spark):
    h = heading_table(spark, [("A", 1, 2, 100), ("B", 1, 3, 50), ("F", 1, 5, 10)])
    spans = layout.section_spans(h, profile(spark, form_ranges=[{"lo": 5, "hi": 6}]))
    assert [(r.section_id, r.end_page) for r in spans.orderBy("place").collect()] == [("d-s000", 3), ("d-s001", 5), (None, 9)]
    rows = line_table(spark, [(2, 99.5, "a"), (2, 100.4, "b"), (2, 101, "c"), (1, 500, "front"), (3, 49, "d"), (3, 49.5, "e"), (3, 51, "f"), (5, 9, "g"), (5, 400, "h")])
    got = {r.text: r.place for r in layout.assign(rows, spans).collect()}
    assert got == {"c": 1, "front": 0, "d": 1, "f": 2, "g": 2, "h": 3}


def test_packing(spark):
    sizes = spark.createDataFrame([([300, 300, 200, 900, 10],), ([],), ([900],)], "s array<int>")
    assert [r.g for r in sizes.select(blocks.greedy(F.col("s"), 700).alias("g")).collect()] == [[0, 0, 1, 2, 3], [], [0]]
    rng = random.Random(1)
    rows = line_table(spark, [(1 + i // 40, i, rng.choice([" ", "x" * rng.randint(1, 400)])) for i in range(300)]).withColumn("place", F.lit(1))
    packed = blocks.pack_lines(rows, ["doc_id", "place"], ["line_no"]).orderBy("run").collect()
    want = [r.text.strip() for r in rows.orderBy("line_no").collect()]
    assert [t for t in "\n".join(r.text for r in packed).split("\n") if t] == [t for t in want if t]
    assert all(len(r.text.replace("\n", "")) <= 700 for r in packed)


def test_merged_cells(spark):
    cells = [(1, 0, 0, "x"), (1, 0, 1, "1"), (1, 1, 0, ""), (1, 1, 1, "2"), (1, 2, 0, ""), (1, 2, 1, ""), (2, 0, 1, "a"), (2, 2, 1, "")]
    df = spark.createDataFrame(cells, "table_id int, r int, c int, value string")
    got = {(r.table_id, r.r, r.c): r.value for r in blocks.fill_merged(df).collect()}
    assert [got[1, r, c] for r in range(3) for c in range(2)] == ["x", "1", "x", "2", "x", "2"]
    assert got[2, 2, 1] == ""  # the short row between breaks the chain


def table_of(spark, rows, no=0, page=2, top=200.0):
    return spark.createDataFrame([("d", page, no, (72.0, top, 500.0, top + 60), rows)], "doc_id string, page_pdf int, table_no int, bbox struct<x0:double,y0:double,x1:double,y1:double>, rows array<array<string>>")


@pytest.mark.parametrize("rows, kind", [
    ([["a", "b"], ["c", "d"]], "table"), ([["a = b"], ["c"]], "formula"), ([["a", "b"], [None, " "]], None), ([["abcdefgh", ""], ["a", "b"]], None), ([["a", "", ""], ["", "", "b"]], None)])
def test_gates(spark, rows, kind):
    assert [r.kind for r in blocks.gate_tables(table_of(spark, rows)).collect()] == ([kind] if kind else [])


def test_long_tables_split(spark):
    rows = [["h", "i"]] + [["x" * 200, str(i)] for i in range(20)]
    t = table_of(spark, rows).withColumn("kind", F.lit("table")).withColumn("residual", F.array(F.lit("lost")))
    parts = blocks.table_parts(t).orderBy("part").collect()
    assert len(parts) == 3 and all(p.text.startswith("| h | i |\n|---|---|\n| x") for p in parts)
    assert sum(p.text.count("\n| x") for p in parts) == 20 and not any("lost" in p.text for p in parts)


def test_lead_in(spark):
    rows = line_table(spark, [(2, 150, "y" * 40), (2, 180, "<표 1> 제목"), (2, 210, "inside cell"), (2, 230, "left over"), (2, 300, "after")])
    t = blocks.gate_tables(table_of(spark, [["inside cell", "b"], ["c", "dddddddddd"]]))
    t = blocks.residual_lines(blocks.table_captions(t, rows), rows).withColumn("place", F.lit(1))
    kept = blocks.lines_outside(rows.withColumn("place", F.lit(1)), t)
    got = [(r.number, r.content_type, r.text) for r in blocks.emit(kept, t).orderBy("number").collect()]
    assert got == [(0, "table", "<표 1> 제목\n" + "y" * 40 + "\n| inside cell | b |\n|---|---|\n| c | dddddddddd |\n\nleft over"), (1, "text", "after")]


def test_forms(spark):
    rows = line_table(spark, [(3, 80, "7"), (3, 100, "<부록 2> 서식", 20), (3, 120, "모음(3종)", 20), (3, 200, "제 1 호 신청서 ··· 10"), (3, 220, "제2호 보고서 ···· 15"), (3, 240, "제3호 삭제 ··· 15"), (3, 260, "제4호 확인서 ··· 15"), (8, 100, "<부록 3> 끝", 20)])
    p = profile(spark, page_offset=-12, form_ranges=[{"lo": 15, "hi": 40}])
    found = forms.catalog(rows, p)
    assert [(r.form_no, r.name, r.page_start, r.page_end, r.appendix_title) for r in found.orderBy("form_order").collect()] == [
        ("제1호", "신청서", 10, 14, "서식 모음(3종)"), ("제2호", "보고서", 15, 15, "서식 모음(3종)"), ("제4호", "확인서", 15, 19, "서식 모음(3종)")]
    assert [(r.n_forms, r.declared, r.agrees) for r in forms.against_declared(found).collect()] == [(3, 3, True)]
    chunk = forms.form_chunks(found, p).orderBy("chunk_id").first()
    assert (chunk.chunk_id, chunk.text, chunk.caption) == ("d-forms-c000", "서식명: 신청서\n근거: 서식 모음(3종) 제1호\n수록 위치: 본권 인쇄 p10~14", "신청서")


def test_build(spark):
    rows = line_table(spark, [
        (1, 100, "제1장 총칙규정 ··· 2"), (1, 120, "1. 목적과정의 ··· 3"), (2, 90, "앞머리 글"), (2, 100, "제1장 총칙규정", 14), (2, 130, "혁신법 제3조에 따른다"),
        (3, 100, "1. 목적과정의", 14), (3, 130, "본문 둘째"), (3, 180, "표 제목", 10, True), (3, 205, "b"), (4, 100, "끝 줄")])
    tables = table_of(spark, [["b", "가나"], ["다라", "마"]], page=3, top=200.0)
    made = jobs.build(rows, profile(spark, page_count=4), tables)
    chunks = {r.chunk_id: r for r in made["chunks"].collect()}
    assert {k: v.text for k, v in chunks.items()} == {
        "d-front-c00": "앞머리 글", "d-s001-c00": "혁신법 제3조에 따른다", "d-s002-c00": "표 제목\n본문 둘째\n| b | 가나 |\n|---|---|\n| 다라 | 마 |", "d-s002-c01": "끝 줄"}
    assert chunks["d-s002-c01"].text_for_embedding == "[M] 제1장 총칙규정 > 1. 목적과정의\n끝 줄"
    assert {r.section_id: (r.page_pdf_start, r.page_pdf_end) for r in made["sections"].collect()} == {"d-front": (1, 2), "d-s001": (2, 3), "d-s002": (3, 4)}
    assert [(r.chunk_id, r.law, r.target) for r in made["refs"].collect()] == [("d-s001-c00", "국가연구개발혁신법", "제3조")]
    assert checks.dangling(made["chunks"], made["sections"], made["refs"]).count() == 0
    share = checks.coverage(rows, profile(spark, page_count=4), made["chunks"], made["headings"]).first()
    assert share is None or share.share == 1.0
