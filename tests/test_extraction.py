"""Metadata, tables, evidence and evaluation operators on fixtures of the domain (fixed values)."""

import random

import pytest
from pyspark.sql import functions as F

from reportloom.functions import scalars as S
from reportloom.operators import analytics as A
from reportloom.operators import evidence as E
from reportloom.operators import export as X
from reportloom.operators import legacy as L
from reportloom.operators import metadata as M
from reportloom.operators import ranking as R
from reportloom.operators import tables as T
from reportloom.operators import textops as TX
from reportloom.operators import warehouse as W
from reportloom.sources import files, requests
from reportloom.streaming import ingest

ONE = """ỦY BAN NHÂN DÂN
HUYỆN LONG THÀNH | CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM
Số: 12/BC-UBND
Long Thành, ngày 5 tháng 2 năm 2026
BÁO CÁO
Tình hình giải ngân vốn đầu tư
tháng 2 năm 2026.
Kính gửi: UBND tỉnh"""
TWO = "Kèm theo số liệu\nThu ngân sách đạt 5 tỷ đồng"
THREE = """Nơi nhận:
- UBND tỉnh;
- Lưu: VT;
- UBND tỉnh;
Hết
TM. ỦY BAN NHÂN DÂN
KT. CHỦ TỊCH
PHÓ CHỦ TỊCH
Nguyễn Văn An"""


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_metadata(spark):
    rows = [
        (1, 1, ONE, 0), (1, 2, TWO, 1), (1, 3, THREE, 0), (1, 4, "Biểu kèm theo", 1),
        (2, 1, "PHỤ LỤC I\nBiểu tổng hợp\nnăm 2026\ndòng bốn\nTT", 1),
        (3, 1, "SỞ Y TẾ\nV/v tăng cường phòng dịch\ntrên địa bàn|x", None),
        (4, 1, None, None), (5, 1, "không có gì", 0),
    ]
    got = {r.doc_id: r for r in M.document_metadata(spark.createDataFrame(rows, "doc_id int, page int, text string, n_tables int")).collect()}
    a = got[1]
    assert a.document_title == "BÁO CÁO Tình hình giải ngân vốn đầu tư tháng 2 năm 2026." and a.issuing_authority == "ỦY BAN NHÂN DÂN HUYỆN LONG THÀNH  CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"
    assert (a.document_type, a.document_number, a.issuance_date) == ("BAO_CAO", "12/BC-UBND", "2026-02-05")
    assert a.recipients == ["UBND tỉnh", "Lưu: VT"] and a.receiving_authority == "UBND tỉnh"
    assert a.signer.name == "Nguyễn Văn An" and a.signer.title == "TM. ỦY BAN NHÂN DÂN\nKT. CHỦ TỊCH\nPHÓ CHỦ TỊCH"
    assert a.has_appendix and not a.is_pure_table
    assert got[2].document_title == "PHỤ LỤC I - Biểu tổng hợp - năm 2026" and got[2].document_type == "PHU_LUC" and got[2].is_pure_table
    assert got[3].document_title == "Công văn: tăng cường phòng dịch trên địa bàn" and got[3].issuing_authority == "SỞ Y TẾ"
    for i in (4, 5):
        assert got[i].document_title == M.DEFAULT_TITLE and got[i].issuing_authority == M.DEFAULT_AUTHORITY and got[i].receiving_authority == M.DEFAULT_RECEIVER and got[i].recipients == [M.DEFAULT_RECIPIENT]
    assert M.document_metadata(spark.createDataFrame([], "doc_id int, page int, text string, n_tables int")).count() == 0
    assert one(spark, M.pure_tabular(F.lit("BAO_CAO"), F.lit(False), F.lit(" Phụ lục 1"), F.lit(None).cast("string")))
    assert not one(spark, M.pure_tabular(F.lit("BAO_CAO"), F.lit(None).cast("boolean"), F.lit("x"), F.lit("y")))


GOOD = (["STT", "Chỉ tiêu", "Kế hoạch", "Thực hiện"], [["1", "Thu ngân sách", "100", "50"], ["2", "Chi ngân sách", "80", "60"]])
TABLES = [
    (GOOD, None),
    ((["A"], [["x"]]), "SHAPE"),
    ((["ỦY BAN NHÂN DÂN", "CỘNG HÒA XÃ HỘI"], [["Số: 1", "ĐỘC LẬP - TỰ DO"]]), "LETTERHEAD"),
    ((["BÁO CÁO", "tháng 2 năm"], [["về việc gì đó", "dài"]]), "HEADING_OR_SIGN_OFF"),
    ((["a", "b"], [["1", "2"], ["3", "4"]]), "TOO_LITTLE"),
    ((["STT", "Nội dung dài", "", ""], [["1", "dòng một có chữ", "", ""], ["2", "dòng hai có chữ", "", ""]]), "EMPTY_COLUMNS"),
    ((["STT", "Nội dung"], [["- một hai ba", "bốn năm sáu"], ["- bảy", "tám chín mười"]]), "BULLETS"),
    ((["Theo " + "văn bản " * 8, "cột hai"], [["a b c", "d e f"], ["g h i", "k l m"]]), "PROSE_HEADER"),
    ((["Tên đơn vị", "Địa chỉ"], [["Phòng A", "Số nhà"]]), "TWO_ROWS"),
    ((["Tên", "Số"], [["Phòng Kế toán", "12"]]), "TWO_ROWS"),
    ((["Tên", "Số", "Năm"], [["Phòng Kế toán", "12", "2026"]]), None),
    ((["văn bản rất dài " * 4, "x"], [["chữ " * 30, ""], ["chữ " * 30, ""], ["chữ " * 30, ""]]), "ONE_COLUMN"),
    ((["Nội dung rất dài", "x"], [["chữ " * 30, "y"], ["chữ " * 30, "z"], ["chữ " * 30, ""]]), "DOMINATED"),
]
RAW = "doc_id int, ord int, table_id string, table_title string, headers array<string>, rows array<array<string>>, page_ref int"


def test_valid_tables(spark):
    rows = [(1, i, None, "Bảng A" if i == 0 else None, h, r, 0) for i, ((h, r), _) in enumerate(TABLES)]
    df = spark.createDataFrame(rows, RAW)
    got = {r.ord: r.why for r in df.select("ord", T.reject_reason(F.col("headers"), F.col("rows")).alias("why")).collect()}
    assert got == {i: why for i, (_, why) in enumerate(TABLES)}
    kept = T.valid_tables(df).orderBy("n").collect()
    assert [(r.table_id, r.table_title, r.row_count, r.col_count, r.page_ref) for r in kept] == [("tbl-1", "Bảng A", 2, 4, 1), ("tbl-2", "Bảng số liệu #2", 1, 3, 1)]
    assert one(spark, T.reject_reason(F.lit(None).cast("array<string>"), F.lit(None).cast("array<array<string>>"))) == "SHAPE"


def test_process_and_summary(spark):
    h = ["Nội dung", "Kế hoạch giao", "Ước thực hiện", "Tỷ lệ %"]
    r = [["Mục A", "100", "50", "90"], ["Mục B", "200", "100", "50"], ["Tổng  cộng", "900", "150", "50"], ["Ước thực hiện năm", "", "170", ""], ["Tổng  cộng", "900", "150", "50"]]
    df = spark.createDataFrame([(1, 0, "t", "Biểu 1", h, r, None)], RAW)
    done = T.process_tables(df).first()
    assert done.rows[2][0] == "Tổng cộng" and (done.row_count, done.col_count) == (5, 4) and done.markdown.startswith("| Nội dung | Kế hoạch giao |")
    kinds = {x.finding for x in done.findings}
    assert "PERCENTAGE_MISMATCH" in kinds and "SUM_MISMATCH" in kinds
    m = T.summary_metrics(df).orderBy("row_index").collect()
    assert [(x.indicator, x.actual, x.plan_target, x.percentage, x.data_nature) for x in m] == [("Biểu 1: Tổng  cộng", "150", "900", "50", "THUC_HIEN_THUC_TE"), ("Biểu 1: Ước thực hiện năm", "170", None, None, "UOC_THUC_HIEN")]
    assert one(spark, T.percent_finding(F.lit(100.0), F.lit(-5.0), F.lit(50.0))) is None and one(spark, T.percent_finding(F.lit(100.0), F.lit(0.0), F.lit(50.0))) == 0.0
    assert one(spark, S.header_similar(F.array(F.lit("Tên đơn vị")), F.array(F.lit("tên")))) is False and one(spark, S.header_similar(F.array(F.lit("tên")), F.array(F.lit("Tên đơn vị")))) is True


def test_table_kinds(spark):
    arr = lambda *r: F.array(*[F.array(*[F.lit(c) for c in x]) for x in r])
    assert one(spark, T.layout_table(arr(["UBND", "Cộng hòa xã hội"], ["Số", "Độc lập - Tự do"]))) == "HEADER"
    assert one(spark, T.layout_table(arr(["Nơi nhận:", "TM. UBND"]))) == "SIGNATURE" and one(spark, T.layout_table(arr(["a", "b"]))) is None
    assert one(spark, T.table_kind(F.array(F.lit("Người ký"), F.lit("Thời gian")), arr(["a", "b"]))) == "SIGNATURE"
    assert one(spark, T.table_kind(F.array(F.lit("Tên"), F.lit("Số")), arr(["a", "b"]))) == "BUSINESS" and one(spark, T.table_kind(F.array(F.lit("Tên")), arr(["a"]))) is None
    row = one(spark, T.signature_row(F.array(*[F.lit(x) for x in ("1", "Công ty  A", "", "05/02/2026 lúc 10:20:30", "")])))
    assert (row.unit, row.time, row.verdict) == ("Đơn vị ban hành văn bản", "05/02/2026 10:20:30", "✅ Đã đóng dấu & ban hành")
    assert one(spark, T.signature_row(F.array(F.lit("1"), F.lit(""), F.lit("")))) is None
    lines = T.layout_paragraphs(spark.createDataFrame([(1, 0, [["Nơi nhận:\n- A", "TM. UBND\n\nB"]]), (1, 1, [["a", "b"]])], "doc_id int, ord int, rows array<array<string>>")).orderBy("line_no").collect()
    assert [r.text for r in lines] == ["Nơi nhận:", "- A", "TM. UBND", "B"]


def test_stitching(spark):
    tabs = [
        (1, 0, 1, ["STT", "Tên", "Số"], [["1", "a", "5"], ["", "", ""]]),
        (1, 1, 2, ["stt", "tên", "số"], [["2", "b", "6"], ["", "b2", "7"]]),  # repeats the header
        (1, 2, 3, ["", "b3", ""], [["3", "c", "8"]]),  # flows into the row before
        (1, 3, 3, ["Tên", "Y", "Z"], [["q", "r", "s"]]),  # another table
        (1, 4, 4, ["4", "d", "9"], []),  # continues that one, not the first
        (2, 0, 1, ["A"], []),
    ]
    got = TX.stitch_tables(spark.createDataFrame(tabs, "doc_id int, ord int, page int, headers array<string>, rows array<array<string>>")).orderBy("doc_id", "master").collect()
    assert [(r.headers, r.rows, r.pages, r.pieces) for r in got] == [
        (["STT", "Tên", "Số"], [["1", "a", "5"], ["2", "b b2 b3", "6; 7"], ["3", "c", "8"]], [1, 2, 3], 3),
        (["Tên", "Y", "Z"], [["q", "r", "s"], ["4", "d", "9"]], [3, 4], 2),
        (["A"], [], [1], 1),
    ]


def test_text_filters(spark):
    text = "Dự thảo\nBản mật\u00ad này là văn bản dài hơn hai mươi lăm\n[Bảng: X]\na | b | c\nmột | hai\n\n  Nội\u00a0dung  "
    assert one(spark, TX.without_marks(F.lit(text))) == text.replace("Dự thảo\n", "").replace("\u00ad", "").replace("\u00a0", " ")
    assert one(spark, TX.body_lines(F.lit(text))) == ["Bản mật này là văn bản dài hơn hai mươi lăm", "một | hai", "Nội dung"]
    docs = spark.createDataFrame([(1, "Tổng số hộ dân là 500 hộ\nDiện tích khoảng 20 ha\nx\nDân số có 9 người\nRừng có 8 ha"), (2, "Thu ngân sách: 5 tỷ đồng"), (3, None)], "doc_id int, text string")
    found = TX.fallback_metrics(docs, TX.metrics(docs)).orderBy("n").collect()
    assert [(r.doc_id, r.indicator, r.actual, r.unit) for r in found] == [(1, "Tổng số hộ dân", "500", "hộ"), (1, "Diện tích", "20", "ha"), (1, "Dân số", "9", "người")]
    recs = TX.recommendations(spark.createDataFrame([(1, "Đề nghị tỉnh bố trí vốn kịp thời."), (2, "x")], "doc_id int, text string"))
    asked = {r.doc_id: r for r in TX.decisions_needed(docs, recs).collect()}
    assert asked[1].decision_summary == "Xem xét phê duyệt kiến nghị: Đề nghị tỉnh bố trí vốn kịp thời." and asked[1].is_required and not asked[3].is_required and asked[3].deadline is None
    acts = TX.actions_or_default(docs, docs.select("doc_id", F.lit("T").alias("document_title"))).collect()
    assert sorted((r.doc_id, r.provenance) for r in acts) == [(1, "SYNTHETIC"), (2, "SYNTHETIC"), (3, "SYNTHETIC")]


def test_evidence(spark):
    snippets = spark.createDataFrame([(1, 1, 1, "Thu ngân sách đạt khá cao"), (1, 2, 1, "tăng trưởng kinh tế vùng"), (1, 3, 1, "không thấy đâu cả"), (1, 4, 2, "x")], "doc_id int, sid int, page int, snippet string")
    box = lambda y: [0.0, y, 10.0, y + 5]
    blocks = spark.createDataFrame([(1, 1, 0, "b0", "mở đầu", box(0.0)), (1, 1, 1, "b1", "Phần thu ngân sách đạt khá cao năm", box(9.0)), (1, 1, 2, None, "kinh tế có tăng trưởng", box(20.0))], "doc_id int, page int, ord int, block_id string, text string, box array<double>")
    got = {r.sid: (r.evidence_ref, r.provenance, r.box) for r in E.locate_blocks(snippets, blocks).collect()}
    assert got == {1: ("b1", "PHYSICAL", box(9.0)), 2: ("p1_b1", "PHYSICAL", box(20.0)), 3: ("b0", "SYNTHETIC", box(0.0)), 4: ("p2_b1", "FALLBACK", E.DEFAULT_BOX)}
    words = [(1, 1, 0, "Số:", 10.0, 100.0, 25.0, 110.0), (1, 1, 1, "/BC-UBND", 60.0, 100.0, 90.0, 110.0), (1, 1, 2, "34", 45.0, 101.0, 55.0, 111.0), (1, 1, 3, "12", 30.0, 101.0, 40.0, 111.0), (1, 1, 4, "far", 30.0, 300.0, 40.0, 310.0),
             (1, 1, 5, "ngày", 10.0, 200.0, 30.0, 210.0), (1, 1, 6, "tháng", 60.0, 200.0, 80.0, 210.0), (1, 1, 7, "7", 40.0, 203.0, 45.0, 213.0)]
    w = spark.createDataFrame(words, "doc_id int, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(1, 1, 0, "Số:      /BC-UBND", 5.0, 98.0, 95.0, 112.0), (1, 1, 1, "Hà Nội, ngày   tháng 2", 5.0, 198.0, 95.0, 212.0)], "doc_id int, page int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")
    g = E.gap_words(w, b).join(b, ["doc_id", "page", "block_no"]).select("block_no", "filling", "word_nos", E.filled_text(F.col("text"), F.col("gap"), F.col("filling")).alias("t")).orderBy("block_no").collect()
    assert [(r.filling, r.word_nos, r.t) for r in g] == [("12 34", [3, 2], "Số: 12 34/BC-UBND"), ("7", [7], "Hà Nội, ngày 7 tháng 2")]
    assert sorted((r.block_no, r.word_no) for r in E.words_in_blocks(w, b).collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 5), (1, 6), (1, 7)]
    marks = F.array(F.lit("BẢN NHÁP"), F.lit(" "))
    assert one(spark, E.is_watermark(F.lit(" bản nháp "), marks)) and one(spark, E.is_watermark(F.lit("đây là bản nháp số 2"), marks)) and not one(spark, E.is_watermark(F.lit("bản nháp " + "x" * 50), marks))
    assert one(spark, E.mark_words(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a")))) == ["a", "b"]
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, "")], "doc_id int, page int, text string")
    ev = E.evidence(pages, spark.createDataFrame([(1, 1, 0, "paragraph", "abc")], "doc_id int, page int, ord int, kind string, text string"), spark.createDataFrame([(1, 1, 0, [["x", " y  z"]])], "doc_id int, page int, ord int, rows array<array<string>>")).first()
    assert (ev.total_chars, ev.total_pages) == (3, 2) and ev.pages[0].blocks[0].block_id == "doc_p1_b1" and ev.pages[0].tables[0].cells[1].raw_text == "y z"
    assert E.on_page(snippets, pages).filter("sid = 4").first().text == ""


def test_containment_against_brute_force(spark):
    g = random.Random(4)
    word = lambda n: "".join(g.choice("ab ") for _ in range(g.randint(0, n)))
    a, b = sorted({word(4) for _ in range(40)}), sorted({word(12) for _ in range(60)})
    got = A.containing(spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "l string")).collect()
    assert sorted((r.s, r.l) for r in got) == sorted((x, y) for x in a if x for y in b if x in y)
    left = spark.createDataFrame([(i, x, float(i), "RED") for i, x in enumerate([*a, "AB", " a"])], "ord long, indicator string, value double, status string")
    right = spark.createDataFrame([(i, x, 5.0, "GREEN") for i, x in enumerate(b)], "ord long, indicator string, value double, status string")
    norm = lambda x: x.strip(" ").lower()
    want = {}
    for i, x in enumerate([*a, "AB", " a"]):
        want[i] = next((j for j, y in enumerate(b) if norm(x) in norm(y) or norm(y) in norm(x)), None)
    out = {r.ord: r.status_b for r in A.compare_metrics(left, right).collect()}
    assert out == {i: "NOT_REPORTED" if j is None else "GREEN" for i, j in want.items()}
    for keep in (True, False):
        p = A.persistent(spark.createDataFrame([(x,) for x in b], "t string"), spark.createDataFrame([(x,) for x in a], "t string"), "t", 3, keep).collect()
        assert sorted(r.t for r in p) == sorted(y for y in b if keep == any(y[:3] in x or x[:3] in y for x in a))


def test_evaluation(spark):
    e = spark.createDataFrame([(1, "Thu ngân sách"), (1, "Chi"), (2, "x")], "doc_id int, indicator string")
    f = spark.createDataFrame([(1, "thu NGÂN sách nhà nước"), (1, "khác"), (1, "lạ")], "doc_id int, indicator string")
    got = {r.doc_id: (r.tp, round(r.precision, 4), r.recall, round(r.f1, 4)) for r in A.kpi_matches(e, f).collect()}
    assert got == {1: (1, 0.3333, 0.5, 0.4), 2: (0, 0.0, 0.0, 0.0)}
    assert one(spark, A.header_hits(F.array(F.lit("Kế hoạch"), F.lit("x")), F.array(F.lit("kế hoạch năm")))) == 1
    s = spark.createDataFrame([("PASS",), ("PASS",), ("FAIL",), ("UNSUPPORTED_FORMAT",), (None,)], "status string")
    r = A.run_rollup(s).first()
    assert (r.total, r.passed, r.failed, r.skipped, r.pass_percent) == (5, 2, 1, 1, 50.0)
    c = A.status_counts(spark.createDataFrame([("PERFECT",), ("ERROR",), ("PERFECT",)], "status string")).first()
    assert (c.total, c.perfect, c.warning, c.error, c.failed) == (3, 2, 0, 1, 0)
    p = {r.doc_id: r for r in A.text_preservation(spark.createDataFrame([(1, 1000, "x" * 500), (2, 10, "a undefined NaN null"), (3, 0, None)], "doc_id int, source_chars int, text string")).collect()}
    assert (p[1].status, p[1].kept_percent, p[2].status, p[2].undefined, p[2].nan, p[2].nulls, p[3].status) == ("WARNING", 50, "ERROR", 1, 1, 1, "PERFECT")
    pair = W.with_record_id(spark.createDataFrame([("h1",)], "file_hash_sha256 string")).select(F.col("report_id").alias("id"))
    assert A.report_pair(pair, "rec-h1", "rec-h1").count() == 1 and A.report_pair(pair, "rec-h1", "no").count() == 0
    t = lambda *v: one(spark, A.table_accuracy(*[F.lit(x) for x in v]))
    assert t(0, 0, 9, 1) == 1.0 and abs(t(1, 2, 12, 8) - 0.5) < 1e-12 and abs(t(2, 2, 20, 8) - 0.6) < 1e-12


def test_legacy(spark):
    pages = spark.createDataFrame([(1, 1, "Thu ngân sách ước 5,5 tỷ và đạt 65%"), (1, 2, "thu ngân sách 9 tỷ, tiếp 12 lượt, đúng hạn 99,5%"), (2, 1, "không")], "doc_id int, page int, text string")
    got = [(r.doc_id, r.metric_name, r.actual_value, r.status, r.page_ref) for r in L.legacy_metrics(pages).orderBy("doc_id", "n").collect()]
    assert got == [(1, "Thu ngân sách địa phương", "5,5 tỷ", "GREEN", 1), (1, "Tỷ lệ hoàn thành chỉ tiêu", "65%", "RED", 1), (1, "Lượt tiếp công dân", "12", "RED", 2), (1, "Tỷ lệ giải quyết đúng hạn", "99,5%", "GREEN", 2), (2, "Tiến độ thực hiện nhiệm vụ", "100%", "GREEN", 1)]
    docs = spark.createDataFrame([(1, "T", "Khó khăn: " + "thiếu vốn đầu tư " * 5 + "\n2. Phương hướng\n- Tiếp tục rà soát toàn bộ các dự án\nngắn\n- Hoàn thiện hồ sơ của các công trình"), (2, "T", None)], "doc_id int, title string, text string")
    r = {x.doc_id: x for x in L.legacy_records(docs).collect()}
    assert r[1].overall_evaluation == "NEEDS_ATTENTION" and r[1].bottleneck.startswith("thiếu vốn") and [(t.task_title, t.priority) for t in r[1].tasks] == [("Tiếp tục rà soát toàn bộ các dự án", "HIGH"), ("Hoàn thiện hồ sơ của các công trình", "NORMAL")]
    assert r[2].overall_evaluation in (None, "GOOD")


def test_fallback_cards(spark):
    shown = spark.createDataFrame([(1, 1, 0, "A", "CRITICAL", "RED", 1)], "doc_id int, rank int, seq int, title string, level string, colour string, place int")
    got = R.cards_with_fallback(shown, spark.createDataFrame([(1, 5, 2), (2, 0, 1)], "doc_id int, metrics long, actions long")).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.place, r.title) for r in got] == [(1, 1, "A"), (1, 2, "5 chỉ tiêu đã được số hóa và chuẩn hóa"), (2, 1, "0 chỉ tiêu đã được số hóa và chuẩn hóa"), (2, 2, "1 nhiệm vụ tiếp theo")]


def test_column_widths(spark):
    g = random.Random(2)
    for total in (482, 760, 9600, 14000):
        for _ in range(30):
            n = g.randint(1, 9)
            headers = [g.choice(["STT", "Đơn vị", "Kế hoạch", "Ghi chú", "Nội dung công việc", ""]) for _ in range(n)]
            rows = [["x" * g.randint(0, 90) for _ in range(n)] for _ in range(g.randint(0, 40))]
            w = X.column_widths(headers, rows, total)
            assert len(w) == n and sum(w) == total and min(w) > 0
    assert X.column_widths(["STT", "Nội dung"], [["1", "a" * 100]], 482)[0] == 30
    assert X.has_second_header(["", "Năm"], [["", "Kế hoạch"], ["1", "a"]]) and not X.has_second_header(["A", "B"], [["1", "2"], ["3", "4"]])
    df = spark.createDataFrame([(1, 0, ["STT", None], [["1", None]])], "doc_id int, ord int, headers array<string>, rows array<array<string>>")
    assert sum(X.table_widths(df).first().widths) == 482


def test_queue(spark, tmp_path):
    at = str(tmp_path / "q")
    assert ingest.load_states(spark, at).count() == 0
    events = spark.createDataFrame([("b", "1", "PENDING", "2026-01-01 00:00:00"), ("b", "1", "RANKING", "2026-01-01 00:00:01"), (None, "2", "FAILED", "2026-01-01 00:00:00")], "batch_id string, job_id string, state string, ts string")
    ingest.save_states(events, at)
    ingest.save_states(events.limit(1), at)
    assert [(r.batch_id, r.job_id, r.state) for r in ingest.load_states(spark, at).collect()] == [("b", "1", "RANKING")]
    batches = spark.createDataFrame([(str(i), i, i % 3 != 0) for i in range(12)], "batch_id string, ord int, is_complete boolean")
    left = sorted(r.ord for r in ingest.retained(batches, 10).collect())
    assert left == [0, 3, *range(5, 12)] and ingest.retained(batches, 20).count() == 12
    assert sorted(r.ord for r in ingest.retained(batches, 2).collect()) == [0, 3, 6, 9]


def test_warehouse_survives_a_failed_write(spark, tmp_path, monkeypatch):
    """The third write fails; the replay stores every table whole and nothing twice."""
    meta, none = (None,) * 9, []
    detail = ([("m", None, "1", None, None, None, None, None, None)], [], [("p", *[None] * 10)], [("t", None, None, None, None, None)], None)
    rows = spark.createDataFrame([(i, f"text {i}", meta, detail) for i in range(3)], f"ord long, raw_text string, {W.REPORT}")
    at = str(tmp_path / "wh")
    real, calls = W.fan_out, none

    class Broken:
        def __init__(self, df):
            self.df = df

        @property
        def write(self):
            calls.append(1)
            if len(calls) == 3:
                raise OSError("disk")
            return self.df.write

    monkeypatch.setattr(W, "fan_out", lambda r: {k: Broken(v) for k, v in real(r).items()})
    with pytest.raises(OSError, match="disk"):
        W.save_reports(spark, rows, "raw_text", at, 7)
    schema = {"reports": "id string", "report_metrics": "id string", "report_tasks": "id string", "report_bottlenecks": "id string"}
    assert all(W.read_table(spark, at, t, s).count() == 0 for t, s in schema.items())
    monkeypatch.setattr(W, "fan_out", real)
    for _ in range(2):  # the second replay finds the batch committed
        W.save_reports(spark, rows, "raw_text", at, 7)
    W.save_reports(spark, rows, "raw_text", at, 8)  # known texts add nothing
    assert all(W.read_table(spark, at, t, s).count() == 3 for t, s in schema.items())


def test_scan_and_requests(spark, tmp_path):
    (tmp_path / "a.doc").write_bytes(b"old")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.doc", "b.pdf", "c.docx"} and "UNSUPPORTED_FORMAT" in got["a.doc"] and all(got.values())
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / requests.upload_name(1_700_000_000_000, "bản 1.pdf", 5)).write_bytes(b"x")
    (tmp_path / "up" / "keep.pdf").write_bytes(b"x")
    import datetime

    assert files.vacuum_uploads(spark, str(tmp_path / "up"), datetime.datetime(2100, 1, 1)) == 1 and [p.name for p in (tmp_path / "up").iterdir() if not p.name.startswith(".")] == ["keep.pdf"]
    assert requests.check_request({"filePath": "a"}) == [] and requests.check_request({"filePath": ""}) and requests.check_request({}) and requests.check_request({"reportData": 1})
    assert requests.allowed("/health?x", {}, "k") and requests.allowed("/r", {"X-API-Key": "k"}, "k") and requests.allowed("/r", {"Authorization": "Bearer k"}, "k") and not requests.allowed("/r", {}, "k") and requests.allowed("/r", {}, None)
    with pytest.raises(ValueError, match="at most"):
        requests.upload_name(1, "a", 1 << 40)


def test_gap_words_meet_a_page_once(spark):
    """Both kinds of gaps are found by one join of blocks and pages, whatever their number."""
    from reportloom.operators import evidence

    word = lambda no, t, x0, x1, y=100.0: (1, 1, no, t, x0, y, x1, y + 10)
    rows = [word(0, "Số:", 10.0, 25.0), word(1, "/BC", 60.0, 90.0), word(5, "7", 41.0, 50.0), word(4, "12", 30.0, 40.0), word(6, "xa", 30.0, 40.0, 300.0), word(7, "ngày", 100.0, 110.0), word(8, "tháng", 130.0, 150.0), word(9, "3", 115.0, 120.0), (None, 1, 0, "Số:", 1.0, 1.0, 1.0, 1.0)]
    words = spark.createDataFrame(rows, "doc_id long, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    block = [(1, 1, 0, "Số:  /BC ngày   tháng 2", 98.0, 114.0), (1, 1, 1, "Số:  /BC", 298.0, 314.0), (2, 1, 0, "Số: /BC", 98.0, 114.0), (1, 1, 2, None, 98.0, 114.0)]
    got = evidence.gap_words(words, spark.createDataFrame(block, "doc_id long, page int, block_no int, text string, y0 double, y1 double"))
    assert sorted((r.doc_id, r.block_no, r.gap, r.filling, r.word_nos) for r in got.collect()) == [(1, 0, "Số:", "12 7", [4, 5]), (1, 0, "ngày", "3", [9])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
