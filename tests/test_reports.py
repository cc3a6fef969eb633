"""Report operators on the domain's own fixtures."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from reportloom.functions import scalars as S
from reportloom.operators import analytics as A
from reportloom.operators import export as X
from reportloom.operators import ranking as R
from reportloom.operators import tables as T
from reportloom.operators import textops as TX
from reportloom.operators import warehouse as W
from reportloom.sources import files, taxonomy
from reportloom.streaming import ingest

HUYEN = "UBND Huyện Long Thành"
MONTHS = [
    ("Văn bản tháng 1", "2026-01-25", [("Tỷ lệ giải ngân vốn đầu tư công", "15.5%", "15.5", "RED"), ("Thu ngân sách nhà nước", "120 tỷ đồng", "20.0", "GREEN")], [("Vướng mắc bồi thường giải phóng mặt bằng đường cao tốc", "HIGH")], "IN_PROGRESS"),
    ("Văn bản tháng 2", "2026-02-25", [("Tỷ lệ giải ngân vốn đầu tư công", "38.2%", "38.2", "GREEN"), ("Thu ngân sách nhà nước", "250 tỷ đồng", "41.6", "GREEN")], [("Vướng mắc bồi thường giải phóng mặt bằng đường cao tốc", "HIGH"), ("Thiếu hụt nguồn vật liệu cát san lấp", "MEDIUM")], "PENDING"),
]


@pytest.fixture(scope="module")
def reports(spark):
    rows = []
    for i, (text, day, metrics, problems, status) in enumerate(MONTHS):
        meta = (None, None, None, HUYEN, None, day, None, None, None)
        detail = ([(n, None, a, p, None, s, None, None, None) for n, a, p, s in metrics], [], [(p, *[None] * 6, u, *[None] * 3) for p, u in problems], [("Đẩy nhanh tiến độ", None, None, None, None, status)], None)
        rows.append((i, text, meta, detail))
    return spark.createDataFrame(rows, f"ord long, raw_text string, {W.REPORT.replace('metadata struct', 'metadata struct')}")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_warehouse_round(spark, reports, tmp_path):
    at = str(tmp_path / "wh")
    W.save_reports(spark, reports, "raw_text", at)
    W.save_reports(spark, reports.filter("ord = 0"), "raw_text", at)  # a second save adds nothing
    n = {t: spark.read.parquet(f"{at}/{t}").count() for t in ("reports", "report_metrics", "report_bottlenecks", "report_tasks")}
    assert n == {"reports": 2, "report_metrics": 4, "report_bottlenecks": 3, "report_tasks": 2}
    m = spark.read.parquet(f"{at}/report_metrics").select(F.col("indicator_name").alias("indicator"), F.col("issuing_authority").alias("authority"), F.col("issuance_date").alias("period"), F.col("actual_value").alias("actual"), "percentage", "status", F.monotonically_increasing_id().alias("ord"))
    t = A.kpi_trends(m, indicator="giải ngân").first()
    assert (t.points, t.growth_rate, t.trajectory) == (2, 146.5, "IMPROVING")
    b = spark.read.parquet(f"{at}/report_bottlenecks").select("category", "urgency", F.col("issuing_authority").alias("authority"), "root_cause", "problem", F.monotonically_increasing_id().alias("ord"))
    top = A.heatmap(b).first()
    assert (top.category, top.occurrences, top.high_urgency, top.authorities) == ("GIAI_PHONG_MAT_BANG", 2, 2, [HUYEN])
    jan, feb = (spark.read.parquet(f"{at}/report_bottlenecks").filter(F.col("issuance_date") == d) for d in ("2026-01-25", "2026-02-25"))
    assert A.persistent(feb, jan, "problem").count() == 1 and A.persistent(feb, jan, "problem", keep=False).count() == 1
    assert W.read_table(spark, at, "nothing", "a string").count() == 0


@pytest.mark.parametrize(("text", "value"), [("1.250,5", 1250.5), ("12,5", 12.5), ("1.500", 1500), ("12.5", 12.5), ("1.234.567", 1.234), ("0.500", 500), ("500 m2", 5002), ("12,300", 12.3), ("(120)", None), ("", None), (None, None), ("15 tỷ đồng", 15)])
def test_vn_number(spark, text, value):
    assert one(spark, S.vn_number(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize(("text", "value"), [("5.200", 5.2), ("15.5%", 15.5), (" -3e2x", -300.0), ("x", None), (".5", 0.5)])
def test_lenient_float(spark, text, value):
    assert one(spark, S.lenient_float(F.lit(text))) == value


def test_scalars(spark):
    assert one(spark, S.row_role(F.lit("  Tổng cộng "))) == "TOTAL" and one(spark, S.row_role(F.lit("Trong đó"))) == "BREAKDOWN"
    assert one(spark, S.row_role(F.lit("Cộng mục I"))) == "SUBTOTAL" and one(spark, S.row_role(F.lit("A"))) == "BASE_ITEM"
    assert one(spark, S.zero_semantics(F.lit("Số đơn khiếu nại"), F.lit("đơn"))) == "POSITIVE_ZERO"
    assert one(spark, S.zero_semantics(F.lit("Tỷ lệ đạt"), F.lit("%"))) == "CRITICAL_ZERO"
    assert one(spark, S.infer_unit(F.lit("Diện tích rừng"))) == "ha" and one(spark, S.infer_unit(F.lit("x"), F.lit(" nguoi "))) == "Người" and one(spark, S.infer_unit(F.lit("Số (km)"))) == "km"
    assert one(spark, S.bottleneck_category(F.lit("GIẢI NGÂN chậm"))) == "VON_DAU_TU"
    assert one(spark, S.document_type(F.lit("UBND\nTỜ TRÌNH\nvề"))) == "TO_TRINH" and one(spark, S.document_type(F.lit("abc"))) == "BAO_CAO"
    assert one(spark, S.issuance_date(F.lit("ngày 5 tháng 2 năm 2026"))) == "2026-02-05" and one(spark, S.issuance_date(F.lit("ngày tháng 2 năm 2026"))) == "2026-02-01"
    assert one(spark, S.csv_cell(F.lit(' =1+"a" '))) == '"\'=1+""a"""' and one(spark, S.csv_cell(F.lit(None).cast("string"))) == '""'
    assert one(spark, S.vn_format(F.lit(1234567.5))) == "1.234.567,5" and one(spark, S.vn_format(F.lit(1000.0))) == "1.000"
    assert one(spark, S.clean_text(F.lit("[HIGH] **đậm**  , x  ( )"))) == "đậm, x"
    assert one(spark, S.error_rate(F.lit(""), F.lit("a"))) == 1.0 and one(spark, S.error_rate(F.lit("ab c"), F.lit("ab  c"))) == 0.0
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert abs(one(spark, S.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) - 1 / 3) < 1e-9 and one(spark, S.box_iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0.0
    assert one(spark, S.file_stem(F.lit("Báo cáo: Đường số 1"))) == "Bao_cao_Duong_so_1"
    assert one(spark, F.lit("căn cứ x").rlike(S.web_regex(r"^căn cứ\b"))) is False
    assert one(spark, S.header_similar(F.array(F.lit("STT"), F.lit("Tên")), F.array(F.lit("stt"), F.lit("x")))) is True
    assert [w.word for w in one(spark, S.word_boxes(F.lit("a b"), F.lit(0.0), F.lit(10.0)))] == ["a", "b"]


def test_table_audits(spark):
    def audit(rows):
        long = spark.createDataFrame([(1, i, c, r[0], r[c]) for i, r in enumerate(rows) for c in range(1, len(r))], "table_id int, row_index int, col_index int, name string, text string")
        return T.sum_audit(long.select("table_id", "row_index", "col_index", S.row_role(F.col("name")).alias("role"), S.vn_number(F.col("text")).alias("value"))).collect()

    assert not audit([("A", "50"), ("B", "30"), ("C", "20"), ("Tổng cộng", "100,0")])
    assert not audit([("A", "100"), ("Trong đó", "40"), ("B", "50"), ("C", "30"), ("Tổng cộng", "180")])
    bad = audit([("A", "100"), ("B", "200"), ("Tổng cộng", "500")])
    assert [(r.expected, r.actual) for r in bad] == [(300.0, 500.0)]
    assert one(spark, T.percent_finding(F.lit(100.0), F.lit(50.0), F.lit(85.0))) == 50.0 and one(spark, T.percent_finding(F.lit(100.0), F.lit(50.0), F.lit(51.0))) is None
    units = spark.createDataFrame([(1, 1, "15 tỷ đồng"), (1, 1, "500 triệu đồng")], "table_id int, col_index int, text string")
    assert T.unit_audit(units).count() == 1
    tree = one(spark, T.header_tree(F.array(F.lit("Năm 2025 - Kế hoạch"), F.lit("Năm 2025 - Thực hiện"), F.lit("STT"))))
    assert len(tree["Năm 2025"]) == 2 and tree["STT"][0].col_index == 2
    roles = one(spark, T.header_roles(F.array(*[F.lit(x) for x in ("STT", "Kế hoạch", "Thực hiện", "Tỷ lệ thực hiện kế hoạch")])))
    assert (roles.plan, roles.actual, roles.rate) == (2, 3, 4)
    assert one(spark, T.row_class(F.array(F.lit("II"), F.lit("Chi")))) == "SECTION"
    spans = T.header_spans(spark.createDataFrame([(1, 0, "A"), (1, 1, ""), (1, 2, "B")], "table_id int, col_index int, parent string")).collect()
    assert sorted((r.parent, r.span) for r in spans) == [("A", 2), ("B", 1)]


def test_extraction(spark):
    text = "I. ĐẶC ĐIỂM TÌNH HÌNH\n- Dân số xã: 500 người.\nII. KẾT QUẢ THỰC HIỆN\nTổng thu ngân sách ước đạt 5.200 tỷ đồng.\n- Đầu tư công: 850,5 tỷ đồng\n- Đầu tư công: 850,5 tỷ đồng\nKhó khăn do thiếu vật liệu, dẫn đến chậm tiến độ.\nTiếp tục triển khai các dự án trọng điểm.\nĐề nghị tỉnh bố trí vốn kịp thời."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    m = {r.indicator.lower(): r for r in TX.metrics(docs).collect()}
    assert m["tổng thu ngân sách"].actual == "5.200" and m["tổng thu ngân sách"].data_nature == "UOC_THUC_HIEN" and m["đầu tư công"].actual == "850,5"
    assert not any("dân số" in k for k in m)
    r = TX.relationships(docs).first()
    assert r.severity == "HIGH" and r.cause.startswith("Do thiếu") and r.impact.startswith("dẫn đến")
    assert TX.actions(docs).count() == 1 and TX.recommendations(docs).count() == 1


def test_sequences(spark):
    lines = spark.createDataFrame([(1, i, "x" * 900) for i in range(6)], "doc_id int, ord int, line string")
    assert [r.page for r in TX.pack_pages(lines).orderBy("ord").collect()] == [1, 1, 2, 2, 3, 3]
    tabs = spark.createDataFrame([(1, 0, ["STT", "Tên"], [["1", "a"]]), (1, 1, ["STT", "Tên"], [["2", "b"]]), (1, 2, ["X", "Y", "Z"], [["q", "r", "s"]])], "doc_id int, ord int, headers array<string>, rows array<array<string>>")
    assert sorted((r.pieces, len(r.rows)) for r in TX.stitch_tables(tabs).collect()) == [(1, 1), (2, 2)]
    near = TX.locate_snippets(spark.createDataFrame([(1, 1, "Thu ngân sách tăng mạnh trong kỳ"), (1, 2, "không có gì")], "doc_id int, sid int, snippet string"), spark.createDataFrame([(1, 1, "mở đầu"), (1, 2, "kỳ này thu ngân sách tăng mạnh trong kỳ báo cáo")], "doc_id int, page int, text string"))
    assert sorted((r.sid, r.page, r.tier) for r in near.collect()) == [(1, 2, "EXACT"), (2, None, "FALLBACK")]


def test_cards(spark):
    df = lambda rows, extra="": spark.createDataFrame(rows, f"doc_id int, ord int, title string{extra}")
    none = df([])
    c = R.cards(df([(1, 0, "Quyết định A")]), none, df([(1, 0, "p", "CAO"), (1, 1, "q", "NGHIEM_TRONG")], ", severity string"), df([(1, 0, "Quyết định A ngay"), (1, 1, "khác")]), df([(1, 0, "m", "0", "GREEN"), (1, 1, "n", "5", "RED")], ", actual string, status string"), none)
    got = [(r.rank, r.title, r.colour) for r in c.orderBy("place").collect()]
    assert got == [(1, "Quyết định A", "RED"), (3, "q", "RED"), (4, "p", "RED"), (7, "khác", "AMBER"), (9, "n", "RED")]


def test_taxonomy(spark):
    dim = taxonomy.taxonomy(spark)
    assert dim.count() >= 15
    v = spark.createDataFrame([("Giải ngân vốn",), ("không rõ",)], "raw string")
    got = {r.raw: r.code for r in A.resolve_taxonomy(v, dim, "HANH_CHINH_TONG_HOP").collect()}
    assert got == {"Giải ngân vốn": "DTC_GIAI_NGAN", "không rõ": "HANH_CHINH_TONG_HOP"}


def test_sources(spark, tmp_path):
    assert files.inside("/a/b", "c/d") and not files.inside("/a/b", "../x") and not files.inside("/a/b", "/etc")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Xin chào</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "ok.docx").write_bytes(buf.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = files.docx_scan(spark, str(tmp_path)).collect()
    assert sorted((r.kind or "", r.text or "", bool(r.error)) for r in rows) == [("", "", True), ("paragraph", "Xin chào", False), ("table", "a\tb", False)]
    assert files.listing(spark, str(tmp_path)).count() == 2
    assert files.expired_uploads(files.listing(spark, str(tmp_path)), datetime.datetime(2100, 1, 1)).count() == 0


def test_batch_keeps_failures(spark, tmp_path):
    for n, c in (("a", b"1"), ("b", b"x"), ("c", b"3")):
        (tmp_path / n).write_bytes(c)
    f = spark.read.format("binaryFile").load(str(tmp_path))
    out = ingest.run_batch(f, lambda c: str(int(c)), "string").collect()
    assert sorted(r.status for r in out) == ["COMPLETED", "COMPLETED", "FAILED"]
    with pytest.raises(ValueError, match="at most"):
        ingest.run_batch(f, str, "string", most=2)


def test_stream_into_warehouse(spark, reports, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "wh")
    reports.drop("ord").write.parquet(src)
    stream = spark.readStream.schema(reports.drop("ord").schema).parquet(src)
    for k in range(2):  # the second run starts over and must add nothing
        ingest.ingest(stream, at, str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(f"{at}/reports").count() == 2


def test_exports(spark):
    t = spark.createDataFrame([(1, 1, "T", 2, ["a"], [["=x"], ["y"]])], "doc_id int, ord int, title string, page_ref int, headers array<string>, rows array<array<string>>")
    assert X.csv_documents(t).first().csv.split("\r\n")[:3] == ['﻿"=== BẢNG 1: T (Trang 2) ==="', '"a"', '"\'=x"']
    assert X.markdown_tables(t).first().markdown == "| a |\n| --- |\n| =x |\n| y |"
    assert X.layout_rows(t).count() == 2
    assert '"b" : null' in X.json_documents(spark.createDataFrame([(1, None)], "a int, b string")).first().json
