"""The whole flow: DOCX files, scan, records, warehouse, flat form."""

from pyspark.sql import functions as F

from reportloom.operators import process as PR
from reportloom.operators import warehouse as W
from reportloom.sources import docx as DX

LINES = [
    "UBND TỈNH A", "Số: 12/BC-UBND", "A, ngày 5 tháng 3 năm 2025", "BÁO CÁO", "Tình hình thu ngân sách năm 2025.", "- Thu ngân sách: 120 tỷ đồng.", "Giải ngân giảm 30 %.", "Khó khăn nghiêm trọng do thiếu vật liệu, dẫn đến chậm tiến độ.", "Tiếp tục triển khai các dự án trọng điểm.",
]
GRID = [["STT", "Chỉ tiêu", "Kế hoạch", "Thực hiện"], ["1", "Đường", "100", "50"], ["2", "Cầu lớn", "80", "60"], ["Tổng cộng", "", "180", "110"]]


def test_folder_to_warehouse(spark, tmp_path):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    blocks = [("paragraph", x, None) for x in LINES] + [("table", None, GRID)]
    DX.register(spark)
    rows = [("one", blocks), ("copy", blocks), ("two", [("paragraph", "Dân số là 900 người", None)])]
    spark.createDataFrame(rows, "name string, blocks array<struct<kind:string,text:string,rows:array<array<string>>>>").write.format("report_docx").mode("append").save(folder)
    with open(f"{folder}/broken.docx", "wb") as f:
        f.write(b"x")
    assert PR.process_folder(spark, folder, store, 1).count() == 1
    reports = spark.read.parquet(f"{store}/reports")
    metrics = {(r.indicator_name, r.actual_value, r.status) for r in spark.read.parquet(f"{store}/report_metrics").collect()}
    assert reports.count() == 2  # the copy is stored once
    one = reports.filter("document_number is not null").first()
    assert (one.document_number, one.issuing_authority, one.issuance_date, one.document_type) == ("12/BC-UBND", "UBND TỈNH A", "2025-03-05", "BAO_CAO")
    assert {("Thu ngân sách", "120", "GREEN"), ("Giải ngân", "30", "RED"), ("Dân số", "900", "GREEN")} <= metrics and any(a == "110" for _, a, _ in metrics)
    t = spark.read.parquet(f"{store}/report_tables").collect()
    assert [(r.headers, r.row_count, r.page_ref) for r in t] == [(GRID[0], 3, 1)]
    b = spark.read.parquet(f"{store}/report_bottlenecks").collect()
    assert [(r.urgency, r.root_cause) for r in b] == [("CRITICAL", "Do thiếu vật liệu")]
    assert spark.read.parquet(f"{store}/report_tasks").count() == 2
    PR.process_folder(spark, folder, store, 2)
    assert spark.read.parquet(f"{store}/reports").count() == 2  # nothing new


def test_flat_form(spark):
    path = lambda i: f"/d/{i}.docx"
    rows = [(path(1), i, "paragraph", x, 1, None, None, None) for i, x in enumerate(LINES)] + [(path(1), 20, "table", "", 1, "word-table-1", GRID, None), (path(2), 0, None, None, None, None, None, "broken"), (path(3), 0, "paragraph", None, 1, None, None, None)]
    blocks = spark.createDataFrame(rows, DX.BLOCK)
    flat = {r.doc_id: r for r in PR.legacy_report(PR.report_records(blocks)).collect()}
    assert set(flat) == {path(1), path(3)}
    r = flat[path(1)]
    assert r.metadata.report_category == "TAI_CHINH_DAU_TU" and r.executive_brief.overall_rating == "CANH_BAO_DO" and len(r.executive_brief.critical_warnings) == 1
    assert [t.headers for t in r.tables] == [GRID[0]] and r.bottlenecks[0].impact_severity == "NGHIEM_TRONG" and {i.status for i in r.indicators} == {"GREEN", "RED"}
    assert flat[path(3)].indicators == [] and flat[path(3)].executive_brief.overall_rating == "HOAN_THANH_TOT"
    got = {c: w for c, w in spark.createDataFrame([("Kinh tế A",), ("Quyết toán",), ("CCHC",), (None,)], "t string").select("t", PR.report_category(F.col("t"))).collect()}
    assert got == {"Kinh tế A": "KTXH_TONG_HOP", "Quyết toán": "TAI_CHINH_DAU_TU", "CCHC": "CCHC_TCD_PCTN", None: "CHUYEN_NGANH"}
    assert PR.failed(blocks).count() == 1 and W.TABLES[0] == "reports"
