"""DOCX files as a data source and a sink, against plain parsing and on broken and failing jobs."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from reportloom.sources import docx as DX
from reportloom.sources import files

BLOCKS = [
    ("heading", "I. MỞ ĐẦU", None), ("paragraph", "a < b & c\nhai dòng", None), ("table", None, [["STT", "Tên"], ["1", None], ["", " x  y "]]),
    ("paragraph", "", None), ("paragraph", "x" * 1500, None), ("heading", "II. KẾT", None), ("table", None, [["a"]] * 40), ("paragraph", "ctl\x01 \t tab", None),
]
SCHEMA = "name string, blocks array<struct<kind:string,text:string,rows:array<array<string>>>>"


def plain(content):
    return [(b.kind, b.text, b.page, b.table_id, b.rows) for b in DX.paged(DX.body_blocks(content))]


@pytest.fixture(scope="module")
def sources(spark):
    DX.register(spark)


@pytest.fixture
def folder(spark, sources, tmp_path):
    at = f"{tmp_path}/docs"
    rows = [(f"báo cáo/{i}", BLOCKS[: i % len(BLOCKS) + 1]) for i in range(20)] + [("empty", []), ("none", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.format("report_docx").mode("overwrite").save(at)
    return at


def test_parts_and_pages():
    got = plain(DX.docx_bytes(BLOCKS))
    assert [x[:2] for x in got[:3]] == [("heading", "I. MỞ ĐẦU"), ("paragraph", "a < b & c\nhai dòng"), ("table", "STT\tTên\n1\t\n\tx y")]
    assert got[2][4] == [["STT", "Tên"], ["1", ""], ["", "x y"]] and [x[3] for x in got if x[3]] == ["word-table-1", "word-table-2"]
    assert [x[2] for x in got] == [1, 1, 1, 1, 2, 2, 2]  # a section after 800 characters starts a page
    assert got[-1][1] == "ctl \t tab" and DX.docx_bytes(BLOCKS) == DX.docx_bytes(BLOCKS)
    tall = [DX.Block("paragraph", "x" * 80) for _ in range(100)]
    pages = [b.page for b in DX.paged(tall)]
    assert pages == sorted(pages) and pages[25] == 1 and pages[26] == 2  # 26 lines of 28 reach the bottom edge


def test_reads_what_was_written(spark, folder):
    assert len([x for x in os.listdir(folder) if x.endswith(".docx")]) == 22 and "_temporary" not in os.listdir(folder)
    with open(f"{folder}/broken.docx", "wb") as f:
        f.write(b"no zip")
    with zipfile.ZipFile(f"{folder}/other.docx", "w") as z:
        z.writestr("x", "y")
    df = spark.read.format("report_docx").option("maxPartitionBytes", 3000).load(folder)
    got = {}
    for r in df.orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.kind, r.text, r.page, r.table_id, r.rows) if r.error is None else "error")
    for path, rows in got.items():
        if path.endswith(("broken.docx", "other.docx")):
            assert rows == ["error"]
        else:
            with open(path, "rb") as f:
                assert rows == plain(f.read())
    assert len(got) == 22  # empty documents have no block
    assert 3 < df.rdd.getNumPartitions() < 24
    scanned = {(r.path.split(":", 1)[-1].replace("///", "/"), r.ord, r.text, r.page, r.table_id) for r in files.scan(spark, folder).filter("error is null").collect()}
    assert {(r.path, r.ord, r.text, r.page, r.table_id) for r in df.filter("error is null").collect()} == {(files_path(p), *rest) for p, *rest in scanned}


def files_path(p):
    from urllib.parse import unquote

    return unquote(p)


def test_columns_and_paths(spark, folder):
    with open(f"{folder}/broken.docx", "wb") as f:
        f.write(b"no zip")
    names = spark.read.format("report_docx").schema("path string").load(folder)
    assert names.count() == 23  # no file is opened
    part = spark.read.format("report_docx").schema("page int, path string").load(folder)
    assert part.columns == ["page", "path"] and part.filter("page = 2").count() > 0
    one = next(r.path for r in names.collect() if r.path.endswith("_7.docx"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        chosen = spark.read.format("report_docx").option("pushFilters", "true").load(folder).filter(F.col("path") == one)
        assert {r.path for r in chosen.collect()} == {one} and chosen.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("report_docx").load(f"{folder}/nothing").count() == 0


def test_stream_of_a_landing_folder(spark, folder, tmp_path):
    def now():
        q = spark.readStream.format("report_docx").load(folder).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        q.trigger(processingTime="1 second")
        run = q.start()
        run.processAllAvailable()
        run.stop()
        return spark.read.parquet(f"{tmp_path}/out").count()

    first = now()
    assert first == spark.read.format("report_docx").load(folder).count() and now() == first
    with open(f"{folder}/new.docx", "wb") as f:
        f.write(DX.docx_bytes(BLOCKS[:3]))
    assert now() == first + 3


def test_failed_writes_leave_nothing(spark, folder):
    before = {x: os.path.getsize(f"{folder}/{x}") for x in os.listdir(folder)}
    twice = spark.createDataFrame([("a", BLOCKS), ("a", BLOCKS[:1])], SCHEMA)
    known = spark.createDataFrame([("empty", BLOCKS)], SCHEMA)
    bad = spark.createDataFrame([("b", BLOCKS), ("c", BLOCKS)], SCHEMA).repartition(2).withColumn("name", F.when(F.col("name") == "c", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("name")))
    for df in (twice, known, bad):
        with pytest.raises(Exception):  # noqa: B017  the engine wraps what the writer raises
            df.write.format("report_docx").mode("append").save(folder)
        assert {x: os.path.getsize(f"{folder}/{x}") for x in os.listdir(folder)} == before
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).write.format("report_docx").mode("append").save(folder)
    spark.createDataFrame([("new", BLOCKS)], SCHEMA).write.format("report_docx").mode("append").save(folder)
    assert len([x for x in os.listdir(folder) if x.endswith(".docx")]) == 23
    spark.createDataFrame([("only", BLOCKS)], SCHEMA).write.format("report_docx").mode("overwrite").save(folder)
    assert [x for x in os.listdir(folder) if x.endswith(".docx")] == ["only.docx"]


def test_text_files(spark, sources, tmp_path):
    at = f"{tmp_path}/csv"
    spark.createDataFrame([("x/../y", "một\r\n"), (None, None)], "name string, content string").write.format("report_files").option("extension", "csv").mode("overwrite").save(at)
    assert sorted(x for x in os.listdir(at) if x.endswith(".csv")) == ["document.csv", "x_.._y.csv"]
    with open(f"{at}/x_.._y.csv", "rb") as f:
        assert f.read() == "một\r\n".encode()
