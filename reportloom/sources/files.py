"""File sources: dispatch by format, listings, DOCX parsing, uploads and their age."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docx import Block, body_blocks, paged

SUPPORTED = ("pdf", "docx", "doc")


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, file_name, size_kb, format, ord of the supported files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("format", kind).filter(F.col("format").isin(*SUPPORTED)).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.round(F.col("length") / 1024).cast("long").alias("size_kb"), "format", "modificationTime")


def inside(root: str, path: str) -> bool:
    """Whether a path stays in the sandbox root."""
    import posixpath

    root, path = posixpath.normpath(root), posixpath.normpath(posixpath.join(root, path))
    return path == root or path.startswith(root.rstrip("/") + "/")


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a DOCX body: headings, paragraphs, and tables as tab-separated rows."""
    return [(b.kind, b.text) for b in body_blocks(content)]


def docx_scan(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, kind, text, error of every DOCX below a path; a corrupt file gives one row
    with its error and never fails the others (R3, Q1)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, i, k, t, None) for i, (k, t) in enumerate(docx_blocks(bytes(c)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, 0, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "text", "error"])

    return files.mapInPandas(run, "path string, ord int, kind string, text string, error string")


BLOCK = "path string, ord int, kind string, text string, page int, table_id string, rows array<array<string>>, error string"


def pdf_blocks(content: bytes) -> list[Block]:
    """(kind, text, page) of a PDF's text blocks and tables (R2). The reader is optional."""
    import fitz

    out = []
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, 1):
            out += [Block("paragraph", b[4].strip(), None, number) for b in page.get_text("blocks") if b[4].strip()]
            tables = [[[" ".join((c or "").split()) for c in r] for r in t.extract()] for t in page.find_tables().tables]
            out += [Block("table", "\n".join("\t".join(r) for r in t), t, number, f"table-p{number}-{i}") for i, t in enumerate(tables, 1)]
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every supported file below a path, by the reader of its format, with logical pages and
    tables' numbers and cells (R1, R2, R3, X15). A file
    that can't be read, for want of a reader (old .doc always, PDF without its library) or because
    it is broken, gives one row with its error (R4) and never fails the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.select("path", kind.alias("format"), "content").filter(F.col("format").isin(*SUPPORTED))

    def blocks(format_: str, content: bytes) -> list[Block]:
        if format_ == "doc":
            raise NotImplementedError("UNSUPPORTED_FORMAT: convert .doc to .docx first")
        if format_ == "pdf":
            try:
                return pdf_blocks(content)
            except ImportError as e:
                raise NotImplementedError("UNSUPPORTED_FORMAT: no PDF reader is installed") from e
        return paged(body_blocks(content))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, kind, c in zip(f["path"], f["format"], f["content"], strict=True):
                try:
                    rows += [(p, i, b.kind, b.text, b.page, b.table_id, b.rows, None) for i, b in enumerate(blocks(kind, bytes(c)))]
                except Exception as e:  # noqa: BLE001  one broken file must not fail the others
                    rows.append((p, 0, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "text", "page", "table_id", "rows", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(run, BLOCK)


def needs_ocr(pages: DataFrame) -> DataFrame:
    """The routing rule of image pages (R6) and scanned documents."""
    return pages.withColumn("needs_ocr", ((F.col("char_count") < 40) & F.col("has_images")) | (F.col("char_count") == 0))


def scanned(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.sum("char_count").alias("total_chars"), F.count("*").alias("pages")).withColumn("is_scanned", F.col("total_chars") < 50 * F.col("pages"))


def vacuum_uploads(spark: SparkSession, path: str, now, hours: int = 2) -> int:
    """Delete the expired uploads of a landing folder; the number deleted (W8). Listed by the driver:
    a landing folder holds what came in during some hours."""
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "modificationTime")
    gone = 0
    for r in expired_uploads(files, now, hours).select("path").toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        gone += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    return gone


def expired_uploads(files: DataFrame, now, hours: int = 2) -> DataFrame:
    """Uploads named by their millisecond stamp that are too old."""
    return files.filter(F.col("file_name").rlike(r"^\d{13}_") & (F.col("modificationTime") < F.lit(now) - F.make_dt_interval(hours=F.lit(hours))))
