"""From the blocks of documents to stored reports: one flow over a folder.

    process_folder(spark, folder, warehouse)      scan, extract, store
    report_records(blocks)                        the records alone

blocks (path, ord, kind, text, page, table_id, rows, error) are what sources.files.scan and the data
source of sources.docx give. Every step is the operator of its own module; here they are put together
to one record a document: its metadata, and lists of its metrics, tables, relationships and actions. A
document whose file could not be read has no record; its error stays in `failed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from . import metadata as M
from . import tables as T
from . import textops as TX
from . import warehouse as W


def pages_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text, n_tables) of the documents that could be read."""
    line = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))
    g = blocks.filter("error is null").groupBy(F.col("path").alias("doc_id"), "page").agg(F.array_sort(F.collect_list(line)).alias("l"), F.count_if(F.col("kind") == "table").cast("int").alias("n_tables"))
    return g.select("doc_id", "page", F.array_join("l.text", "\n").alias("text"), "n_tables")


def failed(blocks: DataFrame) -> DataFrame:
    return blocks.filter("error is not null").select(F.col("path").alias("doc_id"), "error")


def matrices_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, table_id, table_title, headers, rows, page_ref): the first row is the header."""
    t = blocks.filter("error is null and kind = 'table' and size(rows) > 0")
    return t.select(F.col("path").alias("doc_id"), "ord", "table_id", F.lit(None).cast("string").alias("table_title"), F.get("rows", F.lit(0)).alias("headers"), F.expr("slice(rows, 2, greatest(size(rows) - 1, 0))").alias("rows"), F.col("page").alias("page_ref"))


def listed(rows: DataFrame, name: str, kind: StructType, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """(doc_id, name): a document's facts in order, in the fields that a stored report has."""
    made = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), kind)  # fields without a value are null
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, made.alias("fact")))).alias("l"))  # one document's facts
    return g.select("doc_id", F.transform("l", lambda x: x["fact"]).alias(name))


def fact(name: str) -> StructType:
    """The schema of one entry of a list of level2_details."""
    return StructType.fromDDL(W.REPORT)["level2_details"].dataType[name].dataType.elementType


def report_records(blocks: DataFrame) -> DataFrame:
    """(doc_id, metadata, level2_details, raw_text, ord): one record a readable document, as W.save_reports
    takes them. Metrics are those of the text, then of summary rows; loosely worded ones where it has none."""
    pages = pages_of(blocks)
    text = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("l"))
    docs = text.select("doc_id", F.array_join("l.text", "\n\n").alias("text"), F.get("l", F.lit(0))["text"].alias("page_one"))
    meta = M.document_metadata(pages)
    matrices = matrices_of(blocks)
    said = TX.metrics(docs)
    counted = T.summary_metrics(matrices).select("doc_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("at"), "row_index", "indicator", "actual", "plan_target", "percentage", F.lit(None).cast("string").alias("unit"), F.lit("GREEN").alias("status"), F.lit("ON_DINH").alias("trend"), "page_ref", "quote")
    shape = lambda d, plan: d.select("doc_id", F.lit(0).alias("part"), F.col("n").cast("long").alias("at"), F.lit(0).alias("row_index"), "indicator", "actual", plan.alias("plan_target"), "percentage", "unit", "status", "trend", F.lit(1).alias("page_ref"), "quote")
    some = shape(said, F.col("plan_target")).unionByName(counted)
    loose = TX.fallback_metrics(docs, some)
    every = some.unionByName(shape(loose, F.lit(None).cast("string")))
    name = lambda c: F.col(c)
    lists = [
        listed(every, "metrics", fact("metrics"), ["part", "at", "row_index"], {c: name(c) for c in ("indicator", "plan_target", "actual", "percentage", "unit", "status", "trend", "page_ref", "quote")}),
        listed(T.valid_tables(matrices), "tables", fact("tables"), ["n"], {c: name(c) for c in ("table_title", "headers", "rows", "row_count", "col_count", "page_ref")}),
        listed(TX.relationships(docs), "relationships", fact("relationships"), ["n"], {c: name(c) for c in ("issue", "cause", "impact", "severity")}),
        listed(TX.actions_or_default(docs, meta.select("doc_id", "document_title")), "actions_next_period", fact("actions_next_period"), ["n"], {"action_title": name("action_title")}),
    ]
    out = docs.join(meta, "doc_id")
    for d in lists:
        out = out.join(d, "doc_id", "left")
    domain = S.primary_domain(F.col("page_one"), F.col("text"))
    m = F.struct("document_title", "document_type", "document_number", "issuing_authority", "receiving_authority", "issuance_date", "reporting_period", domain["name"].alias("primary_domain"), S.domain_tags(F.col("text")).alias("domain_tags"))
    none = F.array().cast(f"array<{fact('action_items').simpleString()}>")
    details = F.struct("metrics", "tables", "relationships", none.alias("action_items"), "actions_next_period")
    return out.select("doc_id", m.alias("metadata"), details.alias("level2_details"), F.col("text").alias("raw_text"), F.col("doc_id").alias("ord"))


def process_folder(spark: SparkSession, folder: str, warehouse: str, batch_id: str | int | None = None) -> DataFrame:
    """Read a folder's documents, extract them and store what is new; the errors of those that could not
    be read."""
    from ..sources import files

    blocks = files.scan(spark, folder)
    W.save_reports(spark, report_records(blocks), "raw_text", warehouse, batch_id)
    return failed(blocks)


# ------------------------------------------------------------------------ the flat form of earlier consumers

CATEGORIES = [("KTXH_TONG_HOP", ["kinh tế", "ktxh"]), ("TAI_CHINH_DAU_TU", ["ngân sách", "đầu tư", "quyết toán"]), ("CCHC_TCD_PCTN", ["cải cách", "cchc", "khiếu nại", "tiếp công dân"])]  # fixed values: words of titles


def report_category(title: Column) -> Column:
    """The category of a report by its title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return S.first_case([(S.has_any(low, words), code) for code, words in CATEGORIES], "CHUYEN_NGANH")


def legacy_report(records: DataFrame) -> DataFrame:
    """Records in the flat form (P8): doc_id, metadata, executive_brief, indicators, tables, bottlenecks."""
    m, d = F.col("metadata"), F.col("level2_details")
    or_ = S.or_default
    some = lambda c: F.coalesce(c, F.array().cast(records.select(c.alias("x")).schema["x"].dataType))
    level = lambda x: F.when(x.isin("CRITICAL", "NGHIEM_TRONG"), "NGHIEM_TRONG").when(x.isin("HIGH", "CAO"), "CAO").otherwise("TRUNG_BINH")
    indicators = F.transform(some(d["metrics"]), lambda x: F.struct(x["indicator"].alias("indicator_name"), x["plan_target"].alias("target_value"), F.coalesce(x["actual"], F.lit("")).alias("actual_value"), x["unit"].alias("unit"), or_(x["trend"], "ON_DINH").alias("trend"), F.when(x["status"].isin("RED", "YELLOW"), x["status"]).otherwise("GREEN").alias("status"), F.coalesce(F.nullif(x["page_ref"], F.lit(0)), F.lit(1)).alias("page_ref"), x["quote"].alias("quote")))
    tables = F.transform(some(d["tables"]), lambda x: F.struct(or_(x["table_title"], "Bảng số liệu").alias("table_title"), x["headers"].alias("headers"), x["rows"].alias("rows"), F.coalesce(F.nullif(x["page_ref"], F.lit(0)), F.lit(1)).alias("page_ref")))
    problems = F.transform(some(d["relationships"]), lambda x: F.struct(F.lit("Hành chính").alias("domain"), x["issue"].alias("issue"), or_(x["cause"], "Khó khăn trong quá trình triển khai").alias("root_cause"), level(x["severity"]).alias("impact_severity"), F.lit(1).alias("page_ref")))
    flat = records.select("doc_id", "metadata", indicators.alias("indicators"), tables.alias("tables"), problems.alias("bottlenecks"))
    head = F.struct(
        or_(m["document_title"], "Báo cáo tổng hợp").alias("report_title"), or_(m["issuing_authority"], "UBND").alias("issuing_authority"), m["issuance_date"].alias("issuance_date"), report_category(m["document_title"]).alias("report_category"),
        or_(m["reporting_period"], "Kỳ báo cáo").alias("report_period"), or_(m["document_number"], "Chưa ghi số").alias("document_number"),
    )
    bad = F.exists("bottlenecks", lambda x: x["impact_severity"] == "NGHIEM_TRONG")
    brief = F.struct(F.when(bad, "CANH_BAO_DO").otherwise("HOAN_THANH_TOT").alias("overall_rating"), F.lit("Báo cáo tổng hợp tình hình thực hiện nhiệm vụ").alias("headline"), F.transform(F.slice("bottlenecks", 1, 3), lambda x: x["issue"]).alias("critical_warnings"))
    return flat.select("doc_id", head.alias("metadata"), brief.alias("executive_brief"), "indicators", "tables", "bottlenecks")
