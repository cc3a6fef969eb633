"""Warehouse operators: report documents to five flat tables, de-duplicated, and back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

REPORT = """metadata struct<document_title:string, document_type:string, document_number:string, issuing_authority:string,
 receiving_authority:string, issuance_date:string, reporting_period:string, primary_domain:string, domain_tags:array<string>>,
 level2_details struct<
 metrics:array<struct<indicator:string, plan_target:string, actual:string, percentage:string, unit:string, status:string, trend:string, page_ref:int, quote:string>>,
 tables:array<struct<table_title:string, headers:array<string>, rows:array<array<string>>, row_count:int, col_count:int, page_ref:int>>,
 relationships:array<struct<problem:string, issue:string, root_cause:string, cause_description:string, cause:string, consequence:string, impact:string, urgency:string, severity:string, responsible_agency:string, responsible_party:string>>,
 action_items:array<struct<task_title:string, action_title:string, lead_assignee:string, owner_department:string, deadline:string, status:string>>,
 actions_next_period:array<struct<task_title:string, action_title:string, lead_assignee:string, owner_department:string, deadline:string, status:string>>>"""
TABLES = ("reports", "report_metrics", "report_tables", "report_bottlenecks", "report_tasks")


def dedup_by_hash(rows: DataFrame, content: Column, order: Column, known: DataFrame | None = None) -> DataFrame:
    """The first row of each content hash, less hashes that are already stored (J4). An
    aggregation, so a hot hash is combined before the shuffle."""
    hashed = rows.withColumn("file_hash_sha256", S.content_hash(content))
    if known is not None:
        hashed = hashed.join(known.select("file_hash_sha256").distinct(), "file_hash_sha256", "left_anti")
    first = hashed.groupBy("file_hash_sha256").agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], "file_hash_sha256")


def with_record_id(reports: DataFrame) -> DataFrame:
    """A stable id from the content hash."""
    return reports.withColumn("report_id", F.concat(F.lit("rec-"), F.substring("file_hash_sha256", 1, 16)))


def fan_out(reports: DataFrame) -> dict[str, DataFrame]:
    """report_id, metadata, level2_details, file_hash_sha256 -> the five tables.
    Both field vocabularies of relationships and actions are read."""
    m, d = F.col("metadata"), F.col("level2_details")
    base = reports.withColumn("authority", S.or_default(m["issuing_authority"], "UBND")).withColumn("issued", m["issuance_date"])
    key = lambda prefix: F.concat(F.lit(f"{prefix}-"), F.col("report_id"), F.lit("-"), F.col("pos") + 1).alias("id")
    head = reports.select(
        F.col("report_id").alias("id"),
        S.or_default(m["document_title"], "Báo cáo hành chính").alias("document_title"),
        S.or_default(m["document_type"], "BAO_CAO").alias("document_type"),
        m["document_number"].alias("document_number"),
        S.or_default(m["issuing_authority"], "UBND").alias("issuing_authority"),
        m["receiving_authority"].alias("receiving_authority"),
        m["issuance_date"].alias("issuance_date"),
        m["reporting_period"].alias("reporting_period"),
        S.or_default(m["primary_domain"], "Hành chính tổng hợp").alias("primary_domain"),
        F.coalesce(m["domain_tags"], F.array().cast("array<string>")).alias("domain_tags"),
        "file_hash_sha256",
        F.lit("SYNCED").alias("status"),
    )
    x = F.col("x")
    metrics = base.select("report_id", "authority", "issued", m["reporting_period"].alias("period"), F.posexplode(d["metrics"]).alias("pos", "x")).select(
        key("rm"), "report_id", F.col("authority").alias("issuing_authority"), F.col("issued").alias("issuance_date"), F.col("period").alias("reporting_period"), x["indicator"].alias("indicator_name"),
        x["plan_target"].alias("plan_target"), x["actual"].alias("actual_value"), x["percentage"].alias("percentage"), x["unit"].alias("unit"),
        S.or_default(x["status"], "GREEN").alias("status"), S.or_default(x["trend"], "ON_DINH").alias("trend"), F.coalesce(F.nullif(x["page_ref"], F.lit(0)), F.lit(1)).alias("page_ref"), x["quote"].alias("quote"),
    )
    tables = base.select("report_id", F.posexplode(d["tables"]).alias("pos", "x")).select(
        key("rt"), "report_id", S.or_default(x["table_title"], F.concat(F.lit("Bảng "), F.col("pos") + 1)).alias("table_title"), x["headers"].alias("headers"),
        F.coalesce(x["row_count"], F.size(x["rows"])).alias("row_count"), F.coalesce(x["col_count"], F.size(x["headers"])).alias("col_count"), F.coalesce(F.nullif(x["page_ref"], F.lit(0)), F.lit(1)).alias("page_ref"),
    )
    some = lambda *c: F.coalesce(*[F.nullif(x[k], F.lit("")) for k in c])
    problem = F.coalesce(some("problem", "issue"), F.lit("Khó khăn vướng mắc"))
    cause = some("root_cause", "cause_description", "cause")
    bottlenecks = base.select("report_id", "authority", "issued", F.posexplode(d["relationships"]).alias("pos", "x")).select(
        key("rb"), "report_id", F.col("authority").alias("issuing_authority"), F.col("issued").alias("issuance_date"), problem.alias("problem"), cause.alias("root_cause"), some("consequence", "impact").alias("consequence"),
        S.bottleneck_category(F.concat_ws(" ", problem, cause)).alias("category"), F.coalesce(some("urgency", "severity"), F.lit("MEDIUM")).alias("urgency"), some("responsible_agency", "responsible_party").alias("responsible_agency"),
    )
    actions = F.when(F.size(F.coalesce(d["action_items"], F.array().cast(reports.schema["level2_details"].dataType["action_items"].dataType))) > 0, d["action_items"]).otherwise(d["actions_next_period"])
    tasks = base.select("report_id", "authority", F.posexplode(actions).alias("pos", "x")).select(
        key("rtk"), "report_id", F.col("authority").alias("issuing_authority"), some("task_title", "action_title").alias("task_title"), some("lead_assignee", "owner_department").alias("lead_assignee"), x["deadline"].alias("deadline"), F.coalesce(some("status"), F.lit("PENDING")).alias("completion_status"),
    )
    return dict(zip(TABLES, (head, metrics, tables, bottlenecks, tasks), strict=True))


def index_rows(reports: DataFrame) -> DataFrame:
    """The catalogue row of each report."""
    m, d = F.col("metadata"), F.col("level2_details")
    n = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return reports.select(F.col("report_id").alias("record_id"), S.or_default(m["document_title"], "Báo cáo hành chính").alias("document_title"), S.or_default(m["issuing_authority"], "UBND").alias("issuing_authority"), m["issuance_date"].alias("issuance_date"),
        S.or_default(m["primary_domain"], "Hành chính tổng hợp").alias("primary_domain"), F.coalesce(m["domain_tags"], F.array().cast("array<string>")).alias("domain_tags"), n(d["metrics"]).alias("indicators_count"), n(d["tables"]).alias("tables_count"), n(d["relationships"]).alias("relationships_count"), "file_hash_sha256")


def replace_slice(table: DataFrame, fresh: DataFrame, key: str = "report_id") -> DataFrame:
    """Delete the fresh rows' keys from a table, then add the rows."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_reports(spark: SparkSession, reports: DataFrame, raw_text: str, path: str, batch_id: str | int | None = None) -> None:
    """Store new reports under a path: de-duplicated by text against what is there.

    Each call writes one partition `batch` of every table, child tables first and `reports` last:
    that last write commits the batch. A call that failed before it left nothing that readers
    see, and the same batch, saved again, overwrites its own leavings; a committed batch is not
    written twice. A stream passes its batch number, so replays are harmless."""
    batch = str(batch_id) if batch_id is not None else uuid.uuid4().hex
    if exists(spark, f"{path}/reports/batch={batch}/_SUCCESS"):
        return
    known = read_table(spark, path, "reports", "file_hash_sha256 string")
    fresh = with_record_id(dedup_by_hash(reports, F.coalesce(F.col(raw_text), F.to_json("metadata")), F.col("ord"), known)).persist()
    parts = fan_out(fresh)
    for name in [*TABLES[1:], TABLES[0]]:
        parts[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    fresh.unpersist()


def read_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The committed rows of a stored table; one that was never written is empty."""
    if not exists(spark, f"{path}/{name}") or not exists(spark, f"{path}/reports"):
        return spark.createDataFrame([], schema)
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/reports")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(f.getPath()) for f in files.listStatus(top) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]  # one a batch
    at = [f"{path}/{name}/{x.rsplit('/', 1)[-1]}" for x in done]
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def shaped_pages(pages: DataFrame) -> DataFrame:
    """Pages as a reader is shown them, with their number of tables."""
    return pages.select("doc_id", F.col("page").alias("page_number"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"), "text", F.coalesce(F.size("tables"), F.lit(0)).alias("tables_count"))


def newest_first(index: DataFrame, time: str = "synced_at", order: str = "ord") -> DataFrame:
    """The index as it is listed: what was stored last stands first."""
    return index.orderBy(F.desc(time), F.desc(order))


def get_report(reports: DataFrame, report_id: str) -> DataFrame:
    return reports.filter(F.col("id") == report_id).limit(1)


def contains_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Case-insensitive substring filters; an empty one filters nothing (F1)."""
    for c, q in wanted.items():
        if q:
            rows = rows.filter(F.contains(F.lower(F.col(c)), F.lower(F.lit(q))))
    return rows


def domain_filter(rows: DataFrame, query: str | None, domain: str = "primary_domain", tags: str = "domain_tags") -> DataFrame:
    """Domain name or any tag (F2)."""
    if not query:
        return rows
    q = F.lower(F.lit(query))
    return rows.filter(F.contains(F.lower(domain), q) | F.exists(tags, lambda t: F.contains(F.lower(t), q)))


def date_range(rows: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows in a range; a null date passes."""
    c = F.col(column)
    if start:
        rows = rows.filter(c.isNull() | (c >= start))
    if end:
        rows = rows.filter(c.isNull() | (c <= end))
    return rows


def page(rows: DataFrame, order: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    """A page with the total before paging; 0 means the default of 50 (O4). The total is an
    aggregate of its own, so no window sorts all rows in one task."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset or 0).limit(limit or 50).join(F.broadcast(total))  # one row
