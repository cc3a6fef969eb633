"""The older extraction rules, kept for consumers of their flat records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: rules in order, and what stands where nothing was found
RULES = [
    (r"thu ngân sách[^\n\d]*(\d+[\d.,]*\s*(?:tỷ|triệu|đồng|%))", "Thu ngân sách địa phương"),
    (r"chi ngân sách[^\n\d]*(\d+[\d.,]*\s*(?:tỷ|triệu|đồng|%))", "Chi ngân sách địa phương"),
    (r"giải ngân[^\n\d]*(\d+[\d.,]*\s*(?:%|tỷ|triệu))", "Tỷ lệ giải ngân vốn ĐTC"),
    (r"tiếp\s+(\d+)\s+lượt", "Lượt tiếp công dân"),
    (r"tiếp nhận[^\n\d]*(\d+)\s+hồ sơ", "Tổng số hồ sơ tiếp nhận"),
    (r"đạt\s*(\d+[\d.,]*\s*%)", "Tỷ lệ hoàn thành chỉ tiêu"),
    (r"diện tích[^\n\d]*(\d+[\d.,]*\s*(?:ha|m2))", "Diện tích sản xuất/quy hoạch"),
    (r"đúng hạn[^\n\d]*(\d+[\d.,]*\s*%)", "Tỷ lệ giải quyết đúng hạn"),
]
PROBLEM = r"(?:Tồn tại|Hạn chế|Khó khăn|Khuyết điểm)[:\s]+([\s\S]{50,400}?)(?=\n[I|V|X]+\.|\n\d+\.|\nPhần|$)"
PLANS = r"(?:Nhiệm vụ trọng tâm|Phương hướng|Kiến nghị|Đề xuất)[\s\S]{30,800}"
NOT_PLANS = ["BÁO CÁO", "Nơi nhận", "TM.", "CHỦ TỊCH"]


def legacy_metrics(pages: DataFrame, most: int = 6) -> DataFrame:
    """pages (doc_id, page, text) -> the first match of each rule in a document, `most` of them in
    order of page and rule; one placeholder for a document without any (S37)."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(name).alias("metric_name"), F.regexp_extract("text", S.web_regex(p), 1).alias("value"), F.regexp_extract("text", S.web_regex(p), 0).alias("quote")) for i, (p, name) in enumerate(RULES)])
    hits = pages.select("doc_id", "page", F.explode(F.filter(rules, lambda x: x["quote"] != "")).alias("x"))
    first = hits.groupBy("doc_id", "x.metric_name").agg(F.min_by(F.struct("page", "x.rule", "x.value", "x.quote"), F.struct("page", "x.rule")).alias("m"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("m.page", "m.rule"))).filter(F.col("n") <= most)
    value = S.web_trim(F.col("m.value"))
    number = F.trim(F.replace(F.replace(value, F.lit("%"), F.lit("")), F.lit(","), F.lit("."))).try_cast("double")
    found = ranked.select("doc_id", "n", "metric_name", value.alias("actual_value"), F.when(number < 70, "RED").otherwise("GREEN").alias("status"), F.col("m.page").alias("page_ref"), S.web_trim(F.col("m.quote")).alias("quote"))
    none = pages.select("doc_id").distinct().join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(none.select("doc_id", F.lit(1).alias("n"), F.lit("Tiến độ thực hiện nhiệm vụ").alias("metric_name"), F.lit("100%").alias("actual_value"), F.lit("GREEN").alias("status"), F.lit(1).cast("int").alias("page_ref"), F.lit("Hoàn thành nhiệm vụ").alias("quote")))


def legacy_records(docs: DataFrame) -> DataFrame:
    """docs (doc_id, title, text) -> overall evaluation, the one bottleneck and up to three tasks."""
    problem = F.substring(S.web_trim(F.replace(F.regexp_extract("text", S.web_regex(PROBLEM), 1), F.lit("\n"), F.lit(" "))), 1, 200)
    plans = F.filter(F.transform(F.split(F.regexp_extract("text", S.web_regex(PLANS), 0), "\n"), S.web_trim), lambda x: (F.length(x) > 25) & ~S.has_any(x, NOT_PLANS))
    task = lambda x, i: F.struct(F.substring(F.regexp_replace(x, rf"^[-•*0-9.]+{S.SPACE_CLASS}*", ""), 1, 100).alias("task_title"), F.when(i == 0, "HIGH").otherwise("NORMAL").alias("priority"))
    made = F.array(F.struct(F.concat(F.lit("Tổ chức triển khai phương hướng nhiệm vụ của báo cáo "), F.substring("title", 1, 50)).alias("task_title"), F.lit("HIGH").alias("priority")))
    tasks = F.transform(F.slice(plans, 1, 3), task)
    return docs.select("doc_id", F.when(problem != "", "NEEDS_ATTENTION").otherwise("GOOD").alias("overall_evaluation"), F.nullif(problem, F.lit("")).alias("bottleneck"), F.when(F.size(tasks) > 0, tasks).otherwise(made).alias("tasks"))
