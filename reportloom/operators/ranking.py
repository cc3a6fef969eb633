"""Priority cards, zero grouping, overall status, work items, legacy projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .analytics import distinct_in_order

CARD = ["doc_id", "rank", "seq", "title", "level", "colour"]
ZEROS = ["0", "0 lượt", "0 vụ"]
ZEROS_TOLD = [*ZEROS, "0 trường hợp"]


def cards(decisions: DataFrame, incidents: DataFrame, bottlenecks: DataFrame, recommendations: DataFrame, metrics: DataFrame, achievements: DataFrame, most: int = 8) -> DataFrame:
    """The first eight cards of a document by rank and place.
    Each input has (doc_id, ord, title) and bottlenecks severity, metrics actual and status."""
    plain = lambda d, rank, level, colour: d.select("doc_id", F.lit(rank).alias("rank"), F.col("ord").alias("seq"), "title", F.lit(level).alias("level"), F.lit(colour).alias("colour"))
    b = bottlenecks.withColumn("c", S.severity_card(F.col("severity"))).select("doc_id", "c.rank", F.col("ord").alias("seq"), "title", "c.level", "c.colour")
    m = metrics.filter(~F.col("actual").isin(ZEROS)).select("doc_id", F.lit(9).alias("rank"), F.col("ord").alias("seq"), "title", F.lit("INFO").alias("level"), S.metric_badge(F.col("status")).alias("colour"))
    said = decisions.groupBy("doc_id").agg(F.min_by("title", "ord").alias("said"))
    same = F.col("said").contains(F.substring("title", 1, 30)) | F.col("title").contains(F.substring("said", 1, 30))
    r = recommendations.join(said, "doc_id", "left").filter(~F.coalesce(same, F.lit(False)))
    parts = [plain(decisions, 1, "CRITICAL", "RED"), plain(incidents, 2, "CRITICAL", "RED"), b, plain(r, 7, "MEDIUM", "AMBER"), m, plain(achievements, 10, "INFO", "GREEN")]
    all_ = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("doc_id").orderBy("rank", "seq", "title")
    return all_.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def cards_with_fallback(shown: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """Cards of every document of counts (doc_id, metrics, actions); a document with fewer than
    `least` is filled up from the two summary cards, in their order (O3, X10)."""
    have = counts.join(shown.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    told = F.array(
        F.struct(F.lit(9).alias("rank"), F.concat(F.col("metrics").cast("string"), F.lit(" chỉ tiêu đã được số hóa và chuẩn hóa")).alias("title")),
        F.struct(F.lit(11).alias("rank"), F.concat(F.col("actions").cast("string"), F.lit(" nhiệm vụ tiếp theo")).alias("title")),
    )
    more = have.filter(F.col("n") < least).select("doc_id", "n", F.posexplode(told).alias("i", "x")).filter(F.col("n") + F.col("i") < least)
    filled = more.select("doc_id", F.col("x.rank").alias("rank"), F.col("i").cast("long").alias("seq"), F.col("x.title").alias("title"), F.lit("INFO").alias("level"), F.lit("BLUE").alias("colour"), (F.col("n") + F.col("i") + 1).cast("int").alias("place"))
    return shown.select(*CARD, "place").withColumn("seq", F.col("seq").cast("long")).unionByName(filled)


def zero_groups(metrics: DataFrame) -> DataFrame:
    """One sentence a document about its zero metrics, naming the first four."""
    rows = metrics.filter(F.col("actual").isin(ZEROS_TOLD))
    count = rows.groupBy("doc_id").agg(F.count_distinct("indicator").alias("zeros"))
    names = distinct_in_order(rows, ["doc_id"], "indicator", "ord", 4, "names")
    return count.join(names, "doc_id").select("doc_id", "zeros", F.array_join("names", ", ").alias("names"))


def overall_status(bottlenecks: DataFrame) -> DataFrame:
    """Traffic light of a document."""
    s = F.col("severity")
    return bottlenecks.groupBy("doc_id").agg(F.when(F.bool_or(s.isin("CRITICAL", "NGHIEM_TRONG")), "NGHIEM_TRONG").when(F.bool_or(s.isin("HIGH", "CAO", "MEDIUM")), "CAN_LUU_Y").otherwise("BINH_THUONG").alias("overall"))


def work_items(actions: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """Actions (doc_id, ord, action_title, owner_department, deadline) as work items (P10)."""
    rows = actions.filter(F.array_contains(F.array(*[F.lit(i) for i in chosen]), F.col("ord"))) if chosen else actions
    return rows.select("doc_id", F.col("action_title").alias("title"), F.concat(F.lit("Triển khai: "), "action_title").alias("description"), S.or_default(F.col("owner_department"), "Văn phòng").alias("assignee"), S.or_default(F.col("deadline"), "Trong kỳ").alias("due"), F.lit("NORMAL").alias("priority"))


def legacy_status(c: Column) -> Column:
    return F.when(c == "NEUTRAL", "GREEN").otherwise(c)


def legacy_severity(c: Column) -> Column:
    return F.when(c.isin("CRITICAL", "NGHIEM_TRONG"), "NGHIEM_TRONG").when(c.isin("HIGH", "CAO"), "CAO").otherwise("TRUNG_BINH")


def legacy_reports(bottlenecks: DataFrame, achievements: DataFrame) -> DataFrame:
    """The flat form of earlier consumers: rating, top three achievements and warnings."""
    def top(rows, name):
        ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "title"))).filter("n <= 3")
        return ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]), "; ").alias(name))

    rating = bottlenecks.groupBy("doc_id").agg(F.when(F.bool_or(legacy_severity(F.col("severity")) == "NGHIEM_TRONG"), "CANH_BAO_DO").otherwise("ON_DINH").alias("rating"))
    return rating.join(top(bottlenecks, "warnings"), "doc_id", "left").join(top(achievements, "achievements"), "doc_id", "left")
