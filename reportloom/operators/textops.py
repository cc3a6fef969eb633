"""Text operators: lines, stitching, sections, pages, extraction, location, document parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, line: every line with its place."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "line")).withColumn("line", S.web_trim(F.col("line")))


#: So many rows a task at most, where rows are dealt out before costly steps.
SPREAD_ROWS = 50_000


def spread(rows: DataFrame, key: str, most: int = SPREAD_ROWS) -> DataFrame:
    """The rows dealt by key over all cores, and over more tasks the more there are. Files are read in few
    splits, and adaptive execution merges partitions whose compressed rows are small, however much work
    or memory they need; a number that is asked for stays."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most)), key)


# A line is joined to the one before it unless that ended a sentence or the line holds a
# list mark. The three alternatives bind loosely, so a number or "(x)" anywhere counts.
LIST_MARK = r"^[-*•+]|\d+\.|\([a-z0-9]+\)"


def stitch(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of broken sentences joined (V4): gaps and islands over one ordered window."""
    w = Window.partitionBy(key).orderBy("ord")
    before = F.lag("line").over(w)
    starts = before.isNull() | (before == "") | before.rlike("[:.?!;]$") | F.col("line").rlike(S.web_regex(LIST_MARK))
    groups = rows.withColumn("start", starts.cast("int")).withColumn("island", F.sum("start").over(w))
    joined = groups.groupBy(key, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), " ").alias("line"))
    return joined.filter("line <> ''").select(key, F.col("island").alias("ord"), "line")


def outside_section(rows: DataFrame, opens: Column, closes: Column, key: str = "doc_id") -> DataFrame:
    """Lines not between an opening and the next closing line."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(F.when(closes, False).when(opens, True), ignorenulls=True).over(w), F.lit(False))
    return rows.withColumn("inside", state).filter(~F.col("inside")).drop("inside")


def first_k(rows: DataFrame, k: int, key: str = "doc_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first k rows of each document."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= k)


# fixed values: patterns of the extractor
BACKGROUND = r"^(?:I|1)\.\s*(?:ĐẶC ĐIỂM TÌNH HÌNH|BỐI CẢNH VĨ MÔ|ĐIỀU KIỆN TỰ NHIÊN|TỔNG QUAN VỀ ĐỊA BÀN)\b"
RESULTS = r"^(?:II|2|[I|V|X]+)\.\s*(?:KẾT QUẢ|TÌNH HÌNH THỰC HIỆN|NHIỆM VỤ|CÔNG TÁC|KẾ HOẠCH|ĐÁNH GIÁ)"
UNITS = "%|tỷ đồng|triệu đồng|nghìn đồng|ha|m2|hộ|người|vụ|vụ việc|hồ sơ|văn bản|nhiệm vụ|dự án|công trình|km|lượt|tthc|thủ tục"
VALUE = r"([0-9.,]+(?:\/[0-9.,]+)?)"
COLON = rf"^[-*•+]?\s*([^:]{{3,120}}):\s*(?:đạt\s*)?{VALUE}\s*({UNITS})?"
SUBJECTS = "thu ngân sách|chi ngân sách|giải ngân|vốn đầu tư|nhiệm vụ|chỉ tiêu|diện tích|số hộ|hồ sơ|tỷ lệ|sản lượng|doanh thu|kim ngạch|giá trị|biên chế|dự án|công trình"
VERBS = r"ước\s+đạt|đạt|thực hiện|hoàn thành|giải ngân được|thu được|chi|tăng|giảm"
NARRATIVE = rf"((?:tổng\s+)?(?:{SUBJECTS})[^,.;:\n]{{0,60}}?)\s+({VERBS})\s+{VALUE}\s*({UNITS})?"
REJECT = r"^(theo|căn cứ|tại|nghị định|quyết định|thông tư|luật|nghị quyết)\b|(?:ủy\s*ban|uỷ\s*ban|ubnd)\s+nhân\s+dân|\b(?:kính\s+gửi|nơi\s+nhận)\b|\bSố\s*:?\s*$"
BULLET = r"^[-*•+\d.)\s]+"


def metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Metric facts of stitched lines outside background sections."""
    docs = spread(docs.select(key, text), key)  # every window below keeps this partitioning
    body = outside_section(stitch(lines(docs, key, text), key), F.col("line").rlike(S.web_regex(BACKGROUND)), F.col("line").rlike(S.web_regex(RESULTS)), key)
    line, low = F.col("line"), F.lower("line")
    c, n = S.web_regex(COLON), S.web_regex(NARRATIVE)
    colon = F.regexp_extract(line, c, 2) != ""
    pick = lambda i, j: F.when(colon, F.regexp_extract(line, c, i)).otherwise(F.regexp_extract(line, n, j))
    unit = F.nullif(F.trim(pick(3, 4)), F.lit(""))
    value = F.trim(pick(2, 3))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(pick(1, 1)), S.web_regex(BULLET), ""), r"^\)+", ""))
    share = F.nullif(F.regexp_extract(line, r"([0-9.,]+)\s*%", 1), F.lit(""))
    estimate = S.has_any(low, ["ước", "dự kiến"])
    plan = S.has_any(low, ["kế hoạch", "chỉ tiêu", "dự toán"])
    found = body.select(
        key, "ord", name.alias("indicator"), value.alias("actual"), F.when(plan, value).alias("plan_target"), F.when(unit == "%", value).otherwise(share).alias("percentage"), unit.alias("unit"),
        F.when(estimate, "UOC_THUC_HIEN").when(plan, "KE_HOACH").otherwise("THUC_HIEN_THUC_TE").alias("data_nature"),
        F.when(S.has_any(low, ["đạt", "tăng"]), "GREEN").when(low.contains("giảm"), "RED").otherwise("GREEN").alias("status"),
        F.when(low.contains("tăng"), "TANG_TRUONG").when(low.contains("giảm"), "GIAM_SUT").otherwise("ON_DINH").alias("trend"), line.alias("quote"),
    )
    found = found.filter((F.col("actual") != "") & (F.length("indicator") >= 4) & ~F.col("indicator").rlike(S.web_regex(REJECT)) & ~F.lower("indicator").rlike("ngày|tháng|năm"))
    return first_k(found.withColumn("name_key", F.lower("indicator")).withColumn("dup", F.row_number().over(Window.partitionBy(key, "name_key", "actual").orderBy("ord"))).filter("dup = 1").drop("dup", "name_key"), 2**31 - 1, key)


def keyword_lines(docs: DataFrame, pattern: str, low: int, high: int, cap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that match and whose length lies strictly between, first `cap` of a document."""
    sized = lambda x: (F.length(x) > low) & (F.length(x) < high)  # noqa: E731  tested first: it costs least
    fits = lambda x: F.when(sized(x["line"]), x["line"].rlike(S.web_regex(pattern))).otherwise(False)
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("ord"), S.web_trim(x).alias("line")))
    kept = F.slice(F.filter(every, fits), 1, cap)  # a document's lines are one array: no shuffle, no window
    return docs.select(key, F.posexplode(kept).alias("at", "x")).select(key, F.col("x.ord").alias("ord"), F.col("x.line").alias("line"), (F.col("at") + 1).alias("n"))


PROBLEM = "khó khăn|vướng mắc|tồn tại|hạn chế|chưa đạt|chậm tiến độ|khiếu nại|vi phạm|vấn đề|trở ngại"
ACTION = "^(?:tiếp tục|tăng cường|tập trung|đẩy mạnh|khẩn trương|chủ động|phối hợp|rà soát|triển khai|hoàn thiện|đôn đốc|thực hiện)"
RECOMMEND = "^(?:kiến nghị|đề nghị|kính đề nghị|đề xuất)"
ACHIEVE = r"(?:hoàn thành|đạt kết quả|tăng trưởng|tích cực|kịp thời|hiệu quả|bảo đảm|đáp ứng)[^.\n]{10,120}\."


def relationships(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Problem lines with severity, cause and impact."""
    rows = keyword_lines(docs, PROBLEM, 15, 250, 6, key, text)
    line, low = F.col("line"), F.lower("line")
    cause = F.regexp_extract(line, S.web_regex(r"(?:nguyên nhân là do|nguyên nhân do|chủ yếu do|do|bởi vì)\s+([^,.;]+)"), 1)
    impact = F.regexp_extract(line, S.web_regex(r"((?:dẫn đến|gây ra|làm|ảnh hưởng đến|chưa đáp ứng)\s+[^,.;]+)"), 1)
    return rows.select(
        key, "n", F.regexp_replace(line, S.web_regex(BULLET), "").alias("issue"),
        F.when(S.has_any(low, ["nghiêm trọng", "cấp bách", "khiếu kiện đông người"]), "CRITICAL").when(S.has_any(low, ["chậm", "chưa giải quyết", "thiếu"]), "HIGH").otherwise("MEDIUM").alias("severity"),
        F.when(cause != "", F.concat(F.lit("Do "), F.trim(cause))).otherwise("Khó khăn khách quan và chủ quan trong quá trình triển khai thực tế").alias("cause"),
        F.when(impact != "", F.trim(impact)).otherwise("Ảnh hưởng đến tiến độ và mục tiêu chung của đơn vị").alias("impact"),
    )


def actions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return keyword_lines(docs, ACTION, 15, 200, 6, key, text).select(key, "n", F.col("line").alias("action_title"))


def recommendations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return keyword_lines(docs, RECOMMEND, 15, 250, 4, key, text).select(key, "n", F.col("line").alias("request_content"))


FREE_METRIC = rf"^[-*•+]?\s*([^,.;:]{{4,60}})\s+(?:đạt|là|khoảng|có|được)\s+{VALUE}\s*({UNITS})?"


def fallback_metrics(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to three loosely worded metrics of the documents without any in `found`."""
    p = S.web_regex(FREE_METRIC)
    rows = first_k(lines(docs.join(found.select(key).distinct(), key, "left_anti"), key, text).filter(F.col("line").rlike(p)), 3, key)
    part = lambda i: F.trim(F.regexp_extract("line", p, i))
    unit = F.nullif(part(3), F.lit(""))
    return rows.select(key, "n", "ord", part(1).alias("indicator"), part(2).alias("actual"), F.when(unit == "%", part(2)).alias("percentage"), unit.alias("unit"), F.lit("THUC_HIEN_THUC_TE").alias("data_nature"), F.lit("GREEN").alias("status"), F.lit("ON_DINH").alias("trend"), F.col("line").alias("quote"))


def actions_or_default(docs: DataFrame, titles: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The actions, bullets removed; one made from the title where a document has none."""
    got = actions(docs, key, text).select(key, "n", F.regexp_replace("action_title", S.web_regex(BULLET), "").alias("action_title"), F.lit("PHYSICAL").alias("provenance"))
    rest = titles.join(got.select(key).distinct(), key, "left_anti")
    return got.union(rest.select(key, F.lit(1), F.concat(F.lit("Tổ chức triển khai các nhiệm vụ, giải pháp trọng tâm theo "), "document_title"), F.lit("SYNTHETIC")))


def decisions_needed(docs: DataFrame, recs: DataFrame, key: str = "doc_id") -> DataFrame:
    """What each document asks its reader to decide, from its first recommendation."""
    first = recs.groupBy(key).agg(F.min_by("request_content", "n").alias("asked"))
    has = F.col("asked").isNotNull()
    return docs.select(key).join(first, key, "left").select(
        key, has.alias("is_required"), F.when(has, F.concat(F.lit("Xem xét phê duyệt kiến nghị: "), F.regexp_replace("asked", S.web_regex(BULLET), ""))).otherwise("Báo cáo theo dõi phục vụ chỉ đạo điều hành").alias("decision_summary"),
        F.when(has, "XEM_XET_CHO_CHU_TRUONG").otherwise("BAO_CAO_DE_BIET").alias("action_verb"), F.when(has, "Trước kỳ họp điều hành kế tiếp").alias("deadline"),
    )


# fixed values: words of marks printed across a page, and of rows left over from tables
MARKS = r"dự\s*thảo|tài\s*liệu\s*mật|tuyệt\s*mật|tối\s*mật|mật|bản\s*lưu|confidential|draft|sample\s*document|watermark|dấu\s*chìm|bản\s*nháp|camscanner|adobe\s*scan|scanned\s*by"
RESIDUE = r"^\[Bảng:\s*[^\]]+\]|^TT\s*\|\s*CHỈ TIÊU|^(?:BIỂU|BẢNG|PHỤ LỤC)\s*[:.]\s*KẾT QUẢ THỰC HIỆN CÁC CHỈ TIÊU"


def without_marks(text: Column) -> Column:
    """Text without invisible characters and without short lines that hold a mark."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[\u00ad\u200b\ufeff]", ""), "\u00a0", " ")
    keep = lambda x: (S.web_trim(x) == "") | (F.length(S.web_trim(x)) >= 25) | ~x.rlike(S.web_regex(MARKS))
    return F.array_join(F.filter(F.split(plain, "\n"), keep), "\n")


def body_lines(text: Column) -> Column:
    """Trimmed lines of a text that are neither empty nor left over from a table (F8)."""
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    residue = lambda x: x.rlike(S.web_regex(RESIDUE)) | (bars(x) >= 2) | x.startswith("|") | x.rlike(r"[-*•]\s*\|")
    return F.filter(F.transform(F.split(without_marks(text), "\n"), S.web_trim), lambda x: (x != "") & ~residue(x))


def achievements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(text, F.lit(S.web_regex(ACHIEVE)), F.lit(0))
    return docs.select(key, F.posexplode(F.slice(found, 1, 5)).alias("n", "achievement_title"))


def locate_snippets(snippets: DataFrame, pages: DataFrame, key: str = "doc_id", least: float = 0.4) -> DataFrame:
    """snippets (key, sid, snippet), pages (key, page, text) -> the page of each snippet: one
    that holds its first 20 characters, else the best token overlap, else none (J6, O6)."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= 3))
    s = snippets.withColumn("sn", S.normal_snippet(F.col("snippet"))).withColumn("st", tokens(F.col("sn")))
    p = pages.withColumn("pn", S.normal_snippet(F.col("text"))).withColumn("pt", tokens(F.col("pn"))).select(key, "page", "pn", "pt")
    both = s.join(p, key)
    exact = both["pn"].contains(F.substring("sn", 1, 20))
    share = F.when(F.size("st") >= 2, F.size(F.array_intersect("st", "pt")) / F.size("st")).otherwise(0.0)
    scored = both.select(key, "sid", "page", exact.alias("exact"), share.alias("overlap")).filter(F.col("exact") | (F.col("overlap") >= least))
    best = scored.groupBy(key, "sid").agg(F.min_by(F.struct("page", "exact", "overlap"), F.struct(~F.col("exact"), F.when(F.col("exact"), 0.0).otherwise(-F.col("overlap")), "page")).alias("b"))
    return snippets.select(key, "sid").join(best, [key, "sid"], "left").select(key, "sid", F.col("b.page").alias("page"), F.when(F.col("b.exact"), "EXACT").when(F.col("b.page").isNotNull(), "OVERLAP").otherwise("FALLBACK").alias("tier"))


# ------------------------------------------------------------- sequential operators


def pack_pages(rows: DataFrame, key: str = "doc_id", full: int = 2200, section: int = 800, heading: str = r"^([IVX]+|\d+)\.") -> DataFrame:
    """key, ord, line -> key, ord, page: a page ends at `full` characters, or at `section` when
    a section begins (V6). The reset is a fold over each document's lines, in order."""
    item = F.struct(F.col("ord"), F.length("line").alias("size"), F.col("line").rlike(heading).alias("head"))
    seq = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("seq"))  # one document's lines
    start = F.struct(F.lit(0).alias("held"), F.array().cast("array<int>").alias("breaks"))

    def step(acc, x):
        flush = (acc["held"] > 0) & ((acc["held"] + x["size"] > full) | (x["head"] & (acc["held"] >= section)))
        breaks = F.when(flush, F.concat(acc["breaks"], F.array(x["ord"].cast("int")))).otherwise(acc["breaks"])
        return F.struct((F.when(flush, 0).otherwise(acc["held"]) + x["size"]).alias("held"), breaks.alias("breaks"))

    found = seq.select(key, F.transform("seq", lambda x: x["ord"]).alias("ords"), F.aggregate("seq", start, step, lambda a: a["breaks"]).alias("breaks"))
    spread = found.select(key, "breaks", F.explode("ords").alias("ord"))
    return spread.select(key, "ord", (F.size(F.filter("breaks", lambda b: b <= F.col("ord"))) + 1).alias("page"))


CONTINUES = r"^(?:[IVXLCDM]+|\d+|[a-zđ]\))\b|^$"


def stitch_tables(tables: DataFrame) -> DataFrame:
    """tables (doc_id, ord, page if known, headers, rows; the header row apart) -> master tables continued over
    pages (V7). A table continues the master before it if it has as many columns and its first row
    repeats the master's headers or starts like a data row; a repeated header row goes, another first
    row is data; a row with an empty first cell flows into the row before it.

    The master carried along is a fold over one document's tables; documents are independent."""
    cell = lambda x: F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" "))
    clean = lambda r: F.transform(r, cell)
    page = F.col("page") if "page" in tables.columns else F.lit(None).cast("int")
    item = F.struct("ord", page.alias("page"), clean(F.col("headers")).alias("h"), F.transform("rows", clean).alias("r"))
    seq = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("seq"))
    master = "struct<headers:array<string>,rows:array<array<string>>,pages:array<int>,pieces:int>"
    start = F.struct(F.array().cast(f"array<{master}>").alias("done"), F.lit(None).cast(master).alias("now"))
    filled = lambda rows: F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))

    def flow(rows, extra):
        """Rows with the extra ones added, overflowing rows joined to the row before them."""

        def add(acc, r):
            last = F.element_at(acc, -1)
            joined = F.transform(last, lambda x, i: F.when((i >= 1) & (F.coalesce(F.get(r, i), F.lit("")) != ""), F.trim(F.concat(x, F.when(i == 1, " ").otherwise("; "), F.get(r, i)))).otherwise(x))
            spills = (F.get(r, F.lit(0)) == "") & (F.size(acc) > 0)
            return F.when(spills, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

        return F.aggregate(extra, rows, add)

    def step(acc, x):
        now = acc["now"]
        same = S.header_similar(x["h"], now["headers"])
        goes_on = F.coalesce(now.isNotNull() & (F.size(x["h"]) == F.size(now["headers"])) & (same | F.get(x["h"], F.lit(0)).rlike(S.web_regex(CONTINUES))), F.lit(False))
        more = filled(F.when(same, x["r"]).otherwise(F.concat(F.array(x["h"]), x["r"])))
        grown = F.struct(now["headers"].alias("headers"), flow(now["rows"], more).alias("rows"), F.array_distinct(F.concat(now["pages"], F.array(x["page"].cast("int")))).alias("pages"), (now["pieces"] + 1).alias("pieces"))
        fresh = F.struct(x["h"].alias("headers"), filled(x["r"]).alias("rows"), F.array(x["page"].cast("int")).alias("pages"), F.lit(1).alias("pieces"))
        closed = F.when(goes_on | now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(closed.alias("done"), F.when(goes_on, grown).otherwise(fresh).alias("now"))

    every = F.aggregate("seq", start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return seq.select("doc_id", F.posexplode(every).alias("m", "t")).select("doc_id", (F.col("m") + 1).alias("master"), "t.headers", "t.rows", "t.pages", "t.pieces")


def watermarks(spans: DataFrame, keywords: list[str]) -> DataFrame:
    """spans (text, angle, page) -> texts that lie across the page or hold a keyword."""
    t = F.trim("text")
    g = spans.withColumn("text", t).filter(F.length("text") >= 4).groupBy("text").agg(F.count("*").alias("n"), F.max(F.abs("angle")).alias("tilt"), F.count_distinct("page").alias("pages"))
    return g.filter((F.col("tilt") > 10) | (S.has_any(F.lower("text"), keywords) & (F.length("text") <= 80)))


def dense_pages(pages: DataFrame) -> DataFrame:
    """Blank and page-number-only pages dropped, the others numbered without gaps."""
    t = F.trim(F.coalesce("text", F.lit("")))
    kept = pages.filter(~((t == "") | ((F.length(t) <= 5) & t.rlike(r"^\d+$"))) | (F.coalesce("n_tables", F.lit(0)) > 0))
    return kept.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))


def html_flow(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, tag, text of headings, paragraphs and tables in page order."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-6]|p|table)(?:\s[^>]*)?>.*?</\1>"), F.lit(0))
    x = F.col("x")
    body = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>|</(?:div|li|p|tr)>", "\n"), "<[^>]*>", "")
    return pages.select(key, F.posexplode(whole).alias("ord", "x")).select(key, "ord", F.lower(F.regexp_extract(x, r"^<(\w+)", 1)).alias("tag"), F.trim(F.regexp_replace(body, r"[ \t]*\n\s*", "\n")).alias("text"))
