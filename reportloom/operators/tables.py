"""Table-matrix operators: cells in long form, audits, quality filter, roles, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def clean_cells(rows: Column) -> Column:
    """Line breaks to spaces, runs of spaces to one, trimmed."""
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*| {2,}", " "))
    return F.transform(rows, lambda r: F.transform(r, one))


def cells(tables: DataFrame) -> DataFrame:
    """tables (table_id, rows) -> table_id, row_index, col_index, text."""
    return tables.select("table_id", F.posexplode("rows").alias("row_index", "row")).select("table_id", "row_index", F.posexplode("row").alias("col_index", "text"))


def sum_audit(long: DataFrame) -> DataFrame:
    """long (table_id, row_index, col_index, role, value) -> the TOTAL cells that their items
    don't add up to (A10, V2, N5)."""
    w = Window.partitionBy("table_id", "col_index").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda role: F.when(F.col("role") == role, F.col("value"))
    s = long.select("*", F.sum(part("SUBTOTAL")).over(w).alias("subs"), F.count(part("SUBTOTAL")).over(w).alias("n_subs"), F.sum(part("BASE_ITEM")).over(w).alias("items"), F.count(part("BASE_ITEM")).over(w).alias("n_items"), F.sum("value").over(w).alias("everything"))
    target = F.when(F.col("n_subs") >= 2, F.col("subs")).when(F.col("n_items") >= 2, F.col("items"))
    s = s.filter((F.col("role") == "TOTAL") & (F.col("col_index") >= 1) & (F.col("value") > 0)).withColumn("expected", target)
    off = lambda t: F.abs(F.col("value") - t)
    wrong = (F.col("expected") > 0) & (off(F.col("expected")) / F.col("value") > 0.015) & (off(F.col("expected")) > 0.5)
    excused = (off(F.col("everything")) / F.col("value") <= 0.015) | (off(F.col("everything")) <= 0.5)
    return s.filter(wrong & ~F.coalesce(excused, F.lit(False))).select("table_id", "row_index", "col_index", "expected", F.col("value").alias("actual"), F.lit("SUM_MISMATCH").alias("finding"))


def percent_finding(plan: Column, actual: Column, rate: Column) -> Column:
    """The expected rate where the reported one is off by more than 3 points and 3 %."""
    expected = S.half_up(actual / plan * 1000) / 10
    off = F.abs(expected - rate)
    return F.when((plan > 0) & (actual >= 0) & (off > 3.0) & (off / F.when(expected == 0, 1.0).otherwise(expected) > 0.03), expected)


def percent_audit(tables: DataFrame) -> DataFrame:
    """tables (table_id, headers, rows) -> rows whose rate column contradicts plan and actual."""
    roles = tables.withColumn("c", header_roles(F.col("headers"))).filter("c.rate is not null and c.plan is not null and c.actual is not null")
    cell = lambda role: S.vn_number(F.get("row", F.col(f"c.{role}") - 1))
    rows = roles.select("table_id", "c", F.posexplode("rows").alias("row_index", "row"))
    # through a generator: the finding uses each number many times, and none is parsed again
    three = F.struct(cell("plan").alias("plan"), cell("actual").alias("actual"), cell("rate").alias("rate"))
    read = rows.select("table_id", "row_index", (F.col("c.rate") - 1).alias("col_index"), F.explode(F.array(three)).alias("x"))
    found = read.select("table_id", "row_index", "col_index", percent_finding(F.col("x.plan"), F.col("x.actual"), F.col("x.rate")).alias("expected"), F.col("x.rate").alias("actual"))
    return found.filter("expected is not null").withColumn("finding", F.lit("PERCENTAGE_MISMATCH"))


def unit_audit(long: DataFrame) -> DataFrame:
    """long (table_id, col_index, text): columns that mix billions and millions."""
    has = lambda w: F.bool_or(F.lower("text").contains(w))
    units = long.groupBy("table_id", "col_index").agg(has("tỷ").alias("ty"), has("triệu").alias("trieu"))
    return units.filter("ty and trieu").select("table_id", "col_index", F.lit("UNIT_INCONSISTENCY").alias("finding"))


# fixed values: column roles by header words, the auditor's and the extractor's
ROLES = [("rate", "tỷ lệ|tỉ lệ|%|tỷ trọng"), ("plan", "kế hoạch|dự toán|giao|plan|chỉ tiêu năm|chỉ tiêu kế hoạch"), ("actual", "thực hiện|đạt được|giải ngân|đã làm|ước thực hiện|actual")]
EXTRACTOR_ROLES = [("plan", "kế hoạch|dự toán|chỉ tiêu giao"), ("actual", "thực hiện|ước thực hiện|kết quả|giá trị"), ("rate", "tỷ lệ|%|đạt")]


def role_test(pattern: str, earlier: list[str]):
    """Whether a header has a role's words and none of an earlier role's."""

    def fits(x):
        ok = x["h"].rlike(S.web_regex(pattern))
        for p in earlier:
            ok = ok & ~x["h"].rlike(S.web_regex(p))
        return ok

    return fits


def header_roles(headers: Column, last: bool = False, exclusive: bool = True, roles=ROLES) -> Column:
    """struct<rate, plan, actual> of 1-based columns (null: none). The auditor takes the first
    match with exclusive roles (T5), the extractor the last with independent ones (T6)."""
    indexed = F.transform(headers, lambda h, i: F.struct((i + 1).alias("i"), F.lower(F.trim(h)).alias("h")))
    out, before = [], []
    for name, pattern in roles:
        hits = F.filter(indexed, role_test(pattern, list(before)))
        out.append(F.when(F.size(hits) > 0, F.element_at(hits, -1 if last else 1)["i"]).alias(name))
        if exclusive:
            before.append(pattern)
    return F.struct(*out)


# fixed values: words of layout tables, and how prose begins
LETTERHEAD = ["CỘNG HÒA XÃ HỘI", "CỘNG HOÀ XÃ HỘI", "ĐỘC LẬP - TỰ DO", "ĐỘC LẬP – TỰ DO", "ĐỘC LẬP", "ỦY BAN NHÂN DÂN", "UỶ BAN NHÂN DÂN", "HỘI ĐỒNG NHÂN DÂN", "SỐ:"]
REPUBLIC = ["CỘNG HÒA", "CỘNG HOÀ"]
HEADINGS = ["BÁO CÁO", "PHIẾU TRÌNH", "TỜ TRÌNH", "KẾ HOẠCH", "PHẦN THỨ", "KÍNH GỬI", "NƠI NHẬN", "TM. ỦY BAN", "CHỦ TỊCH", "PHÓ CHỦ TỊCH"]
SIGN_OFF = ["NƠI NHẬN", "TM. ỦY BAN"]
SIGNERS = ["CHỦ TỊCH", "GIÁM ĐỐC", "TM.", "KT.", "THỦ TRƯỞNG"]
PROSE = r"^(Tính từ|Căn cứ|Thực hiện|Đánh giá|Theo|UBND|Tại|Sau khi)\b"
ITEM = r"^([-+*•]|\d+\.|\([a-z0-9]+\)|[a-zà-ỹ]\))\s+"
NUMBER_CELL = r"^[0-9]+([.,][0-9]+)?%?$"


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def reject_reason(headers: Column, rows: Column) -> Column:
    """Why a raw table is no data table, null for a valid one (F5, N4, A19), over its arrays."""
    headers = F.coalesce(headers, F.array().cast("array<string>"))
    rows = F.coalesce(rows, F.array().cast("array<array<string>>"))
    headed = F.size(headers) > 0
    grid = F.when(headed, F.concat(F.array(headers), rows)).otherwise(rows)
    n = F.size(grid)
    cols = F.when(headed, F.size(headers)).otherwise(F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)))
    joined = lambda r: F.upper(F.array_join(r, " "))
    first_row, all_text = joined(F.get(grid, F.lit(0))), F.array_join(F.transform(grid, joined), " ")
    cell = lambda r, c: F.trim(F.coalesce(F.get(r, c), F.lit("")))
    each_col = F.when(cols > 0, F.sequence(F.lit(0), F.greatest(cols, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    column = F.transform(each_col, lambda c: F.filter(F.transform(grid, lambda r: cell(r, c)), lambda x: x != ""))
    filled, chars = F.transform(column, F.size), F.transform(column, lambda c: total(F.transform(c, F.length)))
    values = F.flatten(column)
    numeric = F.size(F.filter(values, lambda x: x.rlike(NUMBER_CELL) | x.isin("-", "—", "x", "X")))
    n_filled, n_chars = total(filled), total(chars)
    empty = F.size(F.filter(filled, lambda x: x == 0))
    head = lambda c: cell(F.get(grid, F.lit(0)), c)
    lower_first = lambda x: x.rlike("^[a-zà-ỹ]")
    need = F.when(n <= 2, 1).otherwise(F.greatest(F.lit(2), F.floor(n * 0.25).cast("int")))
    useful = F.size(F.filter(F.arrays_zip(filled.alias("f"), chars.alias("c")), lambda x: (x["f"] >= need) & ((x["c"] >= 5) | (x["f"] >= 2))))
    widest = F.array_max(chars)
    main = (F.array_position(chars, widest) - 1).cast("int")
    beside = F.coalesce(F.array_max(F.transform(F.filter(F.arrays_zip(filled.alias("f"), each_col.alias("i")), lambda x: x["i"] != main), lambda x: x["f"])), F.lit(0))
    letterhead = S.has_any(all_text, LETTERHEAD) & (n <= 4) & ((S.has_any(all_text, REPUBLIC) & all_text.contains("ĐỘC LẬP")) | (S.has_any(first_row, LETTERHEAD) & (n <= 3)))
    two_rows = (n == 2) & (
        (numeric < 2) | ((head(F.lit(0)) == "") & ~cell(F.get(grid, F.lit(1)), F.lit(0)).rlike(r"^\d+\.?$")) | head(F.lit(0)).rlike(S.web_regex(ITEM)) | lower_first(head(F.lit(0)))
    )
    prose = F.exists(F.get(grid, F.lit(0)), lambda x: (F.length(F.trim(F.coalesce(x, F.lit("")))) > 50) & F.trim(F.coalesce(x, F.lit(""))).rlike(S.web_regex(PROSE)))
    return S.first_case(
        [
            ((n < 2) | (cols < 2) | (cols > 16), "SHAPE"),
            (letterhead, "LETTERHEAD"),
            (((n <= 2) & S.has_any(all_text, HEADINGS)) | S.has_any(first_row, SIGN_OFF), "HEADING_OR_SIGN_OFF"),
            ((n_chars < 15) | (n_filled < 4), "TOO_LITTLE"),
            ((empty >= 2) | ((empty > 0) & (empty / cols >= 0.35)), "EMPTY_COLUMNS"),
            (F.size(F.filter(values, lambda x: x.rlike(S.web_regex(r"^[-+*•]\s+")))) >= 2, "BULLETS"),
            (prose, "PROSE_HEADER"),
            (two_rows, "TWO_ROWS"),
            (useful < 2, "ONE_COLUMN"),
            ((widest / n_chars > 0.75) & (((beside / n < 0.35) & (numeric < 2)) | (n_chars - widest < 20)), "DOMINATED"),
            (((F.length(head(main)) > 40) & head(main).rlike(S.web_regex(ITEM))) | ((F.length(head(main)) > 60) & lower_first(head(main))), "NARRATIVE"),
            (n_filled / (n * cols) < 0.20, "SPARSE"),
        ],
        F.lit(None).cast("string"),
    )


def valid_tables(tables: DataFrame) -> DataFrame:
    """tables (doc_id, ord, table_id, table_title, headers, rows, page_ref) -> the valid ones with
    defaults and their number among the valid (X8)."""
    kept = tables.filter(reject_reason(F.col("headers"), F.col("rows")).isNull())
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    page = F.coalesce(F.nullif("page_ref", F.lit(0)), F.lit(1))
    return kept.withColumn("n", n).select(
        "doc_id", "n", S.or_default(F.col("table_id"), F.concat(F.lit("tbl-"), F.col("n"))).alias("table_id"), S.or_default(F.col("table_title"), F.concat(F.lit("Bảng số liệu #"), F.col("n"))).alias("table_title"),
        "headers", "rows", F.size("rows").alias("row_count"), F.when(F.size("headers") > 0, F.size("headers")).otherwise(F.size(F.get("rows", F.lit(0)))).alias("col_count"), page.alias("page_ref"),
    )


def layout_table(rows: Column) -> Column:
    """HEADER or SIGNATURE where a table only lays out text, else null."""
    text = F.upper(F.array_join(F.flatten(rows), " "))
    wide, n = F.array_max(F.transform(rows, F.size)), F.size(rows)
    header = (wide <= 2) & (n <= 3) & S.has_any(text, ["CỘNG HÒA XÃ HỘI", "CỘNG HOÀ XÃ HỘI"]) & text.contains("ĐỘC LẬP")
    sign = (wide <= 4) & (n <= 3) & text.contains("NƠI NHẬN") & S.has_any(text, SIGNERS)
    return F.when(header, "HEADER").when(sign, "SIGNATURE")


def layout_paragraphs(tables: DataFrame) -> DataFrame:
    """tables (doc_id, ord, rows) -> the text lines of layout tables, in order."""
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), S.web_trim), lambda x: x != "")
    return tables.filter(layout_table(F.col("rows")).isNotNull()).select("doc_id", "ord", F.posexplode(F.flatten(F.transform(F.flatten("rows"), lines))).alias("line_no", "text"))


def table_kind(headers: Column, rows: Column) -> Column:
    """SIGNATURE, BUSINESS or null (nothing to show) by words of the header and three rows."""
    head = F.lower(F.array_join(headers, " "))
    text = F.concat_ws(" ", head, F.lower(F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(r, " ")), " ")))
    signed = (head.contains("người ký") & S.has_any(head, ["thời gian", "ý kiến", "đơn vị"])) | (S.has_any(text, ["đã đóng dấu", "số và ký hiệu"]) & text.contains("thời gian ký"))
    some = (F.size(headers) > 0) & (F.size(rows) > 0)
    return F.when(some & signed, "SIGNATURE").when(some & ((F.size(headers) > 1) | (F.size(rows) > 1)), "BUSINESS")


def signature_row(row: Column) -> Column:
    """struct<no, name, unit, time, verdict> of a row of signatures, null without name and unit."""
    part = lambda i: F.trim(F.regexp_replace(F.coalesce(F.get(row, F.lit(i)), F.lit("")), rf"{S.SPACE_CLASS}{{2,}}", " "))
    no, name, time, said = S.or_default(F.get(row, F.lit(0)), "•"), part(1), part(3), part(4)
    body = F.lower(name)
    unit = F.when((part(2) == "") & S.has_any(body, ["công ty", "tập đoàn", "ủy ban"]), "Đơn vị ban hành văn bản").otherwise(part(2))
    day, clock = F.regexp_extract(time, r"\d{1,2}/\d{1,2}/\d{4}", 0), F.regexp_extract(time, r"\d{1,2}:\d{1,2}:\d{1,2}", 0)
    low = F.lower(said)
    junk = (said == "") | (F.length(said) > 25) | said.rlike(r"\d\s*:\s*\d") | said.rlike(r"(?:[a-zA-Z]\s+){2,}[a-zA-Z]") | ~S.has_any(low, ["thống", "đồng ý", "phê duyệt", "đóng dấu"])
    verdict = S.first_case(
        [
            (low.contains("đóng dấu"), "✅ Đã đóng dấu & ký số"),
            (S.has_any(low, ["thống", "nhất"]), "✅ Thống nhất nội dung"),
            (junk & ((no == "1") | body.contains("công ty")), "✅ Đã đóng dấu & ban hành"),
            (junk & ((no == "2") | S.has_any(F.lower(unit), ["phó", "trưởng"])), "✅ Đã phê duyệt"),
            (junk, "✅ Đã ký duyệt (Trình ký)"),
        ],
        said,
    )
    shown = F.struct(no.alias("no"), name.alias("name"), unit.alias("unit"), F.when(day == "", "-").otherwise(F.concat_ws(" ", day, F.nullif(clock, F.lit("")))).alias("time"), verdict.alias("verdict"))
    return F.when((F.length(name) >= 2) | (F.length(unit) >= 2), shown)


SUMMARY = r"^(tổng|tổng số|tổng cộng|toàn tỉnh|toàn ngành|ước thực hiện)"


def summary_metrics(tables: DataFrame) -> DataFrame:
    """tables (doc_id, ord, table_title, headers, rows, page_ref) -> the metrics of summary rows,
    the first of each name and value (T7, T6)."""
    c = header_roles(F.coalesce(F.col("headers"), F.array().cast("array<string>")), last=True, exclusive=False, roles=EXTRACTOR_ROLES)
    rows = tables.withColumn("c", c).select("doc_id", "ord", "table_title", "page_ref", "c", F.posexplode("rows").alias("row_index", "row")).filter("size(row) > 0")
    first = F.get("row", F.lit(0))
    title = F.trim(F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(F.coalesce(F.get("row", F.lit(1)), F.lit(""))))
    at = lambda role: F.nullif(F.trim(F.get("row", F.col(f"c.{role}") - 1)), F.lit(""))
    actual = F.coalesce(at("actual"), F.trim(F.element_at("row", -1)))
    name = F.concat(S.or_default(F.col("table_title"), "Bảng số liệu"), F.lit(": "), F.col("title"))
    found = rows.withColumn("title", title).filter(F.col("title").rlike(S.web_regex(SUMMARY)) & (F.length("title") > 2)).select(
        "doc_id", "ord", "row_index", name.alias("indicator"), actual.alias("actual"), at("plan").alias("plan_target"), at("rate").alias("percentage"),
        F.when(F.lower("title").contains("ước"), "UOC_THUC_HIEN").otherwise("THUC_HIEN_THUC_TE").alias("data_nature"), F.coalesce(F.nullif("page_ref", F.lit(0)), F.lit(1)).alias("page_ref"),
        F.concat(F.lit("[Bảng "), F.coalesce("table_title", F.lit("")), F.lit("] "), F.array_join("row", " | ")).alias("quote"),
    )
    once = Window.partitionBy("doc_id", F.lower("indicator"), "actual").orderBy("ord", "row_index")
    return found.filter(F.col("actual").rlike("[0-9]")).withColumn("seen", F.row_number().over(once)).filter("seen = 1").drop("seen")


def process_tables(tables: DataFrame) -> DataFrame:
    """tables (table_id, headers, rows) -> clean headers and rows, header tree, markdown, counts and
    the findings of the three audits (T1)."""
    # through a generator: the audits use the clean cells many times, and none makes them again
    clean = tables.select("table_id", F.explode(F.array(F.struct(clean_cells(F.array("headers"))[0].alias("headers"), clean_cells(F.col("rows")).alias("rows")))).alias("t")).select("table_id", "t.headers", "t.rows")
    long = cells(clean)
    first = F.trim(F.get("row", F.lit(0)))
    numbers = clean.select("table_id", F.posexplode("rows").alias("row_index", "row")).select("table_id", "row_index", S.row_role(first).alias("role"), F.posexplode("row").alias("col_index", "text"))
    shape = ["table_id", F.col("finding"), F.col("row_index").cast("int").alias("row_index"), F.col("col_index").cast("int").alias("col_index")]
    sums = sum_audit(numbers.select("table_id", "row_index", "col_index", "role", S.vn_number(F.col("text")).alias("value"))).select(*shape)
    units = unit_audit(long).withColumn("row_index", F.lit(None).cast("int")).select(*shape)
    found = sums.union(percent_audit(clean).select(*shape)).union(units).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("finding", "col_index", "row_index"))).alias("findings"))
    none = F.array().cast("array<struct<finding:string,col_index:int,row_index:int>>")
    out = clean.join(found, "table_id", "left")
    return out.select("table_id", "headers", header_tree(F.col("headers")).alias("header_tree"), "rows", F.size("rows").alias("row_count"), F.size("headers").alias("col_count"), markdown(F.col("headers"), F.col("rows")).alias("markdown"), F.coalesce("findings", none).alias("findings"))


def table_quality(long: DataFrame) -> DataFrame:
    """long (table_id, row_index, col_index, text; row 0 is the header) -> table_id, verdict:
    the main rules of a valid data table (F5, N4, A9, A19) as two aggregations."""
    t = F.trim(F.coalesce("text", F.lit("")))
    col = long.groupBy("table_id", "col_index").agg(
        F.count_if(t != "").alias("filled"), F.sum(F.length(t)).alias("chars"), F.count_if(t.rlike(r"^[\d.,%\s-]*\d[\d.,%\s-]*$")).alias("numeric"), F.count_if(t.rlike("^[-•*+]\\s")).alias("bullets"), F.max("row_index").alias("last_row"),
    )
    rows = F.col("n_rows")
    need = F.greatest(F.lit(2), F.floor(rows * 0.25))
    g = col.groupBy("table_id").agg(
        F.count("*").alias("cols"), (F.max("last_row") + 1).alias("n_rows"), F.sum("filled").alias("filled"), F.sum("chars").alias("chars"), F.sum("numeric").alias("numeric"), F.sum("bullets").alias("bullets"),
        F.count_if(F.col("filled") == 0).alias("empty_cols"), F.max("chars").alias("widest"), F.collect_list(F.struct("filled", "chars")).alias("profile"),
    )  # fmt: skip  a table has few columns
    useful = F.size(F.filter("profile", lambda p: (p["filled"] >= need) & ((p["chars"] >= 5) | (p["filled"] >= 2))))
    others = F.col("chars") - F.col("widest")
    verdict = S.first_case(
        [
            ((rows < 2) | (F.col("cols") < 2) | (F.col("cols") > 16), "SHAPE"),
            ((F.col("chars") < 15) | (F.col("filled") < 4), "TOO_LITTLE"),
            ((F.col("empty_cols") >= 2) | (F.col("empty_cols") >= F.col("cols") * 0.35), "EMPTY_COLUMNS"),
            (F.col("bullets") >= 2, "BULLETS"),
            ((rows == 2) & (F.col("numeric") < 2), "TWO_ROWS"),
            (useful < 2, "ONE_COLUMN"),
            ((F.col("widest") > 0.75 * F.col("chars")) & (others < 20), "DOMINATED"),
            (F.col("filled") < rows * F.col("cols") * 0.2, "SPARSE"),
        ],
        "VALID",
    )
    return g.select("table_id", "cols", "n_rows", "filled", "chars", "numeric", verdict.alias("verdict"))


def markdown(headers: Column, rows: Column) -> Column:
    """Header, rule and rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def header_tree(headers: Column) -> Column:
    """map<parent, array<struct<col_index, label>>> of headers 'parent - child' (S25)."""
    split = F.transform(headers, lambda h, i: F.struct(F.trim(F.get(F.split(h, " - | / ", 2), F.lit(0))).alias("p"), i.alias("col_index"), F.trim(F.coalesce(F.get(F.split(h, " - | / ", 2), F.lit(1)), h)).alias("label")))
    parents = F.array_distinct(F.transform(split, lambda x: x["p"]))
    return F.map_from_arrays(parents, F.transform(parents, lambda p: F.transform(F.filter(split, lambda x: x["p"] == p), lambda x: F.struct(x["col_index"].alias("col_index"), x["label"].alias("label")))))


def row_class(row: Column) -> Column:
    """TOTAL, SECTION or DATA."""
    first, second = F.trim(F.coalesce(F.get(row, F.lit(0)), F.lit(""))), F.trim(F.coalesce(F.get(row, F.lit(1)), F.lit("")))
    filled = F.size(F.filter(row, lambda c: F.trim(c) != ""))
    text = F.lower(F.concat(first, F.lit(" "), second))
    return S.first_case([(text.contains("tổng") | text.contains("cộng"), "TOTAL"), (first.rlike("^[IVX]+\\.?$") | ((filled == 1) & (second != "")), "SECTION")], "DATA")


def sub_header(rows: Column) -> Column:
    """Whether the first row is a second tier of headers."""
    a, b = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    return F.coalesce(F.trim(F.get(a, F.lit(0))).isin("", "-") & F.trim(F.get(b, F.lit(0))).rlike(r"^(\d+|[IVX]+)\.?$") & F.exists(a, lambda c: c.rlike(S.web_regex("kế hoạch|thực hiện|tỷ lệ|số|năm|quý|tháng"))) & F.forall(a, lambda c: F.length(c) <= 40), F.lit(False))


def header_spans(headers: DataFrame) -> DataFrame:
    """headers (table_id, col_index, parent) -> runs of columns under one parent; a blank
    parent continues the run before it (T9)."""
    w = Window.partitionBy("table_id").orderBy("col_index")
    runs = headers.withColumn("run", F.sum(F.when(F.trim("parent") != "", 1).otherwise(0)).over(w))
    return runs.groupBy("table_id", "run").agg(F.min("col_index").alias("from_col"), F.count("*").alias("span"), F.min_by("parent", "col_index").alias("parent"))


def alignment(long: DataFrame) -> DataFrame:
    """Columns whose first 30 rows are all numbers stand right."""
    t = F.trim("text")
    return long.filter("row_index < 30").groupBy("table_id", "col_index").agg(F.when(F.bool_and((t == "") | t.rlike(r"^[\d.,%\s-]+$")) & F.bool_or(t != ""), "RIGHT").otherwise("LEFT").alias("align"))
