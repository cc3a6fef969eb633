"""Document metadata: authority, title, signer, recipients and the record of a report.

Everything is a Column expression over the pages' lines; steps that stop at a line are folds
with small state. A document's pages are reduced to the few texts that matter (its first page,
its signature page) by aggregates of bounded state before any expression runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: patterns and defaults of the record
AUTHORITY = r"(?:ỦY\s*BAN\s*NHÂN\s*DÂN|UỶ\s*BAN\s*NHÂN\s*DÂN|UBND|PHÒNG|SỞ|BỘ|CÔNG\s*AN|BAN|TẬP\s*ĐOÀN|TỔNG\s*CÔNG\s*TY|CÔNG\s*TY)[^\n|]*"
UNIT_LINE = r"(?:XÃ|PHƯỜNG|THỊ\s*TRẤN|HUYỆN|QUẬN|THÀNH\s*PHỐ|TỈNH|CHI\s*NHÁNH|TRUNG\s*TÂM)\s+[^\n|][^\n]*"
APPENDIX = r"phụ\s+lục\b"
APPENDIX_ENDS = r"^(?:TT|STT|Đơn vị|Số:|ỦY BAN|UBND)\b|^I\."
TITLES = "BÁO CÁO|TỜ TRÌNH|THÔNG BÁO|QUYẾT ĐỊNH|PHIẾU TRÌNH|BIÊN BẢN|CÔNG VĂN"
TITLE_ENDS = r"^(?:\(|Phần|PHẦN|Kính gửi|Đơn vị trình|Căn cứ|Nơi nhận|I\.|1\.|[-*•+]|[a-zđ]\))|^(?:ỦY BAN|UBND|CỘNG HÒA|Số:)"
SUBJECT = r"(?:V/v|Về việc)\s*([^\n|]+(?:\n[^\n|]+)?)"
SIGN_START = r"((?:^|\n)\s*(?:TM\b|TM\.|KT\b|KT\.|CHỦ TỊCH|GIÁM ĐỐC|TỔNG GIÁM ĐỐC)\b[\s\S]*)$"
SIGN_TITLE = r"^(?:TM\b|TM\.|KT\b|KT\.|CHỦ TỊCH|PHÓ CHỦ TỊCH|GIÁM ĐỐC|PHÓ GIÁM ĐỐC|TRƯỞNG PHÒNG|THỦ TRƯỞNG|UỶ BAN|ỦY BAN|UBND)"
SIGN_TITLE_ANY = r"((?:TM\.\s*)?(?:KT\.\s*)?(?:PHÓ\s+)?(?:CHỦ TỊCH|GIÁM ĐỐC|TỔNG GIÁM ĐỐC|TRƯỞNG PHÒNG|THỦ TRƯỞNG))"
NOT_A_NAME = r"^(?:BIỂU|BẢNG|Phụ lục|Nơi nhận)"
NOT_LAST_NAME = r"(nơi nhận|kính gửi|lưu:|chủ tịch|giám đốc|phó|trưởng|ký tên|đã ký|vt|bảng|biểu)"
RECEIVERS = r"Nơi nhận\s*:"
SIGNED = r"(?:TM\.|KT\.)|(?:CHỦ TỊCH|GIÁM ĐỐC|TỔNG GIÁM ĐỐC|THỦ TRƯỞNG|PHÓ CHỦ TỊCH)"
DEFAULT_AUTHORITY = "ỦY BAN NHÂN DÂN"
DEFAULT_TITLE = "Báo cáo công tác"
SHORT_TITLE = "Báo cáo tình hình thực hiện nhiệm vụ"
APPENDIX_TITLE = "PHỤ LỤC BẢNG BIỂU"
DEFAULT_RECEIVER = "Cơ quan cấp trên / Lãnh đạo UBND"
DEFAULT_RECIPIENT = "Lãnh đạo cơ quan"


def filled_lines(text: Column) -> Column:
    """Trimmed lines, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), S.web_trim), lambda x: x != "")


def fits(c: Column, pattern: str) -> Column:
    return c.rlike(S.web_regex(pattern))


def issuing_authority(page_one: Column) -> Column:
    """The first authority named, with the line after it where that names its sub-unit."""
    p = S.web_regex(rf"({AUTHORITY})(?:\s*({UNIT_LINE}))?")
    found = F.concat_ws(" ", S.web_trim(F.regexp_extract(page_one, p, 1)), S.web_trim(F.regexp_extract(page_one, p, 2)))
    name = F.trim(F.translate(S.squeeze(found), "|", ""))
    return S.or_default(name, DEFAULT_AUTHORITY)


def is_appendix(page_one: Column) -> Column:
    early = fits(F.substring(page_one, 1, 300), rf"(?:^|\n)\s*{APPENDIX}") & ~F.lower(page_one).contains("cộng hòa xã hội")
    return fits(page_one, rf"^\s*{APPENDIX}") | early


def taken(lines: Column, keep, last, most: int | None = None) -> Column:
    """The leading lines that satisfy keep, up to and with the first that satisfies last."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

    def step(acc, x):
        ends = acc["done"] | ~keep(x)
        return F.struct(F.when(ends, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"), (ends | last(x)).alias("done"))

    got = F.aggregate(lines, state, step, lambda acc: acc["out"])
    return F.slice(got, 1, most) if most else got


def appendix_title(page_one: Column) -> Column:
    """The heading of an appendix and the lines below it, three parts at most; later headings
    among them stand in capitals."""
    lines = filled_lines(page_one)
    heads = lambda x: fits(x, rf"^{APPENDIX}")
    at = F.array_position(F.transform(lines, heads), True)
    below = F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(1)))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

    def step(acc, x):
        ends = acc["done"] | (~heads(x) & fits(x, APPENDIX_ENDS))
        part = F.when(heads(x), F.upper(x)).otherwise(x)
        out = F.when(ends, acc["out"]).otherwise(F.concat(acc["out"], F.array(part)))
        return F.struct(out.alias("out"), (ends | (~heads(x) & (F.size(out) >= 3))).alias("done"))

    parts = F.aggregate(below, state, step, lambda acc: acc["out"])
    return F.when(at > 0, F.array_join(parts, " - ")).otherwise(APPENDIX_TITLE)


def report_title(page_one: Column) -> Column:
    """Appendix heading, else kind of document with its continuation lines, else subject."""
    return long_title(title_of(page_one, is_appendix(page_one), *title_parts(page_one)))


def title_parts(page_one: Column) -> list[Column]:
    """The kind of document that a line names, and what follows it."""
    p = S.web_regex(rf"(?:^|\n)\s*({TITLES})\b([\s\S]*)$")
    return [F.regexp_extract(page_one, p, i).alias(name) for i, name in ((1, "title_kind"), (2, "title_rest"))]


def title_of(page_one: Column, appendix: Column, kind: Column, rest: Column) -> Column:
    more = taken(F.slice(filled_lines(rest), 1, 5), lambda x: ~fits(x, TITLE_ENDS) & (F.length(x) <= 250), lambda x: fits(x, r"[.:]\s*$"))
    titled = S.squeeze(F.array_join(F.concat(F.array(F.upper(kind)), more), " "))
    subject = S.squeeze(F.regexp_extract(page_one, S.web_regex(SUBJECT), 1))
    return S.first_case([(appendix, appendix_title(page_one)), (kind != "", titled), (subject != "", F.concat(F.lit("Công văn: "), subject))], DEFAULT_TITLE)


def long_title(title: Column) -> Column:
    return F.when(F.length(title) < 5, SHORT_TITLE).otherwise(title)


def name_like(x: Column) -> Column:
    return (F.size(F.split(x, " ")) >= 2) & (F.length(x) < 40) & ~x.rlike("[0-9:.]")


def signer(text: Column) -> Column:
    """struct<name, title> from the signature page (S14): title lines, then the first line that
    looks like a name; without a block, a title anywhere and a name among the last lines."""
    return signer_of(text, *signer_parts(text))


def signer_parts(text: Column) -> list[Column]:
    """The lines of the signature block, and a signer's title anywhere."""
    block = filled_lines(F.substring(F.regexp_extract(text, S.web_regex(SIGN_START), 1), 1, 450))
    return [block.alias("sign_block"), F.nullif(F.trim(F.regexp_extract(text, S.web_regex(SIGN_TITLE_ANY), 1)), F.lit("")).alias("sign_title")]


def signer_of(text: Column, block: Column, anywhere: Column) -> Column:
    a_title = lambda x: fits(x, SIGN_TITLE)
    a_name = lambda x: ~a_title(x) & name_like(x) & ~fits(x, NOT_A_NAME)
    name = F.get(F.filter(block, a_name), F.lit(0))
    at = F.array_position(F.transform(block, a_name), True)
    above = F.when(at > 0, F.slice(block, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(block)
    titles = F.filter(above, a_title)
    tail = F.slice(F.reverse(F.filter(filled_lines(text), lambda x: F.length(x) > 2)), 1, 8)
    last_name = F.get(F.filter(tail, lambda x: ~fits(x, NOT_LAST_NAME) & name_like(x)), F.lit(0))
    return F.struct(F.coalesce(name, last_name).alias("name"), F.when(F.size(titles) > 0, F.array_join(titles, "\n")).otherwise(anywhere).alias("title"))


def recipients(text: Column) -> Column:
    """Distinct recipients of the list after 'Nơi nhận:' (S14, U5)."""
    after = F.regexp_extract(text, r"(?s)Nơi nhận:(.*)$", 1)
    listed = taken(filled_lines(after), lambda x: x.rlike(r"^[-*•+0-9.)]") | x.endswith(";"), lambda _: F.lit(False))
    clean = F.transform(listed, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, rf"^(?:[-*•+0-9.)]|{S.SPACE_CLASS})+", ""), ";$", "")))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 2))


def receiving_authority(names: Column) -> Column:
    """The first recipient that is not the archive, else the first."""
    return F.coalesce(F.get(F.filter(names, lambda x: ~F.lower(x).startswith("lưu:")), F.lit(0)), F.get(names, F.lit(0)))


def key_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text, n_tables) -> one row a document: page_one, the page that holds
    the signature (the last with recipients and a signature, else the last with either, else
    the last), and table counts."""
    text = F.coalesce("text", F.lit(""))
    both = fits(text, RECEIVERS) & fits(text, SIGNED)
    either = fits(text, RECEIVERS) | fits(text, r"(?:TM\.|KT\.)")
    last = lambda cond: F.max_by(text, F.when(cond, F.col("page")))
    tables = F.coalesce("n_tables", F.lit(0))
    g = pages.groupBy("doc_id").agg(
        F.min_by(text, "page").alias("page_one"), last(both).alias("a"), last(either).alias("b"), F.max_by(text, "page").alias("z"),
        F.count("*").alias("pages"), F.count_if(tables > 0).alias("pages_with_tables"), F.bool_or(fits(text, "(phụ lục|kèm theo|bảng số)")).alias("names_appendix"),
    )
    # without the first kind of page the last one serves if it names recipients
    sign = F.coalesce("a", F.when(fits(F.col("z"), RECEIVERS), F.col("z")), "b", "z")
    return g.select("doc_id", "page_one", sign.alias("sign_page"), "pages", "pages_with_tables", "names_appendix")


def document_metadata(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text, n_tables) -> the metadata record of each document."""
    one = F.col("page_one")
    # step by step, in columns: as expressions the pages would be searched again in each of their uses
    d = key_pages(pages).select("*", S.document_type(one).alias("kind"), is_appendix(one).alias("appendix"), *title_parts(one), issuing_authority(one).alias("issuing_authority"), recipients(F.col("sign_page")).alias("names"), *signer_parts(F.col("sign_page")))
    d = d.withColumn("title", title_of(one, F.col("appendix"), F.col("title_kind"), F.col("title_rest"))).withColumn("document_title", long_title(F.col("title")))
    receiver = receiving_authority(F.col("names"))
    table_pages = F.col("pages_with_tables")
    pure = F.col("appendix") | (F.col("kind") == "PHU_LUC") | ((F.col("pages") > 0) & (table_pages > 0) & (table_pages >= F.col("pages") * 0.8))
    period = S.reporting_period(F.concat_ws("\n", "document_title", one))
    return d.select(
        "doc_id", "document_title", F.when(F.col("appendix"), "PHU_LUC").otherwise(F.col("kind")).alias("document_type"), S.document_number(one).alias("document_number"), "issuing_authority",
        F.coalesce(receiver, F.lit(DEFAULT_RECEIVER)).alias("receiving_authority"), F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit(DEFAULT_RECIPIENT))).alias("recipients"),
        S.issuance_date(one).alias("issuance_date"), period.alias("reporting_period"), S.is_periodic(one).alias("is_periodic"),
        (F.col("names_appendix") | F.col("appendix") | (table_pages > 0)).alias("has_appendix"), pure.alias("is_pure_table"), signer_of(F.col("sign_page"), F.col("sign_block"), F.col("sign_title")).alias("signer"),
    )


def pure_tabular(kind: Column, is_pure: Column, raw: Column, title: Column) -> Column:
    """Whether a document is printed as tables alone."""
    raw = F.coalesce(raw, F.lit(""))
    named = fits(F.coalesce(title, F.lit("")), "PHỤ LỤC") & (raw != "") & ~raw.contains("CỘNG HÒA XÃ HỘI")
    return F.coalesce(kind == "PHU_LUC", F.lit(False)) | F.coalesce(is_pure, F.lit(False)) | fits(raw, rf"^\s*{APPENDIX}") | named
