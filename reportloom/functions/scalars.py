"""Scalar functions of the report domain as Column expressions (no Python UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\s   -     　﻿]"
WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def web_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with ECMAScript meaning of \\b, \\s and case folding, for the JVM."""
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", WORD_EDGE).replace(r"\s", SPACE_CLASS)


def web_trim(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def or_default(c: Column, value) -> Column:
    """Null and empty text both fall to the default."""
    return F.when(c.isNull() | (c == ""), F.lit(value)).otherwise(c)


def first_case(rules: list[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    last = default if isinstance(default, Column) else F.lit(default)
    return reduce(lambda rest, r: F.when(r[0], r[1] if isinstance(r[1], Column) else F.lit(r[1])).otherwise(rest), reversed(rules), last)


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words[1:], c.contains(words[0]))


def starts_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | c.startswith(w), words[1:], c.startswith(words[0]))


# ------------------------------------------------------------------------ numbers

NUMBER_PREFIX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def lenient_float(c: Column) -> Column:
    """The longest numeric prefix, or null."""
    return F.regexp_extract(F.ltrim(c), NUMBER_PREFIX, 0).try_cast("double")


def vn_number(c: Column) -> Column:
    """A number in Vietnamese notation: dots group thousands, a comma starts decimals; unit
    letters and % are ignored; one dot before exactly three digits groups."""
    bare = F.regexp_replace(F.regexp_replace(c, f"{SPACE_CLASS}+|%", ""), "[a-zA-ZÀ-ỹ]", "")
    dot, comma = bare.contains("."), bare.contains(",")
    parts = F.split(bare, r"\.")
    no_dots = F.regexp_replace(bare, r"\.", "")
    one_comma = F.regexp_replace(bare, "^([^,]*),", "$1.")
    text = (
        F.when(dot & comma, F.regexp_replace(no_dots, "^([^,]*),", "$1."))
        .when(comma, one_comma)
        .when(dot & (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(1))) == 3), no_dots)
        .otherwise(bare)
    )
    return F.when(bare != "", lenient_float(text))


def half_up(c: Column) -> Column:
    """Round half toward positive infinity."""
    return F.floor(c + 0.5)


# ------------------------------------------------------------------- classification

# fixed values: bottleneck categories, in order
BOTTLENECKS = [
    ("GIAI_PHONG_MAT_BANG", "mặt bằng|đất đai|bồi thường|tái định cư|giải phóng", "Giải phóng mặt bằng"),
    ("VON_DAU_TU", "vốn|giải ngân|kinh phí|ngân sách|đầu tư", "Vốn đầu tư"),
    ("THU_TUC_PHAP_LY", "thủ tục|pháp lý|luật|nghị định|hồ sơ|thẩm định|quy hoạch", "Thủ tục pháp lý"),
    ("NHAN_SU", "nhân lực|cán bộ|biên chế|nhân sự", "Nhân sự"),
    ("THI_CONG_VAT_LIEU", "vật liệu|cát|đá|thi công|nhà thầu", "Thi công và vật liệu"),
]


def bottleneck_category(c: Column, rules=BOTTLENECKS) -> Column:
    return first_case([(c.rlike(web_regex(p)), code) for code, p, _ in rules], "KHAC")


def category_label(code: Column, rules=BOTTLENECKS) -> Column:
    return first_case([(code == k, name) for k, _, name in rules], code)


# fixed values: row roles of report tables
BREAKDOWN = ["trong đó", "trong do", "- trong đó", "+ trong đó", "gồm:", "bao gồm", "cụ thể:"]
TOTAL_IS = ["tổng cộng", "tổng số", "tổng chung", "cộng", "tổng"]
TOTAL_STARTS = ["tổng cộng:", "tổng số:", "tổng chung:", "tổng chi", "tổng thu"]
SUBTOTAL_STARTS = ["cộng mục", "tổng mục", "tiểu kết", "tổng phần"]


def row_role(first_cell: Column) -> Column:
    c = F.trim(F.lower(F.coalesce(first_cell, F.lit(""))))
    return first_case(
        [
            (starts_any(c, BREAKDOWN) | c.contains("trong đó:"), "BREAKDOWN"),
            (c.isin(TOTAL_IS) | starts_any(c, TOTAL_STARTS), "TOTAL"),
            (starts_any(c, SUBTOTAL_STARTS) | (c.contains("cộng") & ~c.contains("tổng cộng")), "SUBTOTAL"),
        ],
        "BASE_ITEM",
    )


# fixed values: what a zero means
ZERO_CRITICAL = ["giải ngân", "thu ngân sách", "bàn giao mặt bằng", "tiến độ", "kết quả thực hiện", "hồ sơ đã xử lý"]
ZERO_POSITIVE = ["khiếu nại", "tố cáo", "quá hạn", "trễ hạn", "tai nạn", "chết người", "thương tích", "vi phạm", "sai phạm", "đơn thư", "cháy nổ", "thiệt hại", "kỷ luật"]


def zero_semantics(indicator: Column, unit: Column, critical=None, positive=None, ratio=("đạt", "tỷ lệ")) -> Column:
    c = F.lower(indicator)
    rate = F.coalesce(unit == "%", F.lit(False)) & has_any(c, list(ratio))
    return first_case([(has_any(c, critical or ZERO_CRITICAL) | rate, "CRITICAL_ZERO"), (has_any(c, positive or ZERO_POSITIVE), "POSITIVE_ZERO")], "NEUTRAL_ZERO")


# fixed values: units by what a metric's name mentions, in order
UNIT_RULES = [
    ("%", "tỷ lệ|tỉ lệ|độ che phủ|độ bao phủ|tỷ trọng|tăng trưởng|giảm nghèo|hoàn thành"),
    ("ha", "diện tích|đất đai|rừng|tự nhiên|canh tác|quy hoạch|mặt bằng|thổ nhưỡng"),
    ("tỷ đồng", "ngân sách|vốn đầu tư|kế hoạch vốn|giải ngân|dự toán|tổng thu|tổng chi|doanh thu|đầu tư công"),
    ("triệu đồng", "kinh phí|mức trợ cấp|chi trả|tiền mặt|mức phạt|thu nhập"),
    ("Đối tượng", "đối tượng btxh|bảo trợ xã hội|chính sách|hưởng trợ cấp|nhận trợ cấp|đối tượng"),
    ("Hộ", "hộ nghèo|hộ cận nghèo|hộ dân|hộ gia đình"),
    ("Người", "dân số|nhân khẩu|cư dân|đồng bào|dân tộc|trẻ em|người cao tuổi|người khuyết tật|phụ nữ|học sinh|bệnh nhân|công chức|viên chức|cán bộ|y bác sĩ|lao động|người có thẻ"),
    ("Điểm", "trạm y tế|điểm trạm|trường học|phòng khám|cơ sở y tế|điểm trường"),
    ("Lượt", "khám chữa bệnh|lượt khám|tiếp công dân|lượt tiếp"),
    ("Vụ", "đơn thư|khiếu nại|tố cáo|phản ánh|vụ việc|vụ án|tranh chấp|hồ sơ|văn bản|quyết định"),
    ("Dự án", "dự án|công trình|gói thầu"),
]
UNIT_NAMES = {"phần trăm": "%", "%": "%", "nguoi": "Người", "người": "Người", "ho": "Hộ", "hộ": "Hộ", "ha": "ha", "hecta": "ha", "ty dong": "tỷ đồng", "tỷ đồng": "tỷ đồng", "trieu dong": "triệu đồng", "triệu đồng": "triệu đồng", "dong": "đồng", "đồng": "đồng", "ca": "Ca", "ca bệnh": "Ca", "vu": "Vụ", "vụ": "Vụ", "luot": "Lượt", "lượt": "Lượt", "lượt khám": "Lượt", "truong hop": "Trường hợp", "trường hợp": "Trường hợp", "doi tuong": "Đối tượng", "đối tượng": "Đối tượng"}


def infer_unit(name: Column, explicit: Column | None = None, rules=UNIT_RULES) -> Column:
    told = F.trim(F.coalesce(explicit, F.lit(""))) if explicit is not None else F.lit("")
    known = F.create_map(*[F.lit(x) for kv in UNIT_NAMES.items() for x in kv])
    n = F.coalesce(name, F.lit(""))
    bracket = F.regexp_extract(n, r"\(([^)]+)\)$", 1)
    by_rule = first_case([(n.rlike(web_regex(p)), u) for u, p in rules], "")
    return F.when(told != "", F.coalesce(F.try_element_at(known, F.lower(told)), told)).when(bracket != "", F.trim(bracket)).otherwise(by_rule)


def severity_card(severity: Column) -> Column:
    """(rank, level, colour) of a bottleneck's severity."""
    top, high = severity.isin("CRITICAL", "NGHIEM_TRONG"), severity.isin("HIGH", "CAO")
    return F.struct(F.when(top, 3).when(high, 4).otherwise(5).alias("rank"), F.when(top, "CRITICAL").when(high, "HIGH").otherwise("MEDIUM").alias("level"), F.when(top | high, "RED").otherwise("AMBER").alias("colour"))


def metric_badge(status: Column) -> Column:
    return F.when(status == "RED", "RED").when(status == "YELLOW", "AMBER").otherwise("GREEN")


# fixed values: document types by their heading, in order
DOC_TYPES = [
    ("PHIEU_TRINH", r"PHIẾU\s+TRÌNH|PHIẾU\s+GIẢI\s+QUYẾT"),
    ("TO_TRINH", r"TỜ\s+TRÌNH"),
    ("BAO_CAO", r"BÁO\s+CÁO"),
    ("QUYET_DINH", r"QUYẾT\s+ĐỊNH"),
    ("THONG_BAO_KET_LUAN", r"THÔNG\s+BÁO\s+KẾT\s+LUẬN|THÔNG\s+BÁO"),
    ("BIEN_BAN", r"BIÊN\s+BẢN"),
    ("CONG_VAN", r"CÔNG\s+VĂN"),
]


def document_type(page_one: Column) -> Column:
    low = F.lower(page_one)
    appendix = page_one.rlike(web_regex(r"^\s*phụ\s+lục\b")) | (F.substring(page_one, 1, 300).rlike(web_regex(r"(?:^|\n)\s*phụ\s+lục\b")) & ~low.contains("cộng hòa xã hội"))
    letter = low.contains("kính gửi") & (low.contains("v/v") | low.contains("về việc"))
    return first_case([(appendix, "PHU_LUC"), *[(page_one.rlike(web_regex(rf"(?:^|\n)\s*(?:{p})\b")), t) for t, p in DOC_TYPES], (letter, "CONG_VAN")], "BAO_CAO")


# fixed values: domains with the words that score on page one (10) and in the text
DOMAINS = [
    ("DAU_TU_CONG", "Đầu tư công & Xây dựng", ["đầu tư công", "kế hoạch vốn", "giải ngân"], ["đầu tư công", "kế hoạch vốn"], 3),
    ("GPMB", "Giải phóng mặt bằng & Tái định cư", ["giải phóng mặt bằng", "bồi thường", "gpmb"], ["giải phóng mặt bằng", "gpmb"], 2),
    ("NGAN_SACH", "Tài chính - Ngân sách", ["ngân sách", "quyết toán"], ["ngân sách", "quyết toán"], 2),
    ("CCHC", "Cải cách hành chính", ["cải cách hành chính", "cchc"], ["cải cách hành chính", "cchc"], 3),
    ("TCD_PCTN", "Tiếp công dân & PCTN", ["tiếp công dân", "khiếu nại", "tố cáo", "pctn"], ["tiếp công dân", "khiếu nại"], 3),
    ("TU_PHAP", "Tư pháp - Hộ tịch", ["tư pháp"], ["tư pháp"], 2),
    ("NOI_VU", "Nội vụ & Cán bộ", ["nội vụ"], ["nội vụ"], 2),
    ("Y_TE", "Y tế - Chăm sóc sức khỏe", ["y tế", "trạm y tế", "khám bệnh", "chữa bệnh", "dịch bệnh"], ["y tế", "khám chữa bệnh", "tiêm chủng"], 2),
    ("SU_CO_THIEN_TAI", "Phòng chống thiên tai & Sự cố", ["thiên tai", "bão"], ["thiên tai", "ngập lụt"], 3),
    ("THANH_TRA", "Thanh tra & Kiểm tra", ["thanh tra"], ["kiểm tra, thanh tra", "kết luận thanh tra"], 2),
    ("CHUYEN_DOI_SO", "Chuyển đổi số & Công nghệ", ["chuyển đổi số", "cđs", "công nghệ số"], [], 0),
    ("KTXH_TONG_HOP", "Kinh tế - Xã hội", ["kinh tế - xã hội", "ktxh"], [], 0),
]


def domain_scores(page_one: Column, text: Column, domains=DOMAINS) -> Column:
    """array<struct<score, order, code, name>> of every domain."""
    p, t = F.lower(page_one), F.lower(text)
    rows = []
    for i, (code, name, first, later, weight) in enumerate(domains):
        score = F.when(has_any(p, first), 10).otherwise(0) + (F.when(has_any(t, later), weight).otherwise(0) if later else F.lit(0))
        rows.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(code).alias("code"), F.lit(name).alias("name")))
    return F.array(*rows)


def primary_domain(page_one: Column, text: Column, domains=DOMAINS) -> Column:
    """The first domain of the greatest score (also when every score is 0)."""
    return F.array_max(domain_scores(page_one, text, domains))


def domain_tags(text: Column, domains=DOMAINS) -> Column:
    t = F.lower(text)
    tags = F.array_compact(F.array(*[F.when(has_any(t, later), F.lit(code)) for code, _, _, later, _ in domains if later], F.when(has_any(t, ["kiến nghị", "đề xuất"]), F.lit("KIEN_NGHI"))))
    return F.when(F.size(tags) == 0, F.array(F.lit("CHUYEN_NGANH"))).otherwise(tags)


def is_periodic(page_one: Column) -> Column:
    return page_one.rlike(web_regex("tháng|quý|năm|định kỳ|tuần|sơ kết|tổng kết"))


def urgency(page_one: Column, text: Column) -> Column:
    p, t = F.lower(page_one), F.lower(text)
    return first_case([(has_any(p, ["hỏa tốc", "thượng khẩn"]), "HOA_TOC"), (has_any(p, ["văn bản khẩn", "công văn khẩn", "khẩn cấp", "sự cố khẩn"]) | has_any(t, ["thiên tai khẩn cấp", "sự cố khẩn cấp", "thiên tai", "ngập lụt"]), "KHAN")], "THUONG")


def reporting_period(text: Column) -> Column:
    found = F.regexp_extract(text, web_regex(r"(tháng\s+\d{1,2}(?:\s*/\s*|\s+năm\s+)\d{4}|quý\s+[IVX\d]+(?:\s*/\s*|\s+năm\s+)\d{4}|năm\s+\d{4})"), 1)
    return F.when(found != "", found).otherwise("Kỳ báo cáo")


def issuance_date(text: Column) -> Column:
    """YYYY-MM-DD from 'ngày d tháng m năm y'; a missing day is 01."""
    p = web_regex(r"ngày\s*(\d{0,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})")
    d, m, y = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(F.when(d == "", "01").otherwise(d), 2, "0")))


def document_number(text: Column) -> Column:
    found = F.regexp_extract(text, web_regex(r"Số\s*:?\s*(\d*\s*/\s*[0-9A-ZĐ\-]+(?:[-/][0-9A-ZĐ\-]+)*)"), 1)
    return F.when(found != "", F.regexp_replace(found, SPACE_CLASS, ""))


# --------------------------------------------------------------------------- text


def clean_text(c: Column) -> Column:
    """Markup, tags of severity and page, emoji and doubled punctuation removed."""
    steps = [
        (web_regex(r"\[\s*(?:CRITICAL|HIGH|MEDIUM|LOW|NGHIEM_TRONG|CAO|TRUNG_BINH|THAP|CAN_XU_LY|CẦN XỬ LÝ)\s*\]"), ""),
        (web_regex(r"\[\s*(?:Trang|Page)\s*[^\]]+\]"), ""),
        (web_regex(r"\(\s*Mức độ\s*:\s*[^)]+\)"), ""),
        (web_regex(r"\[\s*(Quyết định|Chỉ đạo)\s*:\s*([^\]]+)\]"), "$1: $2"),
        (r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE00}-\x{FE0F}]", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"(?m)^#+\s+", ""),
        (r"\(\s*\)|\[\s*\]", ""),
        (f"{SPACE_CLASS}+", " "),
        (r" ([.,;:!?])", "$1"),
        (r"([.,;:!?])\s*\1+", "$1"),
        ("�", ""),
    ]
    return web_trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, F.coalesce(c, F.lit(""))))


def csv_cell(c: Column) -> Column:
    """A quoted cell that no spreadsheet takes for a formula."""
    text = F.replace(web_trim(c), F.lit('"'), F.lit('""'))
    return F.when(c.isNull(), '""').otherwise(F.concat(F.lit('"'), F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text), F.lit('"')))


def vn_format(number: Column) -> Column:
    """Vietnamese digit grouping with at most three decimals."""
    text = F.format_number(F.round(number, 3), 3)
    return F.regexp_replace(F.regexp_replace(F.translate(text, ",.", ".,"), r"(,\d*?)0+$", "$1"), ",$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE_CLASS}+", " "))


def normal_snippet(c: Column) -> Column:
    """Snippet form for matching: joined hyphenation, single spaces, no leading bullet, lower case."""
    return F.lower(web_trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"-\s*\n\s*", ""), f"{SPACE_CLASS}+", " "), r"^[-*•+\d.)\s]+", "")))


def error_rate(expected: Column, actual: Column) -> Column:
    """Edit distance over the expected length, at most 1; spaces collapsed."""
    e, a = squeeze(expected), squeeze(actual)
    return F.when(F.length(e) == 0, F.when(F.length(a) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(e, a) / F.length(e)))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of (x0, y0, x1, y1) boxes."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / union)


def word_boxes(text: Column, x0: Column, x1: Column) -> Column:
    """An OCR line's words with equal shares of its width."""
    words = F.filter(F.split(squeeze(text), " "), lambda w: w != "")
    share = (x1 - x0) / F.size(words)
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), (x0 + share * i).alias("x0"), (x0 + share * (i + 1)).alias("x1")))


def rotation(dx: Column, dy: Column) -> Column:
    return F.round(F.degrees(F.atan2(dy, dx)), 1)


def block_type(top: Column, bottom: Column, height: Column, heading: Column, watermark: Column) -> Column:
    return first_case([(watermark, "WATERMARK"), (top < 70, "HEADER"), (bottom > height - 60, "FOOTER"), (heading, "HEADING_1")], "PARAGRAPH")


def header_similar(a: Column, b: Column) -> Column:
    """Whether at least three fifths of the headers of a equal those of b or are contained in them."""
    hit = F.zip_with(a, b, lambda x, y: F.coalesce((F.lower(F.trim(x)) == F.lower(F.trim(y))) | ((F.length(x) > 2) & F.contains(F.lower(F.trim(y)), F.lower(F.trim(x)))), F.lit(False)).cast("int"))
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.aggregate(hit, F.lit(0), lambda s, x: s + x) >= F.greatest(F.lit(1), F.floor(F.size(a) * 0.6)))


# fixed values: letters without their marks
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


def file_stem(title: Column, most: int = 50) -> Column:
    flat = F.translate(title, MARKED + MARKED.upper(), PLAIN + PLAIN.upper())
    return F.substring(F.regexp_replace(F.regexp_replace(flat, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def content_disposition(name: Column) -> Column:
    return F.concat(F.lit("attachment; filename*=UTF-8''"), F.regexp_replace(F.url_encode(name), r"\+", "%20"))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
