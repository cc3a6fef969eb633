"""Queries over documents and tables made from the orders, with their SQL. The Spark side runs the
operators on the made texts; the SQL side states what must come out of each kind of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import evidence as E
from ..operators import export as X
from ..operators import legacy as L
from ..operators import metadata as M
from ..operators import ranking as R
from ..operators import tables as T
from ..operators import textops as TX
from ..operators import warehouse as W
from ..sources.taxonomy import TAXONOMY
from ..streaming import ingest as I
from .catalog import query, read

NL = "chr(10)"


def words(template: str):
    """A text with {s} status, {c} customer, {p} priority, {d} {m} {y} date, {o} order, {n} price."""
    parts = {"s": F.col("o_orderstatus"), "c": F.col("o_custkey").cast("string"), "p": F.col("o_orderpriority"), "d": F.dayofmonth("o_orderdate").cast("string"), "m": F.month("o_orderdate").cast("string"), "y": F.year("o_orderdate").cast("string"), "o": F.col("o_orderkey").cast("string"), "n": F.floor("o_totalprice").cast("string")}
    out = F.lit(template)
    for k, v in parts.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), v)
    return out


def by_kind(of: int, **kinds: str):
    """The text of an order's kind, o_orderkey modulo `of`."""
    return S.first_case([(F.col("o_orderkey") % of == int(k[1:]), words(t)) for k, t in kinds.items()], F.lit(None).cast("string"))


def made_from(spark, sf) -> DataFrame:
    """What texts are made from of the orders, dealt over all cores before they are made."""
    return TX.spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice"), "o_orderkey")


PAGE_ONE = {
    "k0": "UBND TỈNH {s}\nSố: {c}/BC-UBND\n{s}, ngày {d} tháng {m} năm {y}\nBÁO CÁO\nTình hình {p}\nmục {c}.\nKính gửi: X",
    "k1": "PHỤ LỤC {c}\nBiểu {s}\nTT\nx",
    "k2": "SỞ {s}\nV/v {p} đợt {c}\nTT",
}
PAGE_TWO = "Nơi nhận:\n- Sở {s};\n- Lưu: VT;\nHết\nTM. UBND\nGIÁM ĐỐC\nNguyễn Văn {s}"


@query("""SELECT o_orderkey AS doc_id, CASE k WHEN 0 THEN 'BÁO CÁO Tình hình ' || o_orderpriority || ' mục ' || o_custkey || '.' WHEN 1 THEN 'PHỤ LỤC ' || o_custkey || ' - Biểu ' || o_orderstatus ELSE 'Công văn: ' || o_orderpriority || ' đợt ' || o_custkey || ' TT' END AS title,
 CASE k WHEN 1 THEN 'PHU_LUC' ELSE 'BAO_CAO' END AS kind, CASE k WHEN 0 THEN o_custkey || '/BC-UBND' END AS number, CASE k WHEN 0 THEN 'UBND TỈNH ' || o_orderstatus WHEN 1 THEN 'ỦY BAN NHÂN DÂN' ELSE 'SỞ ' || o_orderstatus END AS authority,
 CASE k WHEN 1 THEN 'Cơ quan cấp trên / Lãnh đạo UBND' ELSE 'Sở ' || o_orderstatus END AS receiver, CASE k WHEN 1 THEN 'Lãnh đạo cơ quan' ELSE 'Sở ' || o_orderstatus || '|Lưu: VT' END AS recipients, CASE k WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS issued,
 CASE k WHEN 0 THEN 'tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) ELSE 'Kỳ báo cáo' END AS period, k = 1 AS pure, CASE k WHEN 1 THEN NULL ELSE 'Nguyễn Văn ' || o_orderstatus END AS signer, CASE k WHEN 1 THEN NULL ELSE 'TM. UBND' || chr(10) || 'GIÁM ĐỐC' END AS signer_title FROM (SELECT *, o_orderkey % 3 AS k FROM orders)""")
def metadata_record(spark, sf):
    o = made_from(spark, sf)
    one = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), by_kind(3, **PAGE_ONE).alias("text"), F.when(F.col("o_orderkey") % 3 == 1, 1).otherwise(0).alias("n_tables"))
    two = o.filter("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("page"), words(PAGE_TWO).alias("text"), F.lit(0).alias("n_tables"))
    m = M.document_metadata(one.union(two))
    return m.select("doc_id", F.col("document_title").alias("title"), F.col("document_type").alias("kind"), F.col("document_number").alias("number"), F.col("issuing_authority").alias("authority"), F.col("receiving_authority").alias("receiver"), F.array_join("recipients", "|").alias("recipients"), F.col("issuance_date").alias("issued"), F.col("reporting_period").alias("period"), F.col("is_pure_table").alias("pure"), F.col("signer.name").alias("signer"), F.col("signer.title").alias("signer_title"))


def raw_tables(spark, sf) -> DataFrame:
    """One table an order, of eight kinds: valid, and one for each of seven reasons to reject."""
    cell = lambda t: words(t)
    grid = lambda *rows: F.array(*[F.array(*[cell(c) for c in r]) for r in rows])
    kinds = [
        grid(["STT", "Chỉ tiêu", "Kế hoạch", "Thực hiện"], ["1", "Khách {c}", "100", "50"], ["2", "Loại {p}", "80", "60"], ["Tổng cộng", "", "180", "{n}"]),
        grid(["STT"], ["{c}"], ["{n}"]),
        grid(["UBND TỈNH {s}", "CỘNG HÒA XÃ HỘI"], ["Số: {c}", "ĐỘC LẬP - TỰ DO"]),
        grid(["STT", "Nội dung"], ["- mục {c} dài", "chữ {p}"], ["- mục hai dài", "chữ khác"]),
        grid(["Tên đơn vị", "Địa chỉ"], ["Phòng {s}", "Nhà {c}"]),
        grid(["STT", "Nội dung {p}", "", ""], ["1", "khách {c}", "", ""], ["2", "dòng hai", "", ""]),
        grid(["a", "b"], ["{s}", "1"], ["2", "3"]),
        grid(["BÁO CÁO {p}", "tháng {m}"], ["về khách {c}", "năm {y}"]),
    ]
    table = S.first_case([(F.col("o_orderkey") % 8 == i, g) for i, g in enumerate(kinds)], F.lit(None).cast("array<array<string>>"))
    # through a generator, so that no rule copies the making of the texts into each use of them
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice", F.explode(F.array(table)).alias("g"))
    return o.select((F.col("o_orderkey") % 1000).alias("doc_id"), F.col("o_orderkey").alias("ord"), F.lit(None).cast("string").alias("table_id"), F.when(F.col("o_orderkey") % 16 == 0, words("Bảng {o}")).alias("table_title"), F.get("g", F.lit(0)).alias("headers"), F.expr("slice(g, 2, 100)").alias("rows"), F.lit(0).alias("page_ref"))


@query("""SELECT o_orderkey AS ord, CASE o_orderkey % 8 WHEN 1 THEN 'SHAPE' WHEN 2 THEN 'LETTERHEAD' WHEN 3 THEN 'BULLETS' WHEN 4 THEN 'TWO_ROWS' WHEN 5 THEN 'EMPTY_COLUMNS' WHEN 6 THEN 'TOO_LITTLE' WHEN 7 THEN 'HEADING_OR_SIGN_OFF' ELSE 'VALID' END AS verdict FROM orders""")
def table_verdicts(spark, sf):
    return raw_tables(spark, sf).select("ord", F.coalesce(T.reject_reason(F.col("headers"), F.col("rows")), F.lit("VALID")).alias("verdict"))


@query("""SELECT doc_id, n, 'tbl-' || n AS table_id, CASE WHEN o % 16 = 0 THEN 'Bảng ' || o ELSE 'Bảng số liệu #' || n END AS table_title, 3 AS row_count, 4 AS col_count, 1 AS page_ref FROM (SELECT o_orderkey AS o, o_orderkey % 1000 AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 1000 ORDER BY o_orderkey)::INTEGER AS n FROM orders WHERE o_orderkey % 8 = 0)""")
def valid_tables(spark, sf):
    return T.valid_tables(raw_tables(spark, sf)).select("doc_id", "n", "table_id", "table_title", "row_count", "col_count", "page_ref")


@query("""SELECT o_orderkey % 1000 AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 16 = 0 THEN 'Bảng ' || o_orderkey ELSE 'Bảng số liệu' END || ': Tổng cộng' AS indicator, floor(o_totalprice)::BIGINT::VARCHAR AS actual, '180' AS plan_target, 'THUC_HIEN_THUC_TE' AS data_nature
 FROM orders WHERE o_orderkey % 8 = 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey % 1000, CASE WHEN o_orderkey % 16 = 0 THEN o_orderkey ELSE -1 END, floor(o_totalprice) ORDER BY o_orderkey) = 1""")
def summary_metrics(spark, sf):
    return T.summary_metrics(raw_tables(spark, sf)).select("doc_id", "ord", "indicator", "actual", "plan_target", "data_nature")


@query("""WITH t AS (SELECT o_orderkey AS table_id, o_orderkey % 8 AS k, floor(o_totalprice) AS n, o_orderstatus AS s, o_orderpriority AS p, month(o_orderdate) AS m FROM orders)
 SELECT table_id, CASE k WHEN 0 THEN 3 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 7 THEN 1 ELSE 2 END AS row_count, CASE k WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 5 THEN 4 ELSE 2 END AS col_count,
 CASE k WHEN 0 THEN '| STT | Chỉ tiêu | Kế hoạch | Thực hiện |' WHEN 1 THEN '| STT |' WHEN 2 THEN '| UBND TỈNH ' || s || ' | CỘNG HÒA XÃ HỘI |' WHEN 3 THEN '| STT | Nội dung |' WHEN 4 THEN '| Tên đơn vị | Địa chỉ |' WHEN 5 THEN '| STT | Nội dung ' || p || ' |  |  |' WHEN 6 THEN '| a | b |' ELSE '| BÁO CÁO ' || p || ' | tháng ' || m || ' |' END AS head,
 CASE WHEN k = 0 AND n > 0 AND abs(n - 110) / n > 0.015 AND abs(n - 110) > 0.5 THEN 'SUM_MISMATCH:3' ELSE '' END AS findings FROM t""")
def processed_tables(spark, sf):
    t = T.process_tables(raw_tables(spark, sf).select(F.col("ord").alias("table_id"), "headers", "rows"))
    return t.select("table_id", "row_count", "col_count", F.substring_index("markdown", "\n", 1).alias("head"), F.array_join(F.transform("findings", lambda x: F.concat(x["finding"], F.lit(":"), x["col_index"].cast("string"))), ",").alias("findings"))


@query("""SELECT o_orderkey AS doc_id, 0 AS row_index, 3 AS col_index, floor(n / 200.0 * 1000 + 0.5) / 10 AS expected, 50.0 AS actual FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS n FROM orders)
 WHERE abs(floor(n / 200.0 * 1000 + 0.5) / 10 - 50) > 3.0 AND abs(floor(n / 200.0 * 1000 + 0.5) / 10 - 50) / CASE WHEN floor(n / 200.0 * 1000 + 0.5) = 0 THEN 1 ELSE floor(n / 200.0 * 1000 + 0.5) / 10 END > 0.03""")
def percent_audit_by_header(spark, sf):
    rows = F.array(F.array(F.lit("A"), F.lit("200"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("50%")))
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), F.array(*[F.lit(x) for x in ("Đơn vị", "Giao năm", "Đã làm", "Tỷ trọng kế hoạch")]).alias("headers"), rows.alias("rows"))
    return T.percent_audit(t).select(F.col("table_id").alias("doc_id"), "row_index", "col_index", "expected", "actual")


@query("SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 16 IN (12, 14) THEN NULL WHEN o_orderkey % 8 = 2 THEN 'HEADER' END AS layout, CASE WHEN o_orderkey % 16 IN (12, 14) THEN 'SIGNATURE' ELSE 'BUSINESS' END AS kind FROM orders")
def table_kinds(spark, sf):
    """The tables of raw_tables; one in eight has its header, or a row, made one of signatures."""
    k = F.col("ord") % 16
    heads = F.when(k == 12, F.array(F.lit("STT"), F.lit("Người ký"), F.lit("Thời gian ký"))).otherwise(F.col("headers"))
    rows = F.when(k == 14, F.array(F.array(F.lit("1"), F.lit("Đã đóng dấu")), F.array(F.lit("Thời gian ký"), F.lit("x")))).otherwise(F.col("rows"))
    t = raw_tables(spark, sf).withColumn("headers", heads).withColumn("rows", rows)
    return t.select("ord", T.layout_table(F.concat(F.array("headers"), F.col("rows"))).alias("layout"), T.table_kind(F.col("headers"), F.col("rows")).alias("kind"))


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN 'Đã đóng dấu & ban hành' WHEN o_orderkey % 3 = 0 THEN 'Đã phê duyệt' WHEN o_orderkey % 3 = 1 THEN 'Thống nhất nội dung' ELSE 'Đã đóng dấu & ký số' END AS verdict, strftime(o_orderdate, '%d/%m/%Y') || CASE WHEN o_orderkey % 2 = 0 THEN ' 10:20:30' ELSE '' END AS signed, CASE WHEN o_orderkey % 2 = 0 THEN 'Đơn vị ban hành văn bản' ELSE 'Trưởng phòng' END AS unit FROM orders""")
def signature_rows(spark, sf):
    o = F.col("o_orderkey")
    said = F.when(o % 3 == 0, "1 : 2").when(o % 3 == 1, "Thống  nhất").otherwise("đã đóng dấu")
    row = F.array(F.lit("2"), F.concat(F.when(o % 2 == 0, F.lit("Công ty  ")).otherwise("Ông "), F.col("o_orderstatus")), F.when(o % 2 == 0, "").otherwise("Trưởng phòng"), F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.when(o % 2 == 0, " - 10:20:30").otherwise("")), said)
    x = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), T.signature_row(row).alias("x"))
    return x.select("doc_id", F.substring("x.verdict", 3, 100).alias("verdict"), F.col("x.time").alias("signed"), F.col("x.unit").alias("unit"))


LOOSE = {"k0": "Tổng khách là {c} hộ\nx", "k1": "- Thu ngân sách: {n} tỷ đồng", "k2": "Rừng {s} khoảng {c} ha\nĐường {p} có {n} km\nCầu có 7\nĐập lớn có 8"}


@query("""WITH t AS (SELECT *, o_orderkey % 3 AS k, floor(o_totalprice)::BIGINT::VARCHAR AS n FROM orders) SELECT o_orderkey AS doc_id, 1 AS n, 'Tổng khách' AS indicator, o_custkey::VARCHAR AS actual, 'hộ' AS unit FROM t WHERE k = 0
 UNION ALL SELECT o_orderkey, 1, 'Rừng ' || o_orderstatus, o_custkey::VARCHAR, 'ha' FROM t WHERE k = 2 UNION ALL SELECT o_orderkey, 2, 'Đường ' || o_orderpriority, n, 'km' FROM t WHERE k = 2 AND NOT contains(o_orderpriority, '.') UNION ALL SELECT o_orderkey, 3, 'Đập lớn', '8', NULL FROM t WHERE k = 2""")
def fallback_metrics(spark, sf):
    docs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), by_kind(3, **LOOSE).alias("text"))
    return TX.fallback_metrics(docs, TX.metrics(docs)).select("doc_id", "n", "indicator", "actual", "unit")


ASKED = {"k0": "mở đầu\nĐề nghị tỉnh bố trí {n} cho khách {c}\nKiến nghị lần hai của khách", "k1": "Đề nghị ngắn\nTiếp tục rà soát khách hàng {c}"}


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS is_required, CASE WHEN o_orderkey % 3 = 0 THEN 'Xem xét phê duyệt kiến nghị: Đề nghị tỉnh bố trí ' || floor(o_totalprice)::BIGINT || ' cho khách ' || o_custkey ELSE 'Báo cáo theo dõi phục vụ chỉ đạo điều hành' END AS decision_summary, CASE WHEN o_orderkey % 3 = 0 THEN 'XEM_XET_CHO_CHU_TRUONG' ELSE 'BAO_CAO_DE_BIET' END AS action_verb FROM orders""")
def decisions_needed(spark, sf):
    docs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), by_kind(3, **ASKED).alias("text"))
    return TX.decisions_needed(docs, TX.recommendations(docs)).select("doc_id", "is_required", "decision_summary", "action_verb")


@query("""SELECT o_orderkey AS doc_id, 1 AS n, CASE WHEN o_orderkey % 3 = 1 THEN 'Tiếp tục rà soát khách hàng ' || o_custkey ELSE 'Tổ chức triển khai các nhiệm vụ, giải pháp trọng tâm theo ' || o_orderpriority END AS action_title, CASE WHEN o_orderkey % 3 = 1 THEN 'PHYSICAL' ELSE 'SYNTHETIC' END AS provenance FROM orders""")
def actions_or_default(spark, sf):
    docs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), by_kind(3, **ASKED).alias("text"), F.col("o_orderpriority").alias("document_title"))
    return TX.actions_or_default(docs, docs.select("doc_id", "document_title"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus || chr(10) || 'bản thảo luận dài hơn hai mươi lăm ký tự: mật' WHEN 1 THEN 'x' || o_custkey ELSE o_orderpriority END AS body FROM orders""")
def body_lines(spark, sf):
    text = by_kind(3, k0="DRAFT {c}\n{s}\nbản thảo luận dài hơn hai mươi lăm ký tự: mật", k1="[Bảng: {s}]\nx\u00ad{c}\na | {c} | b", k2="Tài liệu mật\n\u00a0{p} \n\nTT | Chỉ tiêu")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_join(TX.body_lines(text), "\n").alias("body"))


@query("""SELECT o_orderkey AS doc_id, o_custkey AS sid, CASE o_orderkey % 3 WHEN 0 THEN 'b1' WHEN 1 THEN 'b0' ELSE 'p1_b1' END AS evidence_ref, CASE o_orderkey % 3 WHEN 0 THEN 'PHYSICAL' WHEN 1 THEN 'SYNTHETIC' ELSE 'FALLBACK' END AS provenance, CASE o_orderkey % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 10.0 ELSE 100.0 END AS top FROM orders""")
def snippet_blocks(spark, sf):
    o = read(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("sid"), F.lit(1).alias("page"), words("khách hàng {c} đợt {p}").alias("snippet"))
    box = lambda y: F.array(F.lit(0.0), F.lit(y), F.lit(10.0), F.lit(y + 5))
    text = F.when(F.col("o_orderkey") % 3 == 0, words("Tổng khách hàng {c} đợt {p} năm {y}")).otherwise("không liên quan")
    b = o.filter("o_orderkey % 3 < 2")
    first = b.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("ord"), F.lit("b0").alias("block_id"), F.lit("mở").alias("text"), box(10.0).alias("box"))
    second = b.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("ord"), F.lit("b1").alias("block_id"), text.alias("text"), box(20.0).alias("box"))
    return E.locate_blocks(s, first.union(second)).select("doc_id", "sid", "evidence_ref", "provenance", F.get("box", F.lit(1)).alias("top"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Số: ' || o_custkey || '/BC' ELSE 'ngày ' || day(o_orderdate) || ' tháng 2' END AS text FROM orders""")
def gaps_filled(spark, sf):
    o = read(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 2)
    left, right = F.when(F.col("k") == 0, "Số:").otherwise("ngày"), F.when(F.col("k") == 0, "/BC").otherwise("tháng")
    mid = F.when(F.col("k") == 0, F.col("o_custkey").cast("string")).otherwise(F.dayofmonth("o_orderdate").cast("string"))
    word = lambda n, t, x0, x1, y: F.struct(F.lit(n).alias("word_no"), t.alias("text"), F.lit(x0).alias("x0"), F.lit(y).alias("y0"), F.lit(x1).alias("x1"), F.lit(y + 10.0).alias("y1"))
    w = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(word(0, left, 10.0, 25.0, 100.0), word(1, right, 60.0, 90.0, 100.0), word(2, mid, 30.0, 50.0, 103.0), word(3, F.lit("xa"), 30.0, 50.0, 200.0))).alias("w")).select("doc_id", "page", "w.*")
    b = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block_no"), F.when(F.col("k") == 0, "Số:      /BC").otherwise("ngày   tháng 2").alias("text"), F.lit(5.0).alias("x0"), F.lit(98.0).alias("y0"), F.lit(95.0).alias("x1"), F.lit(114.0).alias("y1"))
    g = E.gap_words(w, b).join(b, ["doc_id", "page", "block_no"])
    return g.select("doc_id", E.filled_text(F.col("text"), F.col("gap"), F.col("filling")).alias("text"))


@query("""SELECT l_suppkey AS doc_id, l_linenumber AS page, b AS block_no, count(*) AS words FROM (SELECT l_suppkey, l_linenumber, l_quantity AS x FROM lineitem), (VALUES (0, 1, 20), (1, 15, 40)) AS t(b, lo, hi) WHERE x >= lo - 2 AND x + 1 <= hi + 2 GROUP BY 1, 2, 3""")
def block_words(spark, sf):
    at = ["doc_id", "page"]
    w = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.monotonically_increasing_id().alias("word_no"), F.lit("w").alias("text"), F.col("l_quantity").alias("x0"), F.lit(1.0).alias("y0"), (F.col("l_quantity") + 1).alias("x1"), F.lit(2.0).alias("y1"))
    b = w.select(*at).distinct().select(*at, F.explode(F.array(*[F.struct(F.lit(i).alias("block_no"), F.lit(lo).alias("x0"), F.lit(0.0).alias("y0"), F.lit(hi).alias("x1"), F.lit(4.0).alias("y1")) for i, lo, hi in ((0, 1.0, 20.0), (1, 15.0, 40.0))])).alias("b")).select(*at, "b.*")
    return E.words_in_blocks(w, b).groupBy(*at, "block_no").agg(F.count("*").alias("words"))


@query("""WITH e AS (SELECT user_id AS d, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT d, count(*) AS truth, count(*) FILTER (t IN ('click', 'view')) AS tp FROM e GROUP BY 1)
 SELECT d AS doc_id, truth, 2::BIGINT AS found, tp, tp / 2.0 AS "precision", tp / truth AS recall, CASE WHEN tp > 0 THEN 2 * (tp / 2.0) * (tp / truth) / (tp / 2.0 + tp / truth) ELSE 0.0 END AS f1 FROM f""")
def kpi_matches(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_type").distinct()
    got = e.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("Tổng CLICK"), F.lit("VIEW"))).alias("indicator"))
    return A.kpi_matches(e.withColumnRenamed("event_type", "indicator"), got)


@query("SELECT p_partkey, (contains(lower(p_type), 'steel') OR contains(lower(p_name), 'red'))::INT + contains(lower(p_name), 'red')::INT AS hits FROM (SELECT p_partkey, p_name, 'x' AS p_type FROM part)")
def header_matches(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", A.header_hits(F.array(F.lit("RED"), F.lit("Red")), F.array(F.col("p_name"), F.lit("Z"))).alias("hits"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS perfect, count(*) FILTER (o_orderstatus = 'O') AS warning, count(*) FILTER (o_orderstatus = 'P') AS error, 0::BIGINT AS failed FROM orders")
def audit_statuses(spark, sf):
    return A.status_counts(read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "PERFECT").when(F.col("o_orderstatus") == "O", "WARNING").otherwise("ERROR").alias("status")))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS skipped, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*) FILTER (o_orderstatus <> 'P'), 1) AS pass_percent FROM orders")
def run_results(spark, sf):
    return A.run_rollup(read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL").otherwise("UNSUPPORTED_FORMAT").alias("status")))


@query("""SELECT doc_id, floor((length(t) / greatest(src, 1)::DOUBLE) * 100 + 0.5)::BIGINT AS kept_percent, CASE WHEN contains(t, chr(65533)) OR regexp_matches(t, '\\b(?i:undefined)\\b') OR regexp_matches(t, '\\bNaN\\b') THEN 'ERROR' WHEN length(t) / greatest(src, 1)::DOUBLE < 0.6 AND src > 500 THEN 'WARNING' ELSE 'PERFECT' END AS status
 FROM (SELECT doc_id, n_chars * (2 - doc_id % 2) AS src, CASE WHEN doc_id % 5 = 0 THEN text || ' NaN' ELSE text END AS t FROM documents)""")
def text_kept(spark, sf):
    d = read(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" NaN"))).otherwise(F.col("text"))
    return A.text_preservation(d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") * 2).otherwise(F.col("n_chars")).alias("source_chars"), text.alias("text"))).select("doc_id", F.col("kept_percent").cast("long").alias("kept_percent"), "status")


@query("""SELECT o_orderkey AS doc_id, n, metric_name, actual_value, status FROM (SELECT o_orderkey, 1 AS n, 'Thu ngân sách địa phương' AS metric_name, o_custkey || ' tỷ' AS actual_value, 'GREEN' AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 2, 'Tỷ lệ hoàn thành chỉ tiêu', (o_custkey % 100) || '%', CASE WHEN o_custkey % 100 < 70 THEN 'RED' ELSE 'GREEN' END FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'Tiến độ thực hiện nhiệm vụ', '100%', 'GREEN' FROM orders WHERE o_orderkey % 2 = 1)""")
def legacy_metrics(spark, sf):
    o = read(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(words("Thu ngân sách ước {c} tỷ và đạt "), (F.col("o_custkey") % 100).cast("string"), F.lit("%"))).otherwise("không có")
    return L.legacy_metrics(o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))).select("doc_id", "n", "metric_name", "actual_value", "status")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'NEEDS_ATTENTION' ELSE 'GOOD' END AS overall_evaluation, CASE WHEN o_orderkey % 2 = 0 THEN 'khách hàng ' || o_custkey || ' còn thiếu vốn đầu tư cho các công trình trọng điểm' END AS bottleneck, CASE WHEN o_orderkey % 2 = 0 THEN 'Tiếp tục rà soát hồ sơ của khách hàng ' || o_custkey ELSE 'Tổ chức triển khai phương hướng nhiệm vụ của báo cáo ' || o_orderpriority END AS first_task FROM orders""")
def legacy_records(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, words("Khó khăn: khách hàng {c} còn thiếu vốn đầu tư cho các công trình trọng điểm\n2. Phương hướng\n- Tiếp tục rà soát hồ sơ của khách hàng {c}")).otherwise("không có")
    d = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), text.alias("text"))
    return L.legacy_records(d).select("doc_id", "overall_evaluation", "bottleneck", F.get("tasks", F.lit(0))["task_title"].alias("first_task"))


@query("""WITH c AS (SELECT user_id AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT d.u AS d, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id AS u FROM events UNION SELECT c_custkey FROM customer) d LEFT JOIN c ON c.d = u)
 SELECT d AS doc_id, i + 1 AS place, CASE WHEN i < n THEN 'card' WHEN i - n = 0 AND n = 0 THEN '3 chỉ tiêu đã được số hóa và chuẩn hóa' WHEN n = 1 THEN '3 chỉ tiêu đã được số hóa và chuẩn hóa' ELSE '4 nhiệm vụ tiếp theo' END AS title FROM a, (SELECT unnest(range(8))::INTEGER AS i) WHERE i < greatest(2, least(n, 8))""")
def cards_with_fallback(spark, sf):
    e = read(spark, sf, "events")
    p = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.lit("card").alias("title"))
    none = p.limit(0)
    shown = R.cards(none, none, none.withColumn("severity", F.lit("")), none, none.withColumns({"actual": F.lit(""), "status": F.lit("")}), p)
    docs = e.select(F.col("user_id").alias("doc_id")).union(read(spark, sf, "customer").select("c_custkey")).distinct()
    return R.cards_with_fallback(shown, docs.select("doc_id", F.lit(3).alias("metrics"), F.lit(4).alias("actions"))).select("doc_id", "place", "title")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS primary_domain FROM orders WHERE contains(lower(o_orderstatus), 'f') OR contains(lower(o_orderpriority), 'f') OR contains(lower(o_orderpriority), 'urg')")
def domain_filter(spark, sf):
    r = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("primary_domain"), F.array("o_orderpriority").alias("domain_tags"))
    return W.domain_filter(W.domain_filter(r, "").filter(F.lit(True)), "F").select("id", "primary_domain").union(W.domain_filter(r, "uRG").select("id", "primary_domain")).distinct()


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderstatus AS sa, b.o_orderstatus AS sb FROM orders a, orders b WHERE a.o_orderkey = 7 AND b.o_orderkey = 11")
def report_pair(spark, sf):
    r = read(spark, sf, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    return A.report_pair(r, "7", "11").select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), F.col("a.o_orderstatus").alias("sa"), F.col("b.o_orderstatus").alias("sb"))


@query("SELECT c_custkey AS ord, c_custkey % 3 <> 0 AS is_complete FROM customer WHERE c_custkey % 3 = 0 OR c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_custkey LIMIT (SELECT count(*) - 49 FROM customer))")
def retained_batches(spark, sf):
    b = read(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 3 != 0).alias("is_complete"))
    return I.retained(b, 50)


ROLES = {"TOTAL": ["Tổng cộng", "cộng", "Tổng thu ngân sách"], "SUBTOTAL": ["Cộng mục I", "Tiểu kết", "mục này cộng lại"], "BREAKDOWN": ["Trong đó", "- trong đó: A", "bao gồm các mục"], "BASE_ITEM": ["Thu ngân sách", "", "I"]}
LISTED = [(name, role) for role, names in ROLES.items() for name in names]


LISTED_SQL = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(LISTED)), " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(LISTED))


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(LISTED)} {LISTED_SQL[0]} END AS cell, CASE o_orderkey % {len(LISTED)} {LISTED_SQL[1]} END AS role FROM orders")
def row_roles(spark, sf):
    names = S.first_case([(F.col("o_orderkey") % len(LISTED) == i, F.lit(n)) for i, (n, _) in enumerate(LISTED)], F.lit(None).cast("string"))
    return read(spark, sf, "orders").select("o_orderkey", names.alias("cell"), S.row_role(names).alias("role"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Vốn đầu tư' WHEN 1 THEN 'Nhân sự' WHEN 2 THEN 'Thi công và vật liệu' ELSE 'KHAC' END AS label, CASE p_partkey % 4 WHEN 0 THEN 'DAU_TU_CONG' WHEN 1 THEN 'NGAN_SACH,KIEN_NGHI' WHEN 2 THEN 'Y_TE' ELSE 'CHUYEN_NGANH' END AS tags, p_partkey % 4 = 1 AS periodic, CASE p_partkey % 4 WHEN 2 THEN 'KHAN' WHEN 3 THEN 'HOA_TOC' ELSE 'THUONG' END AS urgency FROM part")
def document_flags(spark, sf):
    k = F.col("p_partkey") % 4
    cause = F.when(k == 0, "chậm giải ngân").when(k == 1, "thiếu cán bộ").when(k == 2, "giá cát tăng").otherwise("x")
    text = F.when(k == 0, "đầu tư công").when(k == 1, "quyết toán theo quý và đề xuất").when(k == 2, "khám chữa bệnh, sự cố khẩn cấp").otherwise("hỏa tốc")
    return read(spark, sf, "part").select("p_partkey", S.category_label(S.bottleneck_category(cause)).alias("label"), F.array_join(S.domain_tags(text), ",").alias("tags"), S.is_periodic(text).alias("periodic"), S.urgency(text, text).alias("urgency"))


@query("SELECT l_orderkey, l_linenumber, replace(replace(replace(rtrim(rtrim(format('{:,.2f}', l_extendedprice), '0'), '.'), ',', '#'), '.', ','), '#', '.') AS shown FROM lineitem")
def vn_numbers(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.vn_format(F.col("l_extendedprice")).alias("shown"))


@query("SELECT o_orderkey, 'attachment; filename*=UTF-8''''B%C3%A1o%20' || replace(o_orderpriority, ' ', '%20') AS header FROM orders")
def disposition(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", S.content_disposition(F.concat(F.lit("Báo "), "o_orderpriority")).alias("header"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS similar, CASE WHEN o_orderkey % 2 = 0 THEN '{\"Năm ' || year(o_orderdate) || '\":2,\"STT\":1}' ELSE '{\"STT\":1}' END AS tree, o_orderkey % 2 = 1 AS sub_header FROM orders")
def header_rules(spark, sf):
    k = F.col("o_orderkey") % 3
    a = F.array(F.lit("Tên"), F.when(k == 0, "Kế hoạch").otherwise("Khác hẳn"), F.lit("Số"))
    b = F.array(F.when(k == 2, "Ghi chú").otherwise("tên đơn vị"), F.lit("KẾ HOẠCH"), F.when(k == 1, "số").otherwise("tổng"))
    year = words("Năm {y}")
    heads = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(year, F.lit(" - Kế hoạch")), F.lit("STT"), F.concat(year, F.lit(" - Thực hiện")))).otherwise(F.array(F.lit("STT")))
    tree = F.transform_values(T.header_tree(heads), lambda _, v: F.size(v))
    sub = T.sub_header(F.array(F.array(F.lit(""), F.when(F.col("o_orderkey") % 2 == 1, "Kế hoạch").otherwise("Phường")), F.array(F.lit("1"), F.lit("x"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(tree)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))
    return read(spark, sf, "orders").select("o_orderkey", S.header_similar(a, b).alias("similar"), text.alias("tree"), sub.alias("sub_header"))


@query("SELECT l_orderkey AS doc_id, 0 AS row_no, CASE l_linenumber % 3 WHEN 0 THEN 'TOTAL' WHEN 1 THEN 'SECTION' ELSE 'DATA' END AS row_class, l_linenumber AS ord, false AS has_sub_header FROM lineitem")
def layout_rows(spark, sf):
    k = F.col("l_linenumber") % 3
    row = F.when(k == 0, F.array(F.lit(""), F.lit("Tổng số"), F.col("l_returnflag"))).when(k == 1, F.array(F.lit("II"), F.col("l_returnflag"), F.lit(""))).otherwise(F.array(F.lit("1"), F.col("l_returnflag"), F.lit("2")))
    t = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.array(row).alias("rows"))
    return X.layout_rows(t).select("doc_id", "ord", "row_no", "row_class", "has_sub_header")


TAXONOMY_SQL = "(VALUES " + ", ".join("({}, '{}', '{}', '{}', '{}')".format(i, c, n.replace("'", "''"), g, "|".join(k).replace("'", "''")) for i, (c, n, g, k) in enumerate(TAXONOMY)) + ") AS t(ord, code, name, parent_group, keywords)"


@query(f"SELECT ord, code, name, parent_group, keywords, count(p_partkey) AS parts, min(p_partkey) AS first_part FROM {TAXONOMY_SQL} LEFT JOIN part ON p_partkey % {len(TAXONOMY) + 1} = ord GROUP BY ALL")
def taxonomy_rows(spark, sf):
    """The taxonomy with the parts that fall to each entry by their keys; one entry in so many has none."""
    from ..sources.taxonomy import taxonomy

    part = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % (len(TAXONOMY) + 1)).alias("k"))
    held = part.groupBy("k").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))
    rows = taxonomy(spark).join(held, F.col("ord") == F.col("k"), "left")
    return rows.select("ord", "code", "name", "parent_group", F.array_join("keywords", "|").alias("keywords"), F.coalesce("parts", F.lit(0)).alias("parts"), "first_part")
