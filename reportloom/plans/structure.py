"""Queries over document structure: footnotes, zones, job queues, files; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tabular as TB
from ..operators import export as X
from ..operators import footnotes as FN
from ..operators import structure as ST
from ..sources import docx as DX
from ..sources.shared import shared_folder
from ..streaming import queue as JQ
from .catalog import query, read
from .documents import by_kind, made_from

# Bodies made from the documents' lines: every fourth element is a note of one of five forms, the
# others carry markers of three forms (after a letter, after a year, in brackets) or none.
ELEMENTS = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
 e AS (SELECT doc_id, ord, (doc_id + ord) % 4 = 3 AS note, CASE WHEN (doc_id + ord) % 4 = 3 THEN CASE ord % 5 WHEN 0 THEN '[' || ord % 7 || '] Nguồn: ' WHEN 1 THEN ord % 7 || '. Theo ' WHEN 2 THEN '(*) Ghi chú ' WHEN 3 THEN '*' || ord % 11 || ' Xem ' ELSE 'Chú thích ' END || line
  ELSE line || CASE ord % 6 WHEN 0 THEN ' theo' || ord % 7 || ', tiếp' WHEN 1 THEN ' năm 2020' || doc_id % 12 || ';' WHEN 2 THEN ' xem [ ' || ord % 5 || ' ].' WHEN 3 THEN ' xem (' || doc_id % 3 || ')' ELSE '' END END AS text FROM raw)"""


def made_elements(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    o, k = F.col("ord"), F.col("doc_id")
    note = (k + o) % 4 == 3
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    before = F.when(o % 5 == 0, text("[", o % 7, "] Nguồn: ")).when(o % 5 == 1, text(o % 7, ". Theo ")).when(o % 5 == 2, "(*) Ghi chú ").when(o % 5 == 3, text("*", o % 11, " Xem ")).otherwise("Chú thích ")
    after = F.when(o % 6 == 0, text(" theo", o % 7, ", tiếp")).when(o % 6 == 1, text(" năm 2020", k % 12, ";")).when(o % 6 == 2, text(" xem [ ", o % 5, " ].")).when(o % 6 == 3, text(" xem (", k % 3, ")")).otherwise("")
    return d.select("doc_id", "ord", F.when(note, "FOOTNOTE").otherwise("PARAGRAPH").alias("type"), F.when(note, F.concat(before, "line")).otherwise(F.concat("line", after)).alias("text"))


@query(rf"""WITH {ELEMENTS}, n AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS number, regexp_replace(regexp_extract(text, '^(\*?\d+|\[\d+\]|\(\*\)|\*)', 1), '\D', '', 'g') AS marker FROM e WHERE note),
 c AS (SELECT n.doc_id, n.ord, max(e.ord) AS j FROM n JOIN e ON n.doc_id = e.doc_id AND NOT e.note AND e.ord BETWEEN n.ord - 30 AND n.ord - 1
  WHERE regexp_matches(e.text, '(?:([\p{{L}})]|\d{{4}})' || CASE WHEN marker = '' THEN '\d' ELSE marker END || '|\s*\[\s*' || CASE WHEN marker = '' THEN '\d' ELSE marker END || '\s*\]|\s*\(\s*' || CASE WHEN marker = '' THEN '\d' ELSE marker END || '\s*\))([.,;:]|\s|$)') GROUP BY 1, 2),
 b AS (SELECT n.doc_id, n.ord, max(e.ord) AS j FROM n JOIN e ON n.doc_id = e.doc_id AND NOT e.note AND e.ord < n.ord GROUP BY 1, 2)
 SELECT n.doc_id, n.ord, n.number, n.marker, coalesce(c.j, b.j) AS target FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.ord = c.ord LEFT JOIN b ON n.doc_id = b.doc_id AND n.ord = b.ord""")
def footnote_attachment(spark, sf):
    return FN.footnotes(made_elements(spark, sf)).select("doc_id", "ord", "number", "marker", "target")


@query(r"""SELECT o_orderkey AS doc_id, 'Thu ' || o_custkey || ' tỷ' || CASE o_orderkey % 3 WHEN 0 THEN '[^1], chi[^2].' WHEN 1 THEN '2, chi[^1].[^2]' ELSE ', năm 2020[^2]; chi.[^1]' END AS text, 2 AS n_notes FROM orders""")
def footnote_references(spark, sf):
    """Two notes of an order's one paragraph, placed in it: in turn, one without its mark, one without number."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    head = F.concat(F.lit("Thu "), F.col("o_custkey"), F.lit(" tỷ"))
    body = F.concat(head, F.when(k == 0, "1, chi  [ 2 ].").when(k == 1, "2, chi (1).").otherwise(", năm 20203; chi."))
    first = F.when(k == 0, "1 Nguồn A").when(k == 1, "[1] Nguồn A").otherwise("(*) Nguồn A")
    second = F.when(k == 0, "*2. Nguồn B").when(k == 1, "Nguồn B").otherwise("3. Nguồn B")
    item = F.posexplode(F.array(F.struct(F.lit("PARAGRAPH").alias("type"), body.alias("text")), F.struct(F.lit("FOOTNOTE").alias("type"), first.alias("text")), F.struct(F.lit("FOOTNOTE").alias("type"), second.alias("text")))).alias("ord", "e")
    return FN.anchored(o.select(F.col("o_orderkey").alias("doc_id"), item).select("doc_id", "ord", "e.type", "e.text")).select("doc_id", "text", "n_notes")


# ------------------------------------------------------------------------ job queues


def job_events(spark, sf) -> DataFrame:
    """The events as a stream of job events: eight queues; signups and views submit a job each, clicks
    and purchases end the one that has run longest, errors fail it."""
    own = JQ.state_session(spark)
    raw = own.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    return made_jobs(raw)


def made_jobs(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "view"), "SUBMIT").when(F.col("event_type") == "error", "ERROR").otherwise("DONE")
    batch = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    return raw.select((F.col("user_id") % 8).alias("queue"), batch.alias("batch_id"), F.when(kind == "SUBMIT", F.col("event_id").cast("string")).alias("job_id"), kind.alias("kind"), "ts")


#: Limits of the query: a lease of a day.
LIMITS = {"at_once": 3, "most": 100, "retained": 50, "retries": 1, "lease_ms": 86_400_000}


@query()
def job_queue(spark, sf):
    """All transitions of the jobs of all queues, by a stateful stream run to the end of its input."""
    at = shared_folder(spark, "job-queue")
    JQ.run_queue(job_events(spark, sf), f"{at}/transitions", f"{at}/checkpoint", **LIMITS)
    return spark.read.schema(JQ.TRANSITION).parquet(f"{at}/transitions")


# ------------------------------------------------------------------------ documents as files


def supplier_documents(spark, sf) -> DataFrame:
    """One document a supplier: a heading, a paragraph of a length by its number, and a table."""
    s = read(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    block = lambda kind, text, rows: F.struct(F.lit(kind).alias("kind"), text.alias("text"), rows.alias("rows"))
    none = F.lit(None).cast("array<array<string>>")
    text = F.repeat(F.concat(F.lit("Báo cáo <"), F.col("s_name"), F.lit("> & kỳ "), key, F.lit(".")), (F.col("s_suppkey") % 90 + 1).cast("int"))
    table = F.array(F.array(F.lit("STT"), F.lit("Tên"), F.lit("Số dư")), F.array(key, F.col("s_name"), F.floor("s_acctbal").cast("string")), F.array(F.lit(""), F.lit("tổng  cộng"), F.lit(None).cast("string")))
    blocks = F.array(block("heading", F.concat(F.lit("I. "), F.col("s_name")), none), block("paragraph", text, none), block("table", F.lit(None).cast("string"), table), block("heading", F.lit("II. HẾT"), none))
    return s.select(F.concat(F.lit("supplier-"), key).alias("name"), blocks.alias("blocks"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name AS n, floor(s_acctbal)::BIGINT AS b, repeat('Báo cáo <' || s_name || '> & kỳ ' || s_suppkey || '.', (s_suppkey % 90 + 1)::INTEGER) AS t FROM supplier),
 h AS (SELECT *, length('I. ' || n) AS c0, length('I. ' || n) + length(t) AS c1, 50 + greatest(18, ceil(length('I. ' || n) / 80.0) * 16) + 10 AS y0, greatest(18, ceil(length(t) / 80.0) * 16) + 10 AS dy FROM s),
 p AS (SELECT *, CASE WHEN c1 >= 2200 OR y0 + dy >= 760 THEN 2 ELSE 1 END AS p2, length('STT' || chr(9) || 'Tên' || chr(9) || 'Số dư' || chr(10) || k || chr(9) || n || chr(9) || b || chr(10) || chr(9) || 'tổng cộng' || chr(9)) AS tl FROM h),
 q AS (SELECT *, CASE WHEN p2 = 2 THEN tl ELSE c1 + tl END AS c2 FROM p)
 SELECT 'supplier-' || k AS name, 0 AS ord, 'heading' AS kind, 'I. ' || n AS text, 1 AS page, NULL AS table_id, 0 AS n_rows, NULL AS last_cell FROM q
 UNION ALL SELECT 'supplier-' || k, 1, 'paragraph', t, 1, NULL, 0, NULL FROM q
 UNION ALL SELECT 'supplier-' || k, 2, 'table', 'STT' || chr(9) || 'Tên' || chr(9) || 'Số dư' || chr(10) || k || chr(9) || n || chr(9) || b || chr(10) || chr(9) || 'tổng cộng' || chr(9), p2, 'word-table-1', 3, '' FROM q
 UNION ALL SELECT 'supplier-' || k, 3, 'heading', 'II. HẾT', CASE WHEN p2 = 2 THEN 2 WHEN c2 >= 800 THEN 2 ELSE 1 END, NULL, 0, NULL FROM q""")
def docx_round_trip(spark, sf):
    """Documents written as DOCX files by the data source and read back by it."""
    DX.register(spark)
    at = shared_folder(spark, "documents")
    supplier_documents(spark, sf).write.format("report_docx").mode("overwrite").save(at)
    back = spark.read.format("report_docx").load(at)
    return back.select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("name"), "ord", "kind", "text", "page", "table_id", F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"), F.element_at(F.element_at("rows", -1), -1).alias("last_cell"))


@query(
    """SELECT 'supplier-' || s_suppkey || '.csv' AS name, strlen(chr(65279) || '"=== BẢNG 1: ' || s_name || ' (Trang 2) ==="' || chr(13) || chr(10) || '"k","v"' || chr(13) || chr(10) || '"' || s_suppkey || '","' || CASE WHEN floor(s_acctbal) < 0 THEN chr(39) ELSE '' END || floor(s_acctbal)::BIGINT || '"' || repeat(chr(13) || chr(10), 2)) AS bytes FROM supplier"""
)
def csv_files(spark, sf):
    """CSV exports of suppliers' tables written as files, and the files' sizes."""
    DX.register(spark)
    at = shared_folder(spark, "csv-files")
    s = read(spark, sf, "supplier")
    rows = F.array(F.array(F.col("s_suppkey").cast("string"), F.floor("s_acctbal").cast("string")))
    tables = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("ord"), F.col("s_name").alias("title"), F.lit(2).alias("page_ref"), F.array(F.lit("k"), F.lit("v")).alias("headers"), rows.alias("rows"))
    files = X.csv_documents(tables).select(F.concat(F.lit("supplier-"), F.col("doc_id").cast("string")).alias("name"), F.col("csv").alias("content"))
    files.write.format("report_files").option("extension", "csv").mode("overwrite").save(at)
    back = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(at)
    return back.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.octet_length("content").cast("long").alias("bytes"))


# ------------------------------------------------------------------------ structure

BODY_LINES = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
 made AS (SELECT doc_id, ord, CASE (doc_id * 7 + ord) % 13 WHEN 0 THEN 'II. ' || t WHEN 1 THEN '1. A' || t WHEN 2 THEN '- ' || t WHEN 3 THEN '(ghi)' WHEN 4 THEN 'Ghi chú: ' || t WHEN 5 THEN 'và ' || t WHEN 6 THEN t || ',' WHEN 7 THEN 'thêm ' || t || ' TP.' WHEN 8 THEN ord::VARCHAR WHEN 9 THEN 'PHẦN II' WHEN 10 THEN 'ABC' WHEN 11 THEN t || ' xong.' ELSE t END AS t FROM raw),
 b AS (SELECT doc_id, ord, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM made)"""
LINE_RULES = r"""f AS (SELECT doc_id, ord, t, regexp_matches(t, '^(?i:---\s*PAGE\s+\d+\s*---)$|^\d{1,3}$') AS page,
  length(t) <= 1 OR (length(regexp_replace(t, '^(?:[-*•+]|\s)+', '')) <= 2 AND NOT regexp_matches(regexp_replace(t, '^(?:[-*•+]|\s)+', ''), '^\d+\.?$')) OR regexp_matches(t, '^(?i:CỘNG\s*HÒA\s*XÃ\s*HỘI|Độc\s*lập\s*[-–]\s*Tự\s*do|UBND|Số:)') AS skip,
  regexp_matches(t, '^(?i:I|II|III|IV|V|VI|VII|VIII|IX|X)\.|^(?i:PHẦN|MỤC)\s+(?:(?i:THỨ)\s+)?[A-Z\x{C0}-\x{1EF8}a-z\x{E0}-\x{1EF9}\d]+|^[A-Z]\.\s+[A-Z\x{C0}-\x{1EF8}\p{Lu}]') AS h1, regexp_matches(t, '^\d+(?:\s*\.\s*\d+)*[.)]\s+[A-Z\x{C0}-\x{1EF8}\p{Lu}]') AS h2,
  regexp_matches(t, '^[-*•+]|^[A-Za-zđĐ]\)\s+') AS item, regexp_matches(t, '^\([^)]+\)$') AS sub,
  regexp_matches(t, '^(?:\*?\s*(?:Ghi chú|Chú thích|Nguồn|Lưu ý)\s*:|\(\*\)|\(\d+\)\s+|\[\d+\]|[*†‡]\s*(?:Bảng|Nguồn|Số liệu|Ghi chú)|[1-9]\d?(?:\s*[-–—]\s*|\s+)[A-Z\x{C0}-\x{1EF8}\p{Lu}])') AS note,
  regexp_matches(t, '^\p{Ll}') AS low, regexp_matches(t, '^(?:[\p{Ll},;)\]”’]|[-–—]\s+[a-zà-ỹ\p{Ll}])') AS goes, regexp_matches(t, '^(?i:và|về|của|trong|tại|theo|giai đoạn)(?:[^0-9A-Za-z_]|$)') AS of_, regexp_matches(t, '^[-*•+]') AS bullet, regexp_matches(t, '^\d') AS digit,
  regexp_matches(t, '^(?i:PHẦN|MỤC)\s+(?:(?i:THỨ)\s+)?[A-Z\x{C0}-\x{1EF8}a-z\x{E0}-\x{1EF9}\d]+$') AS sect, t = upper(t) AS up, regexp_matches(t, '[.:!?]$') AS eh, regexp_matches(t, '[.:!?]["''”’]?$') AS ep, regexp_matches(t, '[.;!?]$') AS el,
  regexp_matches(t, '(?i:TP|Tx|Tt|Ths|Bs|Gs|TS|PGS|K/g|Đ/c|Đc|v\.v|NĐ-CP|QĐ-UBND|BC-UBND|TTr-UBND|CV-UBND|Số)\.$') AS es, regexp_matches(t, '\d\.$') AS en FROM b)"""
AUTOMATON = """x AS (SELECT DISTINCT doc_id, -1::BIGINT AS ord, '' AS t, ''::VARCHAR AS act, '' AS kind, false AS peh, false AS pep, false AS pel, false AS pes, false AS pen, false AS psec, false AS inside, 0 AS waits, false AS stopped, 0 AS n, -1 AS u, -1 AS element, '' AS sep FROM b
 UNION ALL SELECT doc_id, ord, t, act, CASE act WHEN 'sub' THEN 'SUB_NOTE' WHEN 'note' THEN 'FOOTNOTE' WHEN 'new' THEN kind2 WHEN 'keep' THEN kind2 ELSE kind END,
  CASE WHEN held THEN peh ELSE eh END, CASE WHEN held THEN pep ELSE ep END, CASE WHEN held THEN pel ELSE el END, CASE WHEN held THEN pes ELSE es END, CASE WHEN held THEN pen ELSE en END,
  CASE WHEN act IN ('new', 'keep') THEN sect AND h1 WHEN act IN ('page', 'skip', 'foot', 'wait') THEN psec ELSE false END, CASE act WHEN 'page' THEN false WHEN 'skip' THEN inside WHEN 'sub' THEN false WHEN 'note' THEN true ELSE inside AND NOT head END, w2,
  CASE WHEN act IN ('sub', 'note', 'keep') THEN CASE WHEN waits = 1 THEN pep ELSE stopped END WHEN act IN ('wait', 'list', 'para', 'new') THEN false ELSE stopped END, n2, CASE WHEN w2 = 1 THEN n2 - 1 ELSE u END,
  CASE WHEN n2 > n THEN n WHEN act = 'wait' THEN u WHEN act IN ('page', 'skip') THEN -1 ELSE n - 1 END, CASE WHEN n2 > n THEN '' WHEN act = 'foot' AND (bullet OR (pel AND NOT low)) THEN chr(10) WHEN act = 'h1' AND psec THEN ': ' ELSE ' ' END
 FROM (SELECT *, act IN ('page', 'skip') OR (act = 'wait' AND waits = 2) AS held, n + CASE WHEN act IN ('sub', 'note', 'keep', 'new') THEN 1 ELSE 0 END AS n2,
   CASE WHEN act IN ('sub', 'note', 'keep') THEN CASE WHEN waits = 1 THEN 2 ELSE waits END WHEN act = 'wait' THEN CASE WHEN ep THEN 0 ELSE waits END WHEN act = 'list' THEN CASE WHEN el THEN 0 ELSE 1 END WHEN act IN ('para', 'new') THEN CASE WHEN ep THEN 0 ELSE 1 END ELSE waits END AS w2
  FROM (SELECT *, CASE WHEN page THEN 'page' WHEN skip THEN 'skip' WHEN sub THEN 'sub' WHEN note THEN 'note' WHEN inside AND NOT head AND kind = 'FOOTNOTE' THEN 'foot' WHEN NOT (inside AND NOT head) AND waits > 0 AND NOT CASE WHEN waits = 1 THEN pep ELSE stopped END AND low AND NOT head AND NOT item THEN 'wait' WHEN kind = 'SUB_NOTE' THEN 'keep'
    WHEN kind = 'HEADING_1' AND NOT head AND NOT item AND NOT peh AND (up OR low) THEN 'h1' WHEN kind = 'HEADING_2' AND NOT head AND NOT item AND NOT peh AND (low OR of_) THEN 'h2' WHEN kind = 'LIST_ITEM' AND NOT head AND NOT item AND (NOT pel OR goes) THEN 'list'
    WHEN kind = 'PARAGRAPH' AND NOT head AND NOT item AND (goes OR NOT (pep AND NOT pes AND NOT (pen AND digit))) THEN 'para' ELSE 'new' END AS act
   FROM (SELECT f.*, f.h1 OR f.h2 AS head, CASE WHEN f.h1 THEN 'HEADING_1' WHEN f.h2 THEN 'HEADING_2' WHEN f.item THEN 'LIST_ITEM' ELSE 'PARAGRAPH' END AS kind2, x.kind, x.peh, x.pep, x.pel, x.pes, x.pen, x.psec, x.inside, x.waits, x.stopped, x.n, x.u FROM x JOIN f ON f.doc_id = x.doc_id AND f.ord = x.ord + 1))))"""


ELEMENTS_OF = r"""p AS (SELECT doc_id, element AS e, arg_min(kind, ord) AS type, count(*) AS lines, string_agg(sep || t, '' ORDER BY ord) AS text FROM x WHERE element >= 0 GROUP BY 1, 2),
 q AS (SELECT *, max(CASE WHEN type <> 'FOOTNOTE' THEN e END) OVER (PARTITION BY doc_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS body FROM p),
 m AS (SELECT a.doc_id, a.body, count(*) AS k FROM q a JOIN q h ON h.doc_id = a.doc_id AND h.e = a.body AND starts_with(h.type, 'HEADING') WHERE a.type = 'FOOTNOTE' GROUP BY 1, 2)
 SELECT q.doc_id, (CASE WHEN m.k IS NULL THEN q.e WHEN q.type = 'FOOTNOTE' THEN q.e - 1 ELSE q.e + m.k END)::BIGINT AS ord, q.type, CASE WHEN lines = 1 THEN text WHEN q.type = 'FOOTNOTE' THEN regexp_replace(text, '[ \t]+', ' ', 'g') ELSE regexp_replace(text, '\s+', ' ', 'g') END AS text
 FROM q LEFT JOIN m ON m.doc_id = q.doc_id AND m.body = CASE WHEN q.type = 'FOOTNOTE' THEN q.body ELSE q.e END"""


@query(f"WITH RECURSIVE {BODY_LINES}, {LINE_RULES}, {AUTOMATON}, {ELEMENTS_OF}")
def document_elements(spark, sf):
    """Bodies made from the documents' lines, stitched to elements."""
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "t"))
    k = (F.col("doc_id") * 7 + F.col("ord")) % 13
    t = F.col("t")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    line = F.when(k == 0, text("II. ", t)).when(k == 1, text("1. A", t)).when(k == 2, text("- ", t)).when(k == 3, "(ghi)").when(k == 4, text("Ghi chú: ", t)).when(k == 5, text("và ", t)).when(k == 6, text(t, ","))
    line = line.when(k == 7, text("thêm ", t, " TP.")).when(k == 8, F.col("ord").cast("string")).when(k == 9, "PHẦN II").when(k == 10, "ABC").when(k == 11, text(t, " xong.")).otherwise(t)
    return ST.stitched(d.select("doc_id", "ord", line.alias("line")))


PLAIN_LINES = BODY_LINES[: BODY_LINES.index(" made AS")] + BODY_LINES[BODY_LINES.index(" b AS") :].replace("FROM made", "FROM raw")


@query(f"WITH RECURSIVE {PLAIN_LINES}, {LINE_RULES}, {AUTOMATON}, {ELEMENTS_OF}")
def paragraph_stitch(spark, sf):
    """The documents' own lines, stitched to elements."""
    return ST.stitched(read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")))


ZONED = {
    "k0": "ỦY BAN NHÂN DÂN\nXÃ {s}\nCỘNG HÒA\nSố: {c}/BC-UBND\n{s}, ngày {d} tháng {m} năm {y}\nBÁO CÁO\nKết quả {p}\nđợt {c}.\nKính gửi: Sở {s}\nThu {n} tỷ.\nNơi nhận:\n- Như trên;\n- Lưu: VT;\nTM. ỦY BAN NHÂN DÂN\nCHỦ TỊCH\nNguyễn Văn {s}",
    "k1": "TỔNG CÔNG TY {s} ABC\nSố:\n{c}/CV\nngày .... tháng {m} năm {y}\n{d}\nV/v {p}\nlần {c}\nKính gửi: A\nĐơn vị trình: B {c}\nNội dung {n}.\nGIÁM ĐỐC\n{c}",
    "k2": "Tờ rơi {c}\nkhông đầu {p}",
    "k3": "CÔNG TY {s}\nTỜ TRÌNH\nTheo {p}\nVề việc {c}\nhết",
}
PARTS = "o_orderstatus AS s, o_custkey AS c, o_orderpriority AS p, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y, o_orderkey % 4 AS k"


@query(f"""SELECT o_orderkey AS doc_id, CASE k WHEN 0 THEN 'ỦY BAN NHÂN DÂN' WHEN 1 THEN 'TỔNG CÔNG TY' END AS superior, CASE k WHEN 0 THEN 'XÃ ' || s WHEN 1 THEN s || ' ABC' WHEN 2 THEN 'ỦY BAN NHÂN DÂN' ELSE 'CÔNG TY ' || s END AS issuer,
 CASE k WHEN 0 THEN 'Số: ' || c || '/BC-UBND' WHEN 1 THEN 'Số: ' || c || '/CV' ELSE 'Số: .../BC-UBND' END AS number, CASE k WHEN 0 THEN s || ', ngày ' || d || ' tháng ' || m || ' năm ' || y WHEN 1 THEN 'ngày ' || d || ' tháng ' || m || ' năm ' || y ELSE 'Ngày ... tháng ... năm ...' END AS dated,
 CASE k WHEN 1 THEN 'CÔNG VĂN' WHEN 3 THEN 'TỜ TRÌNH' ELSE 'BÁO CÁO' END AS title, CASE k WHEN 0 THEN 'Kết quả ' || p || ' đợt ' || c || '.' WHEN 1 THEN 'V/v ' || p || ' lần ' || c WHEN 3 THEN 'Về việc ' || c END AS subject, CASE k WHEN 0 THEN 'Kính gửi: Sở ' || s WHEN 1 THEN 'Kính gửi: A' END AS "to",
 CASE k WHEN 1 THEN 'Đơn vị trình: B ' || c END AS unit, CASE k WHEN 0 THEN 'Như trên|Lưu: VT' ELSE '' END AS recipients, CASE k WHEN 0 THEN 'CHỦ TỊCH' WHEN 1 THEN 'GIÁM ĐỐC' ELSE 'CHỦ TỊCH' END AS signer_title, CASE k WHEN 0 THEN 'Nguyễn Văn ' || s END AS signer,
 CASE k WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 1 ELSE 5 END AS "first", CASE k WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 2 ELSE 5 END AS "last" FROM (SELECT o_orderkey, {PARTS} FROM orders)""")
def document_zones(spark, sf):
    docs = made_from(spark, sf).select(F.col("o_orderkey").alias("doc_id"), by_kind(4, **ZONED).alias("text"))
    return ST.zones(docs).drop("lines").withColumn("recipients", F.array_join("recipients", "|"))


# ------------------------------------------------------------------------ table functions


@query(r"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderstatus AS s, o_orderpriority AS p, o_custkey AS c FROM orders)
 SELECT doc_id, 0 AS ord, 'h2' AS tag, NULL AS row_index, NULL AS col_index, 'Bảng & ' || s AS text FROM o UNION ALL SELECT doc_id, 1, 'p', NULL, NULL, 'dòng ' || c || chr(10) || 'hai' FROM o
 UNION ALL SELECT doc_id, 2, 'table', NULL, NULL, 'STTTên' || chr(10) || c || p FROM o UNION ALL SELECT doc_id, 2, 'table', 0, 0, 'STT' FROM o UNION ALL SELECT doc_id, 2, 'table', 0, 1, 'Tên' FROM o UNION ALL SELECT doc_id, 2, 'table', 1, 0, c::VARCHAR FROM o UNION ALL SELECT doc_id, 2, 'table', 1, 1, p FROM o""")
def html_tables(spark, sf):
    """Blocks, table rows and cells of made pages, by the table function in SQL."""
    TB.register(spark)
    o = read(spark, sf, "orders")
    part = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    html = part("<body><h2 class='a'>Bảng &amp; ", F.col("o_orderstatus"), "</h2><p>dòng  ", F.col("o_custkey"), "<br>hai</p><table><tr><th>STT</th><th>Tên</th></tr><tr><td>", F.col("o_custkey"), "</td><td><b>", F.col("o_orderpriority"), "</b></td></tr></table></body>")
    return spark.sql("SELECT o.doc_id, b.* FROM {o} o, LATERAL html_blocks(o.html) b", o=o.select(F.col("o_orderkey").alias("doc_id"), html.alias("html")))


@query(r"SELECT doc_id, ord::INTEGER AS ord, line FROM (SELECT doc_id, unnest(range(len(s))) AS ord, trim(unnest(s), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE line <> ''")
def text_lines(spark, sf):
    """The documents' lines by the table function in SQL."""
    TB.register(spark)
    return spark.sql("SELECT d.doc_id, l.* FROM {d} d, LATERAL text_lines(d.text) l", d=read(spark, sf, "documents"))
