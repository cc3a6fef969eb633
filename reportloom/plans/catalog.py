"""The query catalogue: each operator on the driver's tables, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import export as X
from ..operators import ranking as R
from ..operators import tables as T
from ..operators import textops as TX
from ..operators import warehouse as W
from ..streaming import ingest as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_metrics(spark, sf) -> DataFrame:
    """Order priority as indicator, market segment as authority, month as period."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    month = F.date_format("o_orderdate", "yyyy-MM")
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("indicator"), F.col("c_mktsegment").alias("authority"), month.alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.min("o_orderkey").alias("ord"))
    return g.select("indicator", "authority", "period", F.col("total").cast("string").alias("actual"), F.lit(None).cast("string").alias("percentage"), F.when(F.col("total") > 1_000_000, "GREEN").otherwise("RED").alias("status"), "ord")


ORDER_METRICS = """m AS (SELECT o_orderpriority AS indicator, c_mktsegment AS authority, strftime(o_orderdate, '%Y-%m') AS period,
 sum(o_totalprice::DECIMAL(18,2)) AS total, min(o_orderkey) AS ord FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


@query(f"""WITH {ORDER_METRICS}, w AS (SELECT indicator, authority, count(*) AS points, arg_min(total, (period, ord))::DOUBLE AS a, arg_max(total, (period, ord))::DOUBLE AS z,
 arg_max(total, (period, ord)) AS lastv FROM m GROUP BY 1, 2), g AS (SELECT *, CASE WHEN points >= 2 AND a <> 0 THEN floor((z - a) / a * 1000 + 0.5) / 10 END AS growth_rate FROM w)
 SELECT indicator, authority, points, a AS first_value, z AS last_value, growth_rate, CASE WHEN growth_rate > 2 THEN 'IMPROVING' WHEN growth_rate < -2 THEN 'DECLINING' ELSE 'STABLE' END AS trajectory,
 CASE WHEN lastv > 1000000 THEN 'GREEN' ELSE 'RED' END AS latest_status FROM g""")
def kpi_trends(spark, sf):
    return A.kpi_trends(order_metrics(spark, sf))


@query(f"WITH {ORDER_METRICS} SELECT indicator, authority, period, total::VARCHAR AS actual, row_number() OVER (PARTITION BY indicator, authority ORDER BY period, ord)::INTEGER AS point FROM m")
def kpi_timeline(spark, sf):
    return A.kpi_timeline(order_metrics(spark, sf)).select("indicator", "authority", "period", "actual", "point")


def event_facts(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    v = F.col("value")
    return e.select(F.col("event_type").alias("category"), F.when(v > 80, "CRITICAL").when(v > 50, "HIGH").otherwise("MEDIUM").alias("urgency"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("authority"), F.lit(None).cast("string").alias("root_cause"), F.col("props").alias("problem"), F.col("event_id").alias("ord"))


EVENT_FACTS = "f AS (SELECT event_type AS category, CASE WHEN value > 80 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS urgency, 'u' || (user_id % 7) AS authority, props AS problem, event_id AS ord FROM events)"


@query(f"""WITH {EVENT_FACTS}, c AS (SELECT category, count(*) AS occurrences, count(*) FILTER (urgency IN ('HIGH', 'CRITICAL')) AS high_urgency, min(ord) AS first_ord FROM f GROUP BY 1),
 a AS (SELECT category, string_agg(authority, '|' ORDER BY o) AS authorities FROM (SELECT category, authority, min(ord) AS o FROM f GROUP BY 1, 2) GROUP BY 1),
 r AS (SELECT category, string_agg(problem, '|' ORDER BY o) AS root_causes FROM (SELECT category, problem, min(ord) AS o FROM f WHERE problem <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY category ORDER BY o) <= 5) GROUP BY 1)
 SELECT c.*, authorities, root_causes FROM c LEFT JOIN a USING (category) LEFT JOIN r USING (category)""")
def bottleneck_heatmap(spark, sf):
    return A.heatmap(event_facts(spark, sf)).withColumn("authorities", F.array_join("authorities", "|")).withColumn("root_causes", F.array_join("root_causes", "|"))


def month_metrics(spark, sf, year: int) -> DataFrame:
    l, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    part = l.filter(F.year("l_shipdate") == year).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return part.groupBy(F.col("p_name").alias("indicator")).agg(F.sum("l_quantity").alias("value"), F.min("p_partkey").alias("ord")).withColumn("status", F.when(F.col("value") > 100, "GREEN").otherwise("RED"))


MONTH_METRICS = "(SELECT p_name AS indicator, sum(l_quantity) AS value, min(p_partkey) AS ord FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = {} GROUP BY 1)"


@query(f"""WITH a AS {MONTH_METRICS.format(1996)}, b AS {MONTH_METRICS.format(1997)}, na AS (SELECT DISTINCT lower(trim(indicator)) AS n FROM a), nb AS (SELECT lower(trim(indicator)) AS n, min(ord) AS ob FROM b GROUP BY 1),
 best AS (SELECT na.n, min(ob) AS ob FROM na JOIN nb ON contains(nb.n, na.n) OR contains(na.n, nb.n) GROUP BY 1)
 SELECT a.ord, a.indicator, a.value AS value_a, b.value AS value_b, CASE WHEN b.ord IS NULL THEN 'NOT_REPORTED' WHEN b.value > 100 THEN 'GREEN' ELSE 'RED' END AS status_b, CASE WHEN b.ord IS NULL THEN false ELSE b.value >= a.value END AS is_improved
 FROM a LEFT JOIN best ON lower(trim(a.indicator)) = best.n LEFT JOIN b ON b.ord = best.ob""")
def period_comparison(spark, sf):
    return A.compare_metrics(month_metrics(spark, sf, 1996), month_metrics(spark, sf, 1997))


HALF = "SELECT DISTINCT p_name || ' ' || floor(l_quantity)::BIGINT || ' ' || p_brand || l_suppkey % 10 AS t FROM part JOIN lineitem ON l_partkey = p_partkey WHERE (year(l_shipdate) < 1997) = {}"
PIECES = f"a AS ({HALF.format('true')}), b AS ({HALF.format('false')})"
NEAR = "EXISTS (SELECT 1 FROM a WHERE contains(a.t, b.t[:15]) OR contains(b.t, a.t[:15]))"


def half_names(spark, sf, early: bool) -> DataFrame:
    """Quantities and names of what was shipped before 1997, or from then on."""
    l, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    name = F.concat("p_name", F.lit(" "), F.floor("l_quantity").cast("string"), F.lit(" "), "p_brand", (F.col("l_suppkey") % 10).cast("string"))
    return l.filter((F.year("l_shipdate") < 1997) == early).join(p, F.col("l_partkey") == F.col("p_partkey")).select(name.alias("t")).distinct()


@query(f"WITH {PIECES} SELECT t FROM b WHERE {NEAR}")
def persistent_items(spark, sf):
    return A.persistent(half_names(spark, sf, False), half_names(spark, sf, True), "t")


@query(f"WITH {PIECES} SELECT t FROM b WHERE NOT {NEAR}")
def new_items(spark, sf):
    return A.persistent(half_names(spark, sf, False), half_names(spark, sf, True), "t", keep=False)


@query("""SELECT (SELECT count(*) FROM orders) AS total_reports, (SELECT count(DISTINCT o_custkey) FROM orders) AS authorities, (SELECT count(*) FROM lineitem) AS total_metrics,
 (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS red_metrics, (SELECT count(*) FROM events) AS total_bottlenecks, (SELECT count(*) FROM events WHERE value > 50) AS urgent_bottlenecks""")
def executive_summary(spark, sf):
    r = read(spark, sf, "orders").select(F.col("o_custkey").alias("authority"))
    m = read(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "RED").otherwise("GREEN").alias("status"))
    return A.executive_summary(r, m, event_facts(spark, sf))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_ord FROM events GROUP BY 1")
def category_counts(spark, sf):
    return A.category_counts(read(spark, sf, "events"), "event_type", "event_id")


@query("""SELECT doc_id, lang, source, count(*) OVER () AS total FROM documents WHERE contains(lower(lang), 'e') AND contains(lower(source), 'src1') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10""")
def warehouse_list_page(spark, sf):
    d = W.contains_filter(read(spark, sf, "documents"), lang="E", source="SRC1")
    return W.page(d.select("doc_id", "lang", "source", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 20, 10).select("doc_id", "lang", "source", "total")


@query("SELECT page_id, url FROM pages WHERE page_id = 7")
def point_lookup(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), "page_id", "url")
    return W.get_report(p, "7").select("page_id", "url")


@query("SELECT sha256(text) AS file_hash_sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def hash_dedup(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "text")
    return W.dedup_by_hash(d, F.col("text"), F.col("doc_id")).select("file_hash_sha256", "doc_id", "source")


@query("SELECT sha256(text) AS file_hash_sha256, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def hash_dedup_against_index(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    known = d.filter("doc_id % 3 = 0").select(S.content_hash(F.col("text")).alias("file_hash_sha256"))
    return W.dedup_by_hash(d, F.col("text"), F.col("doc_id"), known).select("file_hash_sha256", "doc_id")


def order_reports(spark, sf) -> DataFrame:
    """Each order as a report: its lines as metrics, its supplier as relationship, and so on."""
    o = read(spark, sf, "orders")
    l = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"))).alias("lines"))
    s = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    metric = lambda x: F.struct(F.concat(F.lit("line "), x["l_linenumber"]).alias("indicator"), none.alias("plan_target"), s(x["l_quantity"].cast("int")).alias("actual"), none.alias("percentage"), none.alias("unit"), F.when(x["l_returnflag"] == "R", "RED").otherwise("").alias("status"), none.alias("trend"), x["l_linenumber"].cast("int").alias("page_ref"), none.alias("quote"))
    rel = lambda x: F.struct(F.lit("").alias("problem"), F.concat(F.lit("thủ tục "), x["l_returnflag"]).alias("issue"), none.alias("root_cause"), none.alias("cause_description"), none.alias("cause"), none.alias("consequence"), none.alias("impact"), none.alias("urgency"), F.when(x["l_returnflag"] == "R", "HIGH").alias("severity"), none.alias("responsible_agency"), none.alias("responsible_party"))
    act = lambda x: F.struct(none.alias("task_title"), F.concat(F.lit("ship "), x["l_linenumber"]).alias("action_title"), none.alias("lead_assignee"), none.alias("owner_department"), none.alias("deadline"), none.alias("status"))
    tab = lambda x: F.struct(F.when(x["l_returnflag"] == "R", F.concat(F.lit("T"), x["l_linenumber"])).alias("table_title"), F.array(F.lit("a"), F.lit("b")).alias("headers"), F.array_repeat(F.array(F.lit("1"), F.lit("2")), x["l_linenumber"].cast("int")).alias("rows"), F.lit(None).cast("int").alias("row_count"), F.when(x["l_returnflag"] == "A", 7).alias("col_count"), (x["l_linenumber"].cast("int") - 1).alias("page_ref"))
    empty = F.filter(F.transform("lines", act), lambda _: F.lit(False))
    meta = F.struct(none.alias("document_title"), none.alias("document_type"), s(F.col("o_orderkey")).alias("document_number"), F.col("o_orderpriority").alias("issuing_authority"), none.alias("receiving_authority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issuance_date"), F.date_format("o_orderdate", "yyyy-MM").alias("reporting_period"), F.lit("").alias("primary_domain"), F.array(F.col("o_orderstatus")).alias("domain_tags"))
    detail = F.struct(F.transform("lines", metric).alias("metrics"), F.transform(F.slice("lines", 1, 1), tab).alias("tables"), F.transform("lines", rel).alias("relationships"), empty.alias("action_items"), F.transform("lines", act).alias("actions_next_period"))
    return o.join(l, F.col("o_orderkey") == F.col("k")).select(s(F.col("o_orderkey")).alias("report_id"), meta.alias("metadata"), detail.alias("level2_details"), S.content_hash(s(F.col("o_orderkey"))).alias("file_hash_sha256"))


LINES = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_shipdate)"


@query("SELECT o_orderkey::VARCHAR AS id, 'Báo cáo hành chính' AS document_title, 'BAO_CAO' AS document_type, o_orderkey::VARCHAR AS document_number, o_orderpriority AS issuing_authority, strftime(o_orderdate, '%Y-%m-%d') AS issuance_date, 'Hành chính tổng hợp' AS primary_domain, o_orderstatus AS tags FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def fanout_reports(spark, sf):
    r = W.fan_out(order_reports(spark, sf))["reports"]
    return r.select("id", "document_title", "document_type", "document_number", "issuing_authority", "issuance_date", "primary_domain", F.array_join("domain_tags", ",").alias("tags"))


@query(f"SELECT 'rm-' || l_orderkey || '-' || {NTH} AS id, l_orderkey::VARCHAR AS report_id, o_orderpriority AS issuing_authority, 'line ' || l_linenumber AS indicator_name, l_quantity::INTEGER::VARCHAR AS actual_value, CASE WHEN l_returnflag = 'R' THEN 'RED' ELSE 'GREEN' END AS status, 'ON_DINH' AS trend, l_linenumber AS page_ref {LINES}")
def fanout_metrics(spark, sf):
    return W.fan_out(order_reports(spark, sf))["report_metrics"].select("id", "report_id", "issuing_authority", "indicator_name", "actual_value", "status", "trend", "page_ref")


@query(f"""SELECT 'rt-' || l_orderkey || '-1' AS id, l_orderkey::VARCHAR AS report_id, CASE WHEN l_returnflag = 'R' THEN 'T' || l_linenumber ELSE 'Bảng 1' END AS table_title, l_linenumber::INTEGER AS row_count, CASE WHEN l_returnflag = 'A' THEN 7 ELSE 2 END AS col_count, greatest(l_linenumber - 1, 1)::INTEGER AS page_ref {LINES} QUALIFY {NTH} = 1""")
def fanout_tables(spark, sf):
    return W.fan_out(order_reports(spark, sf))["report_tables"].select("id", "report_id", "table_title", "row_count", "col_count", "page_ref")


@query(f"SELECT 'rb-' || l_orderkey || '-' || {NTH} AS id, 'thủ tục ' || l_returnflag AS problem, 'THU_TUC_PHAP_LY' AS category, CASE WHEN l_returnflag = 'R' THEN 'HIGH' ELSE 'MEDIUM' END AS urgency {LINES}")
def fanout_bottlenecks(spark, sf):
    return W.fan_out(order_reports(spark, sf))["report_bottlenecks"].select("id", "problem", "category", "urgency")


@query(f"SELECT 'rtk-' || l_orderkey || '-' || {NTH} AS id, 'ship ' || l_linenumber AS task_title, 'PENDING' AS completion_status {LINES}")
def fanout_tasks(spark, sf):
    return W.fan_out(order_reports(spark, sf))["report_tasks"].select("id", "task_title", "completion_status")


@query("SELECT l_orderkey::VARCHAR AS record_id, count(*)::INTEGER AS indicators_count, 1 AS tables_count, count(*)::INTEGER AS relationships_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def warehouse_index(spark, sf):
    return W.index_rows(order_reports(spark, sf)).select("record_id", "indicators_count", "tables_count", "relationships_count")


@query("SELECT o_orderkey, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) WHERE d IS NULL OR (d >= '1996-01-01' AND d <= '1996-12-31')")
def metrics_by_range(spark, sf):
    d = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return W.date_range(read(spark, sf, "orders").select("o_orderkey", d.alias("d")), "d", "1996-01-01", "1996-12-31")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber + 100 FROM lineitem WHERE l_orderkey % 4 = 0")
def replace_slice(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return W.replace_slice(l, l.filter("l_orderkey % 4 = 0").withColumn("l_linenumber", F.col("l_linenumber") + 100), "l_orderkey")


CASES = "CASE l_linenumber % 5 WHEN 0 THEN format('{:d}.{:03d},5 tỷ đồng', (n // 1000)::INT, (n % 1000)::INT) WHEN 1 THEN n || ',25%' WHEN 2 THEN format('{:d}.{:03d}', (n // 1000)::INT, (n % 1000)::INT) WHEN 3 THEN n || '.5 ha' ELSE '(' || n || ')' END"


def number_texts(spark, sf) -> DataFrame:
    n = F.floor("l_extendedprice").cast("long")
    s = n.cast("string")
    group = F.concat((n / 1000).cast("long").cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    k = F.col("l_linenumber") % 5
    text = F.when(k == 0, F.concat(group, F.lit(",5 tỷ đồng"))).when(k == 1, F.concat(s, F.lit(",25%"))).when(k == 2, group).when(k == 3, F.concat(s, F.lit(".5 ha"))).otherwise(F.concat(F.lit("("), s, F.lit(")")))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN n + 0.5 WHEN 1 THEN n + 0.25 WHEN 2 THEN n::DOUBLE WHEN 3 THEN n + 0.5 END::DOUBLE AS v FROM (SELECT *, floor(l_extendedprice)::BIGINT AS n FROM lineitem)")
def vn_number_parse(spark, sf):
    return number_texts(spark, sf).select("l_orderkey", "l_linenumber", S.vn_number(F.col("t")).alias("v"))


@query(f"SELECT l_orderkey, l_linenumber, try_cast(regexp_extract(ltrim(t), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?', 0) AS DOUBLE) AS v FROM (SELECT *, {CASES} AS t FROM (SELECT *, floor(l_extendedprice)::BIGINT AS n FROM lineitem))")
def lenient_float(spark, sf):
    return number_texts(spark, sf).select("l_orderkey", "l_linenumber", S.lenient_float(F.col("t")).alias("v"))


def audit_cells(spark, sf) -> DataFrame:
    """An order as a table: its quantities, and a TOTAL row that is wrong for some orders."""
    l = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_index"), F.lit(1).alias("col_index"), F.lit("BASE_ITEM").alias("role"), F.col("l_quantity").alias("value"))
    total = l.groupBy("table_id").agg(F.lit(1000).alias("row_index"), F.lit(1).alias("col_index"), F.lit("TOTAL").alias("role"), (F.sum("value") + F.when(F.col("table_id") % 3 == 0, 25).otherwise(0)).alias("value"))
    return l.unionByName(total)


@query("""SELECT table_id, 1000 AS row_index, 1 AS col_index, s AS expected, s + 25 AS actual, 'SUM_MISMATCH' AS finding FROM (SELECT l_orderkey AS table_id, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1)
 WHERE table_id % 3 = 0 AND n >= 2 AND 25 / (s + 25) > 0.015""")
def table_sum_audit(spark, sf):
    return T.sum_audit(audit_cells(spark, sf))


@query("""SELECT l_orderkey, l_linenumber, e AS expected FROM (SELECT l_orderkey, l_linenumber, round(100 - l_linenumber * 2.0, 1) AS rate, floor(l_extendedprice * (1 - l_discount) / l_extendedprice * 1000 + 0.5) / 10 AS e FROM lineitem)
 WHERE abs(e - rate) > 3.0 AND abs(e - rate) / e > 0.03""")
def table_percent_audit(spark, sf):
    p = F.col("l_extendedprice")
    found = T.percent_finding(p, p * (1 - F.col("l_discount")), F.round(100 - F.col("l_linenumber") * 2.0, 1))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.alias("expected")).filter("expected is not null")


@query("SELECT l_suppkey AS table_id, 1 AS col_index, 'UNIT_INCONSISTENCY' AS finding FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber = 7) AND bool_or(l_linenumber <= 1)")
def table_unit_audit(spark, sf):
    unit = F.when(F.col("l_linenumber") == 7, "15 triệu đồng").when(F.col("l_linenumber") <= 1, "2 tỷ đồng").otherwise("3 ha")
    return T.unit_audit(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.lit(1).alias("col_index"), unit.alias("text")))


def grids(spark, sf) -> DataFrame:
    l = read(spark, sf, "lineitem")
    text = {0: F.col("l_returnflag"), 1: F.col("l_quantity").cast("int").cast("string"), 2: F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).otherwise(""), 3: F.when(F.col("l_orderkey") % 4 == 0, "- x").otherwise("")}
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), t.alias("t")) for i, t in text.items()])).alias("x")
    return l.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row_index"), cell).select("table_id", "row_index", F.col("x.c").alias("col_index"), F.col("x.t").alias("text"))


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row_index, unnest([0, 1, 2, 3]) AS col, unnest([l_returnflag, l_quantity::INT::VARCHAR, CASE WHEN l_linenumber > 2 THEN l_linestatus ELSE '' END, CASE WHEN l_orderkey % 4 = 0 THEN '- x' ELSE '' END]) AS t FROM lineitem),
 p AS (SELECT table_id, col, count(*) FILTER (t <> '') AS filled, sum(length(t)) AS chars, count(*) FILTER (regexp_matches(t, '^[\\d.,%\\s-]*\\d[\\d.,%\\s-]*$')) AS numeric, count(*) FILTER (regexp_matches(t, '^[-•*+]\\s')) AS bullets, max(row_index) + 1 AS n_rows FROM c GROUP BY 1, 2),
 q AS (SELECT *, max(n_rows) OVER (PARTITION BY table_id) AS nr FROM p),
 g AS (SELECT table_id, count(*) AS cols, max(nr)::BIGINT AS n_rows, sum(filled)::BIGINT AS filled, sum(chars)::BIGINT AS chars, sum(numeric)::BIGINT AS numeric, sum(bullets) AS bullets, count(*) FILTER (filled = 0) AS empties, max(chars) AS widest, count(*) FILTER (filled >= greatest(2, floor(nr * 0.25)) AND (chars >= 5 OR filled >= 2)) AS useful FROM q GROUP BY 1)
 SELECT table_id, cols, n_rows, filled, chars, numeric, CASE WHEN n_rows < 2 OR cols < 2 OR cols > 16 THEN 'SHAPE' WHEN chars < 15 OR filled < 4 THEN 'TOO_LITTLE' WHEN empties >= 2 OR empties >= cols * 0.35 THEN 'EMPTY_COLUMNS' WHEN bullets >= 2 THEN 'BULLETS' WHEN n_rows = 2 AND numeric < 2 THEN 'TWO_ROWS'
 WHEN useful < 2 THEN 'ONE_COLUMN' WHEN widest > 0.75 * chars AND chars - widest < 20 THEN 'DOMINATED' WHEN filled < n_rows * cols * 0.2 THEN 'SPARSE' ELSE 'VALID' END AS verdict FROM g""")
def table_quality_filter(spark, sf):
    return T.table_quality(grids(spark, sf)).withColumn("n_rows", F.col("n_rows").cast("long"))


DOC_LINES = "l AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS ord, trim(unnest(s)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


@query(f"""WITH {DOC_LINES}, m AS (SELECT *, lag(line) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
 i AS (SELECT *, sum(CASE WHEN b IS NULL OR b = '' OR regexp_matches(b, '[:.?!;]$') OR regexp_matches(line, '^[-*•+]|\\d+\\.|\\([a-z0-9]+\\)', 'i') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM m)
 SELECT doc_id, island::BIGINT AS ord, sha256(string_agg(line, ' ' ORDER BY ord)) AS h FROM i GROUP BY 1, 2 HAVING string_agg(line, ' ' ORDER BY ord) <> ''""")
def line_stitch(spark, sf):
    return TX.stitch(TX.lines(read(spark, sf, "documents"))).select("doc_id", "ord", S.content_hash(F.col("line")).alias("h"))


@query(f"""WITH {DOC_LINES}, s AS (SELECT *, last_value(CASE WHEN starts_with(line, 'The ') THEN false WHEN starts_with(line, 'Th') THEN true END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM l)
 SELECT doc_id, count(*) AS n, sum(ord)::BIGINT AS places FROM s WHERE NOT coalesce(inside, false) GROUP BY 1""")
def section_toggle(spark, sf):
    x = TX.outside_section(TX.lines(read(spark, sf, "documents")), F.col("line").startswith("Th"), F.col("line").startswith("The "))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("ord").alias("places"))


@query(f"WITH {DOC_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INTEGER AS n, ord, sha256(line) AS h FROM l WHERE regexp_matches(line, 'license|tion|ment', 'i') AND length(line) > 15 AND length(line) < 250 QUALIFY n <= 6")
def extract_lines(spark, sf):
    return TX.keyword_lines(read(spark, sf, "documents"), "license|tion|ment", 15, 250, 6).select("doc_id", "n", "ord", S.content_hash(F.col("line")).alias("h"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, o::INTEGER AS ord, trim(x) AS line FROM (SELECT doc_id, unnest(range(len(s))) AS o, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
 f AS (SELECT doc_id, ord, length(line) AS n, regexp_matches(line, '^([IVX]+|\\d+)\\.') AS head FROM l),
 r AS (SELECT doc_id, ord, 1 AS page, n AS held FROM f WHERE ord = 0 UNION ALL SELECT f.doc_id, f.ord, CASE WHEN held > 0 AND (held + n > 2200 OR (head AND held >= 800)) THEN page + 1 ELSE page END, CASE WHEN held > 0 AND (held + n > 2200 OR (head AND held >= 800)) THEN n ELSE held + n END FROM r JOIN f ON f.doc_id = r.doc_id AND f.ord = r.ord + 1)
 SELECT doc_id, ord, page FROM r""")
def page_packing(spark, sf):
    return TX.pack_pages(TX.lines(read(spark, sf, "documents").select("doc_id", "text")))


@query("""WITH t AS (SELECT o_orderkey AS doc_id, floor(o_totalprice)::BIGINT::VARCHAR AS n FROM orders) SELECT doc_id, 1 AS n, 'Thu ngân sách' AS indicator, n AS actual, 'tỷ đồng' AS unit, 'THUC_HIEN_THUC_TE' AS data_nature, 'GREEN' AS status, 'ON_DINH' AS trend FROM t
 UNION ALL SELECT doc_id, 2, 'Tổng vốn đầu tư', n, 'triệu đồng', 'UOC_THUC_HIEN', 'GREEN', 'ON_DINH' FROM t""")
def metric_extraction(spark, sf):
    return TX.metrics(report_texts(spark, sf)).select("doc_id", "n", "indicator", "actual", "unit", "data_nature", "status", "trend")


@query("""SELECT o_orderkey AS doc_id, 1 AS n, 'Khó khăn vướng mắc do thiếu vật liệu, ảnh hưởng đến tiến độ thi công.' AS issue, 'HIGH' AS severity, 'Do thiếu vật liệu' AS cause, 'ảnh hưởng đến tiến độ thi công' AS impact FROM orders""")
def relationship_extraction(spark, sf):
    return TX.relationships(report_texts(spark, sf))


def report_texts(spark, sf) -> DataFrame:
    """Orders as short Vietnamese reports."""
    n = F.floor("o_totalprice").cast("string")
    text = F.concat(F.lit("- Thu ngân sách: "), n, F.lit(" tỷ đồng;\nTổng vốn đầu tư ước đạt "), n, F.lit(" triệu đồng.\nKhó khăn vướng mắc do thiếu vật liệu, ảnh hưởng đến tiến độ thi công."))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query("""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS ord, lower(regexp_extract(x, '^<(\\w+)', 1)) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br\\s*/?>|</(?:div|li|p|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \\t]*\\n\\s*', chr(10), 'g')) AS text FROM (SELECT page_id, unnest(m) AS x, unnest(range(len(m))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h1(?:\\s[^>]*)?>.*?</h1>|<h2(?:\\s[^>]*)?>.*?</h2>|<h3(?:\\s[^>]*)?>.*?</h3>|<h4(?:\\s[^>]*)?>.*?</h4>|<h5(?:\\s[^>]*)?>.*?</h5>|<h6(?:\\s[^>]*)?>.*?</h6>|<p(?:\\s[^>]*)?>.*?</p>|<table(?:\\s[^>]*)?>.*?</table>') AS m FROM pages))""")
def html_flow(spark, sf):
    return TX.html_flow(read(spark, sf, "pages")).select("page_id", "ord", "tag", "text")


TURN_WORDS = "SELECT conv_id AS doc_id, turn, lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '-[\\s]*\\n[\\s]*', '', 'g'), '[\\s]+', ' ', 'g'), '^[-*•+\\d.)\\s]+', ''))) AS t FROM conversations"


@query(f"""WITH p AS ({TURN_WORDS.format("text")}), s AS ({TURN_WORDS.format("CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN 'qqq zzz ' || text ELSE 'qqq zzz ' || turn END")}),
 w AS (SELECT doc_id, turn AS sid, t, list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) >= 3)) AS k FROM s), b AS (SELECT w.doc_id, sid, p.turn AS page, contains(p.t, left(w.t, 20)) AS exact, CASE WHEN len(k) >= 2 THEN len(list_filter(k, lambda x: list_contains(string_split(p.t, ' '), x))) / len(k)::DOUBLE ELSE 0.0 END AS share FROM w JOIN p ON p.doc_id = w.doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sid ORDER BY NOT exact, CASE WHEN exact THEN 0.0 ELSE -share END, page) AS n FROM b WHERE exact OR share >= 0.4)
 SELECT w.doc_id, w.sid, page, CASE WHEN exact THEN 'EXACT' WHEN page IS NOT NULL THEN 'OVERLAP' ELSE 'FALLBACK' END AS tier FROM w LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON r.doc_id = w.doc_id AND r.sid = w.sid""")
def snippet_locate(spark, sf):
    c = read(spark, sf, "conversations")
    k = F.col("turn") % 3
    cut = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("qqq zzz "), "text")).otherwise(F.concat(F.lit("qqq zzz "), F.col("turn").cast("string")))
    return TX.locate_snippets(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sid"), cut.alias("snippet")), c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")).select("doc_id", "sid", "page", "tier")


TEST_DOMAINS = [("A", "Alpha", ["tion", "ment"], ["tion"], 3), ("B", "Beta", ["license"], ["license", "apache"], 2), ("C", "Gamma", ["keit"], ["keit", "ung"], 2)]


@query("""WITH s AS (SELECT doc_id, lower(text) AS t, lower(text[:200]) AS p FROM documents), c AS (SELECT doc_id, t, (contains(p, 'tion') OR contains(p, 'ment'))::INT * 10 + contains(t, 'tion')::INT * 3 AS a, contains(p, 'license')::INT * 10 + (contains(t, 'license') OR contains(t, 'apache'))::INT * 2 AS b, contains(p, 'keit')::INT * 10 + (contains(t, 'keit') OR contains(t, 'ung'))::INT * 2 AS c FROM s)
 SELECT doc_id, greatest(a, b, c) AS score, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS code FROM c""")
def keyword_classify(spark, sf):
    d = read(spark, sf, "documents")
    best = S.primary_domain(F.substring("text", 1, 200), F.col("text"), TEST_DOMAINS)
    return d.select("doc_id", best["score"].alias("score"), best["code"].alias("code"))


def user_facts(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.concat_ws("-", "event_type", "event_id").alias("title"), "event_type", "value")
    of = lambda t: e.filter(F.col("event_type") == t)
    return e, of


@query("""WITH k AS (SELECT event_type AS t, dense_rank() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
 c AS (SELECT user_id AS doc_id, event_id AS seq, event_type || '-' || event_id AS title, CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 3 = 0 THEN CASE WHEN value > 80 THEN 3 WHEN value > 50 THEN 4 ELSE 5 END WHEN event_id % 3 = 1 THEN 9 ELSE 10 END AS rank, event_id % 3 = 1 AND event_id % 11 <> 0 AND floor(value) = 0 AS zero FROM events)
 SELECT doc_id, rank, seq, title, row_number() OVER (PARTITION BY doc_id ORDER BY rank, seq, title)::INTEGER AS place FROM c WHERE NOT zero QUALIFY place <= 8""")
def priority_cards(spark, sf):
    e, _ = user_facts(spark, sf)
    first, rest = e.filter("ord % 11 = 0"), e.filter("ord % 11 <> 0")
    b = rest.filter("ord % 3 = 0").withColumn("severity", F.when(F.col("value") > 80, "CRITICAL").when(F.col("value") > 50, "HIGH").otherwise("MEDIUM"))
    m = rest.filter("ord % 3 = 1").withColumn("actual", F.floor("value").cast("string")).withColumn("status", F.lit("GREEN"))
    none = e.filter(F.lit(False))
    return R.cards(first, none, b, none, m, rest.filter("ord % 3 = 2")).select("doc_id", "rank", "seq", "title", "place")


@query("""WITH z AS (SELECT user_id AS doc_id, event_type AS indicator, event_id AS ord FROM events WHERE floor(value) = 0), f AS (SELECT doc_id, indicator, min(ord) AS o FROM z GROUP BY 1, 2)
 SELECT doc_id, count(*) AS zeros, (SELECT string_agg(indicator, ', ' ORDER BY o) FROM (SELECT * FROM f g WHERE g.doc_id = f.doc_id ORDER BY o LIMIT 4)) AS names FROM f GROUP BY doc_id""")
def zero_grouping(spark, sf):
    e, _ = user_facts(spark, sf)
    return R.zero_groups(e.select("doc_id", F.col("event_type").alias("indicator"), F.floor("value").cast("string").alias("actual"), "ord"))


@query("SELECT user_id AS doc_id, CASE WHEN bool_or(value > 95) THEN 'NGHIEM_TRONG' ELSE 'CAN_LUU_Y' END AS overall FROM events GROUP BY 1")
def overall_status(spark, sf):
    e, _ = user_facts(spark, sf)
    return R.overall_status(e.withColumn("severity", F.when(F.col("value") > 95, "CRITICAL").otherwise("MEDIUM")))


@query("""WITH b AS (SELECT user_id AS doc_id, event_id AS ord, event_type || '-' || event_id AS title, value, event_id % 2 AS k FROM events),
 t AS (SELECT doc_id, k, string_agg(title, '; ' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY ord, title) AS n FROM b) WHERE n <= 3 GROUP BY 1, 2)
 SELECT r.doc_id, rating, w.x AS warnings, a.x AS achievements FROM (SELECT doc_id, CASE WHEN bool_or(value > 95) THEN 'CANH_BAO_DO' ELSE 'ON_DINH' END AS rating FROM b WHERE k = 0 GROUP BY 1) r LEFT JOIN t w ON w.doc_id = r.doc_id AND w.k = 0 LEFT JOIN t a ON a.doc_id = r.doc_id AND a.k = 1""")
def legacy_projection(spark, sf):
    e, _ = user_facts(spark, sf)
    e = e.withColumn("severity", F.when(F.col("value") > 95, "CRITICAL").otherwise("MEDIUM"))
    return R.legacy_reports(e.filter("ord % 2 = 0"), e.filter("ord % 2 = 1"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') AND contains(lower(p_name), 'red') THEN 'x' END AS dummy, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'CRITICAL_ZERO' WHEN contains(lower(p_type), 'brass') THEN 'POSITIVE_ZERO' ELSE 'NEUTRAL_ZERO' END AS zero FROM part")
def zero_semantics(spark, sf):
    n = F.lower("p_name")
    return read(spark, sf, "part").select("p_partkey", F.when(n.contains("a") & n.contains("red"), "x").alias("dummy"), S.zero_semantics(F.col("p_type"), F.lit(None).cast("string"), ["steel", "tin"], ["brass"]).alias("zero"))


@query("""SELECT p_partkey, '"' || CASE WHEN p_partkey % 5 < 4 THEN '''' ELSE '' END || (CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '""' END) || trim(p_name) || '"' AS cell FROM part""")
def csv_sanitize(spark, sf):
    head = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", '"')]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", S.csv_cell(F.concat(head, F.col("p_name"))).alias("cell"))


def cleaned_sql(x: str) -> str:
    """The cleaner's rules as nested SQL replacements."""
    space = "[\\\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]".replace("\\\\s", "\\s")
    rules = [
        (rf"(?i)\[{space}*(?:CRITICAL|HIGH|MEDIUM|LOW|NGHIEM_TRONG|CAO|TRUNG_BINH|THAP|CAN_XU_LY|CẦN XỬ LÝ){space}*\]", ""), (rf"(?i)\[{space}*(?:Trang|Page){space}*[^\]]+\]", ""),
        (r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE00}-\x{FE0F}]", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"(?m)^#+[\t\n\v\f\r ]+", ""),
        (r"\([\t\n\v\f\r ]*\)|\[[\t\n\v\f\r ]*\]", ""), (f"{space}+", " "), (r" ([.,;:!?])", r"\1"), *[(rf"({c})[\t\n\v\f\r ]*(?:{c})+", m) for c, m in ((r"\.", "."), (",", ","), (";", ";"), (":", ":"), ("!", "!"), (r"\?", "?"))], ("\ufffd", ""),
    ]
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"


@query(f"SELECT doc_id, sha256({cleaned_sql("'[HIGH] **' || source || '** ( ) x ,, y . . [Trang 3] # ' || text")}) AS h FROM documents")
def text_clean(spark, sf):
    made = F.concat(F.lit("[HIGH] **"), "source", F.lit("** ( ) x ,, y . . [Trang 3] # "), "text")
    return read(spark, sf, "documents").select("doc_id", S.content_hash(S.clean_text(made)).alias("h"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') THEN '%' WHEN contains(p_type, 'TIN') THEN 'ha' ELSE '' END AS unit FROM part")
def unit_infer(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.infer_unit(F.col("p_type"), None, [("%", "steel"), ("ha", "tin")]).alias("unit"))


@query("""WITH x(ord, code, name, w) AS (VALUES (0, 'T0', 'steel', 'brass'), (1, 'T1', 'copper', 'plated'), (2, 'T2', 'nickel', 'polished')), v AS (SELECT p_partkey, p_type AS raw, lower(trim(p_type)) AS q FROM part)
 SELECT p_partkey, raw, coalesce((SELECT arg_min(code, ord) FROM x WHERE contains(name, q) OR contains(q, name) OR contains(q, w) OR contains(w, q)), 'OTHER') AS code FROM v""")
def taxonomy_resolve(spark, sf):
    dim = spark.createDataFrame([(0, "T0", "steel", ["brass"]), (1, "T1", "copper", ["plated"]), (2, "T2", "nickel", ["polished"])], "ord int, code string, name string, keywords array<string>")
    return A.resolve_taxonomy(read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("raw")), dim, "OTHER")


@query("SELECT p_partkey, least(1.0, levenshtein(p_type, p_brand) / length(p_type)::DOUBLE) AS cer FROM part")
def cer(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.error_rate(F.col("p_type"), F.col("p_brand")).alias("cer"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN u <= 0 THEN 0.0 ELSE i / u END AS iou FROM (SELECT *, 100.0 * 50 * 2 - i AS u FROM (SELECT l_orderkey, l_linenumber, greatest(0.0, 100.0 - l_quantity) * greatest(0.0, 50.0 - l_linenumber * 10.0) AS i FROM lineitem))""")
def bbox_iou(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 10.0
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.box_iou([F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)], [q, n, q + 100.0, n + 50.0]).alias("iou"))


@query("""WITH x AS (SELECT quality = 1 AS t, NOT contains(text, '###') AS e FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (t AND e) AS tp, count(*) FILTER (e) AS found, count(*) FILTER (t) AS truth FROM x), p AS (SELECT *, tp / found AS "precision", tp / truth AS recall FROM n)
 SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1 FROM p""")
def kpi_f1(spark, sf):
    x = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return A.confusion(x, ~F.col("text").contains("###"), F.col("quality") == 1)


@query("SELECT o_orderkey, 0.6 * (n % 4) / 3.0 + 0.4 * greatest(0, 1 - abs(n - 4) / 4) AS accuracy FROM (SELECT l_orderkey AS o_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)")
def table_accuracy(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("n"))
    return g.select("o_orderkey", A.table_accuracy(F.col("n") % 4, F.lit(3.0), F.col("n"), F.lit(4.0)).alias("accuracy"))


def jobs(spark, sf) -> DataFrame:
    t = F.col("event_type")
    return read(spark, sf, "events").select((F.col("user_id") % 20).alias("batch_id"), F.when(t == "purchase", "COMPLETED").when(t == "click", "FAILED").otherwise("PARSING").alias("status"), (F.col("event_id") % 101).alias("progress"))


JOBS = "j AS (SELECT user_id % 20 AS batch_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'FAILED' ELSE 'PARSING' END AS s, event_id % 101 AS p FROM events), b AS (SELECT batch_id, count(*) AS total, count(*) FILTER (s = 'COMPLETED') AS completed, count(*) FILTER (s = 'FAILED') AS failed, count(*) FILTER (s = 'PARSING') AS active, floor(avg(p) + 0.5)::BIGINT AS progress_percent, bool_and(s <> 'PARSING') AS is_complete FROM j GROUP BY 1)"


@query(f"WITH {JOBS} SELECT * FROM b")
def batch_progress(spark, sf):
    return A.batch_progress(jobs(spark, sf))


@query(f"WITH {JOBS} SELECT count(*) AS batches, count(*) FILTER (NOT is_complete) AS active_batches, sum(completed)::BIGINT AS completed_jobs, sum(failed)::BIGINT AS failed_jobs FROM b")
def queue_metrics(spark, sf):
    return A.queue_metrics(A.batch_progress(jobs(spark, sf)))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS anchor FROM events""")
def footnote_asof(spark, sf):
    return A.nearest_before(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"), 30).select("event_id", "user_id", "anchor")


def boxes_and_lines(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id")).alias("k"), (F.col("event_id") % 5000 * 1.0).alias("y"), "event_id", "event_type")
    boxes = e.filter("event_id % 10 = 0").select("k", F.col("event_id").alias("box"), F.col("y").alias("top"))
    lines = e.filter("event_id % 10 <> 0").select("k", F.col("y").alias("bottom"), F.concat_ws("-", "event_type", F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("text"))
    return boxes, lines


@query("""WITH e AS (SELECT user_id AS k, (event_id % 5000)::DOUBLE AS y, event_id, event_type || '-' || lpad(event_id::VARCHAR, 9, '0') AS t FROM events), b AS (SELECT k, event_id AS box, y AS top FROM e WHERE event_id % 10 = 0), l AS (SELECT k, y AS bottom, t FROM e WHERE event_id % 10 <> 0),
 n AS (SELECT b.k, box, arg_min(t, ((CASE WHEN starts_with(t, 'view') THEN 0 ELSE 1 END), top - bottom, t)) AS title FROM b JOIN l ON l.k = b.k AND bottom <= top AND top - bottom <= 70 GROUP BY 1, 2) SELECT b.k, b.box, b.top, title FROM b LEFT JOIN n ON n.k = b.k AND n.box = b.box""")
def range_context(spark, sf):
    boxes, lines = boxes_and_lines(spark, sf)
    return A.nearest_above(lines, boxes, "k", 70.0, F.col("text").startswith("view")).select("k", "box", "top", "title")


@query("""WITH s AS (SELECT p_name AS t, CASE WHEN p_name < 'm' THEN p_size - 25 ELSE p_size / 10 END::INTEGER AS angle, p_partkey % 50 AS page FROM part) SELECT t AS text, count(*) AS n, max(abs(angle)) AS tilt, count(DISTINCT page) AS pages FROM s WHERE length(t) >= 4 GROUP BY 1 HAVING max(abs(angle)) > 10 OR (contains(lower(t), 'ring') AND length(t) <= 80)""")
def watermark_stats(spark, sf):
    angle = F.when(F.col("p_name") < "m", F.col("p_size") - 25).otherwise(F.rint(F.col("p_size") / 10).cast("int"))
    s = read(spark, sf, "part").select(F.col("p_name").alias("text"), angle.alias("angle"), (F.col("p_partkey") % 50).alias("page"))
    return TX.watermarks(s, ["ring"]).select("text", "n", "tilt", "pages")


@query("SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS page FROM conversations WHERE NOT (trim(text) = '' OR (length(trim(text)) <= 5 AND regexp_matches(trim(text), '^\\d+$'))) OR turn % 4 = 0")
def dense_pages(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", F.when(F.col("turn") % 4 == 0, 1).otherwise(0).alias("n_tables"))
    return TX.dense_pages(c).select("doc_id", "page")


@query("SELECT conv_id AS doc_id, sum(length(text))::BIGINT AS total_chars, count(*) AS pages, sum(length(text)) < 50 * count(*) AS is_scanned FROM conversations GROUP BY 1")
def scanned_flag(spark, sf):
    from ..sources.files import scanned

    return scanned(read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.length("text").alias("char_count")))


@query("""SELECT o_orderkey AS doc_id, '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS markdown FROM orders""")
def markdown_table(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("ord"), F.array(F.lit("k"), F.lit("v")).alias("headers"), F.array(F.array("o_orderstatus", "o_orderpriority")).alias("rows"))
    return X.markdown_tables(rows).select("doc_id", "markdown")


@query("""SELECT o_orderkey AS doc_id, chr(65279) || '"=== BẢNG 1: ' || o_orderstatus || ' (Trang 2) ==="' || chr(13) || chr(10) || '"k","v"' || chr(13) || chr(10) || '"' || o_orderstatus || '","''-' || o_orderpriority || '"' || repeat(chr(13) || chr(10), 2) AS csv FROM orders""")
def csv_export(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("ord"), F.col("o_orderstatus").alias("title"), F.lit(2).alias("page_ref"), F.array(F.lit("k"), F.lit("v")).alias("headers"), F.array(F.array(F.col("o_orderstatus"), F.concat(F.lit("-"), F.col("o_orderpriority")))).alias("rows"))
    return X.csv_documents(o)


@query("""SELECT '{' || chr(10) || '  "n_nationkey" : ' || n_nationkey || ',' || chr(10) || '  "n_name" : "' || n_name || '",' || chr(10) || '  "n_regionkey" : ' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE 'null' END || chr(10) || '}' AS json FROM nation""")
def json_export(spark, sf):
    n = read(spark, sf, "nation")
    return X.json_documents(n.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey")))


@query("SELECT user_id % 5 AS batch_id, user_id AS job_id, CASE WHEN bool_or(event_type = 'click') THEN 'FAILED' WHEN bool_or(event_type = 'purchase') THEN 'COMPLETED' ELSE 'PARSING' END AS state FROM events GROUP BY 1, 2")
def job_states(spark, sf):
    e = read(spark, sf, "events")
    t = F.col("event_type")
    return I.job_states(e.select((F.col("user_id") % 5).alias("batch_id"), F.col("user_id").alias("job_id"), F.when(t == "purchase", "COMPLETED").when(t == "click", "FAILED").otherwise("PARSING").alias("state"), "ts")).select("batch_id", "job_id", "state")


@query()
def stream_dedup_ingest(spark, sf):
    """Events as a stream: the first of each payload within the watermark, in one run, into files."""
    from ..sources.shared import shared_folder

    schema, at = read(spark, sf, "events").schema, shared_folder(spark, "dedup-ingest")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    rows = I.dedup_stream(stream, "props", "ts", "60 days").select("event_id", "content_hash")
    rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


@query("SELECT ts::DATE::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf):
    return I.daily_counts(read(spark, sf, "events"))


@query("SELECT o_orderkey, trim(regexp_replace('Bao dong ' || o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '_') AS stem FROM orders")
def file_names(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", S.file_stem(F.concat(F.lit("Báo động "), F.col("o_orderpriority"))).alias("stem"))


def order_tables(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    rows = F.array(F.array(F.lit("1"), F.concat(F.col("o_orderstatus"), F.lit("  x\ny"))), F.array(F.lit("tổng cộng"), F.col("o_totalprice").cast("int").cast("string")))
    return o.select(F.col("o_orderkey").alias("table_id"), rows.alias("rows"))


@query("""SELECT o_orderkey AS table_id, r AS row_index, c AS col_index, CASE WHEN r = 0 AND c = 0 THEN '1' WHEN r = 0 THEN o_orderstatus || ' x y' WHEN c = 0 THEN 'tổng cộng' ELSE trunc(o_totalprice)::INTEGER::VARCHAR END AS text
 FROM orders, (VALUES (0), (1)) AS a(r), (VALUES (0), (1)) AS b(c)""")
def table_cells(spark, sf):
    t = order_tables(spark, sf)
    return T.cells(t.withColumn("rows", T.clean_cells(F.col("rows"))))


@query("SELECT o_orderkey AS table_id, CASE WHEN o_custkey % 3 = 0 THEN 'TOTAL' WHEN o_custkey % 3 = 1 AND o_orderstatus = 'F' THEN 'SECTION' WHEN o_custkey % 3 = 2 THEN 'SECTION' ELSE 'DATA' END AS row_class FROM orders")
def row_classes(spark, sf):
    k = F.col("o_custkey") % 3
    row = F.when(k == 0, F.array(F.col("o_orderstatus"), F.lit("Cộng"), F.lit("1"))).when(k == 1, F.array(F.when(F.col("o_orderstatus") == "F", "IV").otherwise("4"), F.lit("a"), F.lit("2"))).otherwise(F.array(F.lit(""), F.col("o_orderpriority"), F.lit("")))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), T.row_class(row).alias("row_class"))


@query("SELECT l_orderkey AS table_id, c AS col_index, CASE WHEN c = 0 THEN 'RIGHT' ELSE 'LEFT' END AS align FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES (0), (1)) AS a(c)")
def column_alignment(spark, sf):
    l = read(spark, sf, "lineitem")
    cell = F.posexplode(F.array(F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"))).alias("col_index", "text")
    return T.alignment(l.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row_index"), cell))


@query("""WITH h AS (SELECT l_orderkey AS table_id, l_linenumber AS col_index, CASE WHEN l_linenumber % 3 = 1 THEN min(l_returnflag) ELSE '' END AS parent FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, sum(CASE WHEN parent <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY col_index) AS run FROM h)
 SELECT table_id, run::BIGINT AS run, min(col_index) AS from_col, count(*) AS span, arg_min(parent, col_index) AS parent FROM r GROUP BY 1, 2""")
def header_spans(spark, sf):
    l = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("col_index")).agg(F.min("l_returnflag").alias("flag"))
    return T.header_spans(l.select("table_id", "col_index", F.when(F.col("col_index") % 3 == 1, F.col("flag")).otherwise("").alias("parent")))


@query("""SELECT o_orderkey AS doc_id, o_orderstatus AS title, 'Triển khai: ' || o_orderstatus AS description, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Văn phòng' END AS assignee, 'Trong kỳ' AS due, 'NORMAL' AS priority FROM orders WHERE o_custkey % 10 IN (1, 3)""")
def work_items(spark, sf):
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 10).cast("int").alias("ord"), F.col("o_orderstatus").alias("action_title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("owner_department"), F.lit(None).cast("string").alias("deadline"))
    return R.work_items(a, [1, 3])


@query("""SELECT o_orderkey AS doc_id, o_custkey || '/BC-UBND' AS document_number, strftime(o_orderdate, '%Y-%m-%d') AS issuance_date, 'tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) AS reporting_period, CASE WHEN o_orderkey % 2 = 0 THEN 'TO_TRINH' ELSE 'BAO_CAO' END AS document_type FROM orders""")
def metadata_scalars(spark, sf):
    o = read(spark, sf, "orders")
    day = F.concat(F.lit("ngày "), F.dayofmonth("o_orderdate"), F.lit(" tháng "), F.month("o_orderdate"), F.lit(" năm "), F.year("o_orderdate"))
    text = F.concat(F.lit("UBND\nSố: "), F.col("o_custkey"), F.lit("/BC-UBND "), day, F.when(F.col("o_orderkey") % 2 == 0, F.lit("\nTỜ TRÌNH\n")).otherwise("\nBÁO CÁO\n"))
    t = o.select(F.col("o_orderkey").alias("doc_id"), text.alias("t"))
    return t.select("doc_id", S.document_number(F.col("t")).alias("document_number"), S.issuance_date(F.col("t")).alias("issuance_date"), S.reporting_period(F.col("t")).alias("reporting_period"), S.document_type(F.col("t")).alias("document_type"))


@query("SELECT l_orderkey, l_linenumber, round(degrees(atan2(l_discount, l_quantity)), 1) AS angle FROM lineitem")
def rotation_angle(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.rotation(F.col("l_quantity"), F.col("l_discount")).alias("angle"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS s FROM part) SELECT p_partkey, unnest(s) AS word, 100.0 * unnest(range(len(s))) / len(s) AS x0 FROM w""")
def word_boxes(spark, sf):
    b = F.explode(S.word_boxes(F.col("p_type"), F.lit(0.0), F.lit(100.0))).alias("b")
    return read(spark, sf, "part").select("p_partkey", b).select("p_partkey", "b.word", F.col("b.x0").alias("x0"))


@query("SELECT conv_id, turn, (length(text) < 40 AND turn % 2 = 0) OR length(text) = 0 AS needs_ocr FROM conversations")
def ocr_routing(spark, sf):
    from ..sources.files import needs_ocr

    c = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("char_count"), (F.col("turn") % 2 == 0).alias("has_images"))
    return needs_ocr(c).select("conv_id", "turn", "needs_ocr")


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS o, l_linenumber % 4 >= 2 AS k FROM lineitem), m AS (SELECT *, coalesce(k <> lag(k) OVER w, true) AS fresh FROM t WINDOW w AS (PARTITION BY d ORDER BY o)),
 i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY d ORDER BY o) AS master FROM m) SELECT d AS doc_id, master::INTEGER AS master, count(*)::INTEGER AS pieces, (count(*) - count(*) FILTER (NOT fresh AND o % 4 = 1))::INTEGER AS n_rows FROM i GROUP BY 1, 2""")
def table_stitching(spark, sf):
    n = F.col("l_linenumber")
    heads = F.when(n % 4 >= 2, F.array(F.lit("Ghi"), F.lit("Giá"))).otherwise(F.array(F.lit("STT"), F.lit("Tên")))
    rows = F.array(F.array(F.when(n % 4 == 1, "").otherwise(n.cast("string")), F.lit("chữ")))  # every fourth row overflows
    t = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("ord")).distinct().withColumn("l_linenumber", F.col("ord")).select("doc_id", "ord", heads.alias("headers"), rows.alias("rows"))
    return TX.stitch_tables(t).select("doc_id", "master", "pieces", F.size("rows").alias("n_rows"))


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'WATERMARK' WHEN p_size * 15 < 70 THEN 'HEADER' WHEN p_size * 15 + 10 > 700 - 60 THEN 'FOOTER' WHEN p_partkey % 3 = 0 THEN 'HEADING_1' ELSE 'PARAGRAPH' END AS block_type FROM part")
def block_types(spark, sf):
    top = F.col("p_size") * 15
    return read(spark, sf, "part").select("p_partkey", S.block_type(top, top + 10, F.lit(700), F.col("p_partkey") % 3 == 0, F.col("p_size") < 5).alias("block_type"))


from . import documents, structure  # noqa: E402, F401  registers their queries
