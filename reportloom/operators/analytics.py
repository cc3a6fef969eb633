"""Analytics across reports: trends, heat map, comparison of two periods, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def first_distinct(value: Column, order: Column, most: int | None = None) -> Column:
    """Distinct non-empty values in order of first appearance (an aggregate)."""
    kept = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull() & (value != ""), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"]))
    return F.slice(kept, 1, most) if most else kept


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: str, most: int | None, name: str) -> DataFrame:
    """The same over groups of any size: duplicates are combined before the shuffle and, with
    a cap, only the first `most` values of a group are ever collected."""
    firsts = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    if most:
        firsts = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", value))).filter(F.col("_n") <= most)
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))


def kpi_trends(metrics: DataFrame, indicator: str | None = None, authority: str | None = None) -> DataFrame:
    """metrics (indicator, authority, period, actual, percentage, status, ord) -> one row a
    series with its growth and trajectory (A1, A2, V1). The ends of a series come from
    aggregates of bounded state, so no timeline is collected for them."""
    rows = metrics
    for c, q in (("indicator", indicator), ("authority", authority)):
        if q:
            rows = rows.filter(F.contains(F.lower(c), F.lower(F.lit(q))))
    at = F.struct(F.coalesce("period", F.lit("")).alias("p"), F.col("ord").alias("o"))
    value = S.lenient_float(F.when(F.col("percentage") != "", F.col("percentage")).otherwise(F.nullif("actual", F.lit(""))))
    point = F.struct(value.alias("v"))
    keys = [F.lower(F.trim("indicator")).alias("k1"), F.lower(F.trim("authority")).alias("k2")]
    out = rows.groupBy(*keys).agg(
        F.min_by("indicator", "ord").alias("indicator"), F.min_by("authority", "ord").alias("authority"), F.count("*").alias("points"),
        F.min_by(point, at).alias("a"), F.max_by(point, at).alias("z"), F.max_by(F.col("status"), at).alias("latest_status"),
    )
    a, z = F.col("a.v"), F.col("z.v")
    growth = F.when((F.col("points") >= 2) & a.isNotNull() & z.isNotNull() & (a != 0), S.half_up((z - a) / a * 1000) / 10)
    out = out.withColumn("growth_rate", growth)
    shape = F.when(F.col("growth_rate") > 2, "IMPROVING").when(F.col("growth_rate") < -2, "DECLINING").otherwise("STABLE")
    return out.select("indicator", "authority", "points", a.alias("first_value"), z.alias("last_value"), "growth_rate", shape.alias("trajectory"), "latest_status")


def kpi_timeline(metrics: DataFrame) -> DataFrame:
    """Every point with its place in its series."""
    w = Window.partitionBy(F.lower(F.trim("indicator")), F.lower(F.trim("authority"))).orderBy(F.coalesce("period", F.lit("")), "ord")
    return metrics.withColumn("point", F.row_number().over(w))


def heatmap(rows: DataFrame) -> DataFrame:
    """rows (category, urgency, authority, root_cause, problem, ord) -> one row a category,
    most occurrences first (A3, O1)."""
    rows = rows.withColumn("cause", F.coalesce(F.nullif("root_cause", F.lit("")), F.nullif("problem", F.lit(""))))
    counts = rows.groupBy("category").agg(F.count("*").alias("occurrences"), F.count_if(F.col("urgency").isin("HIGH", "CRITICAL")).alias("high_urgency"), F.min("ord").alias("first_ord"))
    who = distinct_in_order(rows, ["category"], "authority", "ord", None, "authorities")
    why = distinct_in_order(rows, ["category"], "cause", "ord", 5, "root_causes")
    return counts.join(who, "category", "left").join(why, "category", "left").orderBy(F.desc("occurrences"), "first_ord")


GRAM = 3


def grams(c: Column, n: Column) -> Column:
    """The distinct pieces of n characters of a text of n characters or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """short (s), long (l), distinct texts -> the pairs (s, l) in which l contains s. Each s looks
    up one of its pieces, the one that fewest l hold, so this is an equi-join whose candidates are
    then verified; a text shorter than a piece is a piece of its own length. An empty s is in every
    l by definition and is left to the caller."""
    index = None
    for n in range(1, GRAM + 1):
        part = long.filter(F.length("l") >= n).select("l", F.explode(grams(F.col("l"), F.lit(n))).alias("g"))
        index = part if index is None else index.union(part)
    sizes = short.select(F.least(F.length("s"), F.lit(GRAM)).alias("n")).filter("n > 0").distinct()
    index = index.join(F.broadcast(sizes), F.length("g") == F.col("n")).select("l", "g")  # at most GRAM rows
    held = index.groupBy("g").agg(F.count("*").alias("hits"))
    asked = short.filter(F.length("s") > 0).select("s", F.explode(grams(F.col("s"), F.least(F.length("s"), F.lit(GRAM)))).alias("g"))
    # a piece that no l holds decides against its s
    rarest = asked.join(held, "g", "left").groupBy("s").agg(F.min_by("g", F.struct(F.coalesce("hits", F.lit(0)), "g")).alias("g"))
    return rarest.join(index, "g").filter(F.col("l").contains(F.col("s"))).select("s", "l")


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (ord, indicator, value, status): each row of a with the first of b of equal or
    containing name (J1). Distinct names meet by an equi-join on rare pieces, both ways round."""
    name = lambda c: F.lower(F.trim(c))
    left = a.withColumn("na", name("indicator"))
    names_a = left.select("na").distinct()
    names_b = b.groupBy(name("indicator").alias("nb")).agg(F.min("ord").alias("ob"))
    shorter = containing(names_a.select(F.col("na").alias("s")), names_b.select(F.col("nb").alias("l"))).select(F.col("s").alias("na"), F.col("l").alias("nb"))
    longer = containing(names_b.select(F.col("nb").alias("s")), names_a.select(F.col("na").alias("l"))).select(F.col("l").alias("na"), F.col("s").alias("nb"))
    # an empty name is part of every name: it takes, or gives, the first row of b
    anything = names_a.filter("na = ''").join(F.broadcast(names_b.agg(F.min("ob").alias("ob"))))  # one row each
    blank = names_a.join(F.broadcast(names_b.filter("nb = ''").select("ob")))  # at most one row
    hits = shorter.union(longer).join(names_b, "nb").select("na", "ob").union(anything).union(blank)
    best = hits.groupBy("na").agg(F.min("ob").alias("ob"))
    right = b.select(F.col("ord").alias("ob"), F.col("value").alias("value_b"), F.col("status").alias("status_b"))
    out = left.join(best, "na", "left").join(right, "ob", "left")
    both = F.col("value").isNotNull() & F.col("value_b").isNotNull()
    better = F.when(F.col("ob").isNull(), False).when(both, F.col("value_b") >= F.col("value")).otherwise((F.col("status_b") == "GREEN") & (F.col("status") != "GREEN"))
    return out.select("ord", "indicator", F.col("value").alias("value_a"), "value_b", F.coalesce("status_b", F.lit("NOT_REPORTED")).alias("status_b"), better.alias("is_improved"))


def persistent(b: DataFrame, a: DataFrame, text: str, width: int = 15, keep: bool = True) -> DataFrame:
    """Rows of b whose text shares a leading piece with some text of a (J2), or the others
    (J3). Distinct leading pieces and texts of both sides meet by an equi-join on rare pieces. An
    empty text is part of every text."""
    ta = a.select(F.col(text).alias("ta")).filter(F.col(text).isNotNull()).distinct()
    tb = b.select(F.col(text).alias("tb")).filter(F.col(text).isNotNull()).distinct()
    head = lambda c: F.substring(c, 1, width)
    begun = containing(tb.select(head("tb").alias("s")).distinct(), ta.select(F.col("ta").alias("l"))).select("s").distinct()
    found = containing(ta.select(head("ta").alias("s")).distinct(), tb.select(F.col("tb").alias("l"))).select(F.col("l").alias("tb"))
    hit = tb.join(begun, head("tb") == F.col("s"), "left_semi").union(found)
    some_a, blank_a = ta.limit(1).withColumn("one", F.lit(1)), ta.filter("ta = ''").withColumn("one", F.lit(1))
    empty = tb.withColumn("one", F.lit(1)).join(F.broadcast(blank_a.select("one")), "one", "left_semi").select("tb").union(tb.filter("tb = ''").withColumn("one", F.lit(1)).join(F.broadcast(some_a.select("one")), "one", "left_semi").select("tb"))
    hit = hit.union(empty).distinct()
    return b.join(hit, b[text].eqNullSafe(hit["tb"]), "left_semi" if keep else "left_anti")


def report_pair(reports: DataFrame, a: str, b: str) -> DataFrame:
    """One row with both reports as structs, no row if either is missing."""
    one = lambda i, name: reports.filter(F.col("id") == i).limit(1).select(F.struct("*").alias(name))
    return one(a, "a").join(F.broadcast(one(b, "b")))  # one row each


def kpi_matches(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """expected, extracted (doc_id, indicator) -> precision, recall and F1 of each document, names
    matching where one contains the other (J11, A16)."""
    name = lambda c: F.lower(c)
    e = extracted.groupBy("doc_id").agg(F.collect_set(name("indicator")).alias("names"), F.count("*").alias("found"))  # one document's metrics
    rows = expected.join(e, "doc_id", "left")
    hit = F.exists("names", lambda n: F.contains(n, name("indicator")) | F.contains(name("indicator"), n))
    g = rows.groupBy("doc_id").agg(F.count("*").alias("truth"), F.count_if(F.coalesce(hit, F.lit(False))).alias("tp"), F.coalesce(F.max("found"), F.lit(0)).alias("found"))
    g = g.withColumn("precision", F.when(F.col("found") > 0, F.col("tp") / F.col("found")).otherwise(0.0)).withColumn("recall", F.col("tp") / F.col("truth"))
    both = F.col("precision") + F.col("recall")
    return g.select("doc_id", "truth", "found", "tp", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def header_hits(expected: Column, extracted: Column) -> Column:
    """How many expected headers contain an extracted one or are contained in one."""
    low = F.transform(extracted, F.lower)
    return F.size(F.filter(F.transform(expected, F.lower), lambda e: F.exists(low, lambda h: F.contains(h, e) | F.contains(e, h))))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Documents by audit status."""
    c = F.col(status)
    return rows.agg(F.count("*").alias("total"), *[F.count_if(c == s).alias(s.lower()) for s in ("PERFECT", "WARNING", "ERROR", "FAILED")])


def run_rollup(rows: DataFrame, status: str = "status") -> DataFrame:
    """Results of a test run: passed, failed, skipped, and the share of passes among the supported."""
    c = F.col(status)
    g = rows.agg(F.count("*").alias("total"), F.count_if(c == "PASS").alias("passed"), F.count_if(c == "FAIL").alias("failed"), F.count_if(c == "UNSUPPORTED_FORMAT").alias("skipped"))
    valid = F.col("total") - F.col("skipped")
    return g.withColumn("pass_percent", F.when(valid > 0, F.round(F.col("passed") * 100.0 / valid, 1)))


def text_preservation(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source_chars, text) -> share of the text that an output kept, and the traces of
    broken output in it (S34)."""
    t = F.coalesce("text", F.lit(""))
    ratio = F.length(t) / F.when(F.coalesce("source_chars", F.lit(0)) == 0, 1).otherwise(F.col("source_chars"))
    count = lambda p, fold=False: F.regexp_count(t, F.lit(("(?i)" if fold else "") + p))
    out = rows.select("doc_id", S.half_up(ratio * 100).alias("kept_percent"), ((ratio < 0.6) & (F.col("source_chars") > 500)).alias("low"), count("\ufffd").alias("ufffd"), count(r"\bundefined\b", True).alias("undefined"), count(r"\bnull\b", True).alias("nulls"), count(r"\bNaN\b").alias("nan"))
    broken = (F.col("ufffd") > 0) | (F.col("undefined") > 0) | (F.col("nan") > 0)
    return out.withColumn("status", F.when(broken, "ERROR").when(F.coalesce("low", F.lit(False)), "WARNING").otherwise("PERFECT"))


def executive_summary(reports: DataFrame, metrics: DataFrame, bottlenecks: DataFrame) -> DataFrame:
    """One row of counts (A4). Absent authorities count as one."""
    r = reports.agg(F.count("*").alias("total_reports"), (F.count_distinct("authority") + F.max(F.col("authority").isNull().cast("int"))).alias("authorities"))
    m = metrics.agg(F.count("*").alias("total_metrics"), F.count_if(F.col("status") == "RED").alias("red_metrics"))
    b = bottlenecks.agg(F.count("*").alias("total_bottlenecks"), F.count_if(F.col("urgency").isin("HIGH", "CRITICAL")).alias("urgent_bottlenecks"))
    return r.join(F.broadcast(m)).join(F.broadcast(b))  # one row each


def category_counts(rows: DataFrame, category: str, order: str) -> DataFrame:
    """Counts, greatest first, ties by first appearance (A5)."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.min(order).alias("first_ord")).orderBy(F.desc("n"), "first_ord")


MOST_DOMAINS = 1000


def resolve_taxonomy(values: DataFrame, taxonomy: DataFrame, default: str) -> DataFrame:
    """values (raw), taxonomy (ord, code, name, keywords) -> raw, code: the first row of the
    registry whose name or a keyword contains the value or is contained in it (J13). The
    registry is a fixed small table."""
    raw = values.select("raw").distinct().withColumn("q", F.lower(F.trim("raw")))
    either = lambda x: x.contains(F.col("q")) | F.col("q").contains(x)
    if len(taxonomy.head(MOST_DOMAINS + 1)) > MOST_DOMAINS:
        raise ValueError(f"the registry has more than {MOST_DOMAINS} rows")
    hit = raw.join(F.broadcast(taxonomy), either(F.lower("name")) | F.exists("keywords", either)).groupBy("raw").agg(F.min_by("code", "ord").alias("code"))
    return values.join(hit, "raw", "left").withColumn("code", F.coalesce("code", F.lit(default)))


def batch_progress(jobs: DataFrame, done: str = "COMPLETED", failed: str = "FAILED") -> DataFrame:
    """jobs (batch_id, status, progress) -> one row a batch."""
    c = F.col("status")
    return jobs.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(c == done).alias("completed"), F.count_if(c == failed).alias("failed"), F.count_if(~c.isin(done, failed)).alias("active"),
        F.floor(F.avg("progress") + 0.5).alias("progress_percent"), F.every(c.isin(done, failed)).alias("is_complete"),
    )


def queue_metrics(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count("*").alias("batches"), F.count_if(~F.col("is_complete")).alias("active_batches"), F.sum("completed").alias("completed_jobs"), F.sum("failed").alias("failed_jobs"))


def nearest_before(rows: DataFrame, keys: list[str], order: list[str], is_anchor: Column, anchor: Column, within: int) -> DataFrame:
    """The nearest preceding anchor at most `within` rows back (J14), by one ordered window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("anchor", F.last(F.when(is_anchor, anchor), ignorenulls=True).over(w.rowsBetween(-within, -1)))


def nearest_above(lines: DataFrame, boxes: DataFrame, key: str, gap: float, wanted: Column) -> DataFrame:
    """lines (key, bottom, text), boxes (key, box, top): the nearest line above each box within
    the gap, wanted ones first (J8). Bins of the gap's width make it an equi-join."""
    l = lines.withColumn("bin", F.explode(F.array(F.floor(F.col("bottom") / gap), F.floor(F.col("bottom") / gap) + 1)))
    b = boxes.withColumn("bin", F.floor(F.col("top") / gap))
    near = b.join(l, [key, "bin"]).filter((F.col("bottom") <= F.col("top")) & (F.col("top") - F.col("bottom") <= gap))
    best = near.groupBy(key, "box").agg(F.min_by("text", F.struct(F.when(wanted, 0).otherwise(1), F.col("top") - F.col("bottom"), "text")).alias("title"))
    return boxes.join(best, [key, "box"], "left")


def confusion(rows: DataFrame, extracted: Column, expected: Column) -> DataFrame:
    """Precision, recall and F1 (A16): all 1 where nothing was expected, precision 0 where nothing
    was extracted."""
    n = rows.agg(F.count_if(extracted & expected).alias("tp"), F.count_if(extracted).alias("found"), F.count_if(expected).alias("truth"))
    p = F.when(F.col("truth") == 0, 1.0).when(F.col("found") == 0, 0.0).otherwise(F.col("tp") / F.col("found"))
    r = F.when(F.col("truth") == 0, 1.0).otherwise(F.col("tp") / F.col("truth"))
    return n.select("tp", "found", "truth", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def table_accuracy(header_hits: Column, headers: Column, rows_got: Column, rows_want: Column) -> Column:
    """0.6 of the header share and 0.4 of how near the row counts are."""
    row = F.greatest(F.lit(0.0), 1 - F.abs(rows_want - rows_got) / F.greatest(F.lit(1), rows_want))
    return F.when(headers == 0, 1.0).otherwise(0.6 * header_hits / headers + 0.4 * row)
