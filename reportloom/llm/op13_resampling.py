"""Operator 13: importance resampling towards a target, scored without exploding.

Hashed word features (runs of 1 and 2 words into 10,000 buckets). Each document's array of
bucket numbers is made by higher-order functions over its array of words, once, and written
beside its doc_id in the shared folder. Counting is the one place where buckets become rows:
they are summed map-side, so each task sends at most 10,000 counts. The gains of all buckets
are one literal array of 10,000 entries; a document's weight is an aggregate over element_at
of it, with no join and no shuffle. The draw (highest noisy scores first) needs places over the
whole table: rows (doc_id, four numbers) are range-partitioned by score, written, and each
partition starts at the sum of those before it.

Defined results: a null or empty text, or one without words, has no feature, weight 0 and a
score of its own, and can't be drawn; without words in all texts the gains are those of the
formula at S = T = 0; null doc_ids hash as the text `7:` alone and come after others of their
score; repeated rows are rows of their own; an empty table gives no rows. Other columns are
left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 7
PERCENT = 25
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    """Words of a text with A-Z in lower case; none of a null."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature), F.lit(buckets)).cast("smallint")


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """rows (text, any others) -> the others, n_words, and b: the bucket of every feature."""
    w = F.col("_w")
    single = F.transform(w, lambda x: bucket(x, buckets))
    pair = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: bucket(F.concat(a, F.lit(" "), b), buckets))
    made = rows.withColumn("_w", F.coalesce(words_of("text"), F.array().cast("array<string>")))
    return made.select(*[c for c in rows.columns if c != "text"], F.size(w).alias("n_words"), F.concat(single, pair).alias("b"))


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows: at most one count a bucket and task is shuffled."""
    got = rows.select(F.explode("b").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r.k] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n)))) of each bucket."""
    n = len(source)
    s_all, t_all = int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def scores(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) from bucketed rows."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded into one literal
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, k: a + F.element_at(table, k.cast("int") + 1))
    floored = F.when(F.col("_n") > 0, F.expr("(_sum - pmod(_sum, _n)) div _n")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    held = rows.select("doc_id", "n_words", F.size("b").cast("long").alias("_n"), total.alias("_sum"))
    return held.select("doc_id", F.col("_n").alias("n_features"), "n_words", floored.alias("weight"), noise.alias("_noise")).withColumn("score", F.col("weight") + F.col("_noise")).drop("_noise")


def drawn(scored: DataFrame, scratch: C.Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_features, n_words, weight, score) with rank: 1, 2, 3... of the highest
    scores of documents with enough words, null beyond that share of them."""
    spark = scored.sparkSession
    fits = F.col("n_words") >= least_words
    rows = scored.withColumn("fits", fits).withColumn("tie", F.monotonically_increasing_id())
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kept = scratch.keep(ranged)
    counts = kept.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).orderBy("part").collect()  # one row a partition
    most, before, starts = percent * sum(c.fit for c in counts) // 100, 0, []
    for c in counts:
        starts.append((c.part, before))
        before += c.n
    start = spark.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = kept.join(F.broadcast(start), "part").withColumn("place", place)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (F.col("place") <= most), F.col("place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) drawn towards target (text): doc_id, n_features, weight, score, rank."""
    scratch = C.Scratch(docs.sparkSession, "resampling")
    rows = scratch.keep(bucketed(docs.select(F.col("doc_id").cast("long"), "text")))
    gain = gains(totals(rows), totals(bucketed(target.select("text"))))
    return drawn(scores(rows, gain, seed), scratch, percent)


def query(spark, sf_dir):
    return resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


#: DuckDB has no CRC-32, but it is linear: u holds the checksum register of a single bit k steps on, c
#: that of each byte at each distance from a feature's end, i that of the initial register.
ORACLE_SQL = r"""WITH RECURSIVE
 texts AS (SELECT doc_id, 0 AS bench, row_number() OVER () AS r, text FROM documents UNION ALL SELECT item_id, 1, row_number() OVER (), text FROM benchmark),
 w AS (SELECT doc_id, bench, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM texts),
 f AS (SELECT bench, r, unnest(l) AS f FROM w UNION ALL SELECT bench, r, unnest(list_transform(list_zip(l[:-2], l[2:]), lambda x: x[1] || ' ' || x[2])) FROM w WHERE len(l) > 1),
 n AS (SELECT bench, r, f, count(*) AS n FROM f GROUP BY 1, 2, 3),
 d AS (SELECT f, octet_length(encode(f)) AS size, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
 u(k, v) AS (SELECT 0, 1::BIGINT UNION ALL SELECT k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM u WHERE k < (SELECT 8 * max(size) FROM d)),
 c AS (SELECT q.at, b.b, bit_xor(u.v) AS v FROM (SELECT unnest(range(1, (SELECT max(size) FROM d) + 1)) AS at) q, (SELECT unnest(range(256)) AS b) b, (SELECT unnest(range(8)) AS j) j JOIN u ON u.k = 8 * q.at - j WHERE (b.b >> j) & 1 = 1 GROUP BY 1, 2),
 i AS (SELECT s.size, bit_xor(CASE WHEN 8 * s.size >= j THEN u.v ELSE 1::BIGINT << (j - 8 * s.size) END) AS v FROM (SELECT DISTINCT size FROM d) s, (SELECT unnest(range(32)) AS j) j LEFT JOIN u ON u.k = 8 * s.size - j GROUP BY 1),
 e AS (SELECT f, size, unnest(range(size)) AS p, h FROM d),
 x AS (SELECT e.f, any_value(e.size) AS size, bit_xor(coalesce(c.v, 0)) AS v FROM e LEFT JOIN c ON c.at = e.size - e.p AND c.b = ('0x' || substr(e.h, 2 * e.p + 1, 2))::INTEGER GROUP BY 1),
 b AS (SELECT x.f, xor(xor(x.v, i.v), 4294967295) % 10000 AS b FROM x JOIN i ON i.size = x.size),
 m AS (SELECT n.bench, n.r, b.b, sum(n.n) AS n FROM n JOIN b ON b.f = n.f GROUP BY 1, 2, 3),
 s AS (SELECT b, sum(n) FILTER (bench = 0) AS s, sum(n) FILTER (bench = 1) AS t FROM m GROUP BY 1),
 z AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM s),
 g AS (SELECT s.b, floor(1000 * ln((coalesce(s.t, 0) + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((coalesce(s.s, 0) + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT AS gain FROM s, z),
 k AS (SELECT m.r, sum(m.n)::BIGINT AS n, floor(sum(m.n * g.gain)::DOUBLE / sum(m.n))::BIGINT AS weight FROM m JOIN g ON g.b = m.b WHERE m.bench = 0 GROUP BY 1),
 q AS (SELECT w.doc_id, len(w.l) >= 20 AS fits, coalesce(k.n, 0)::BIGINT AS n_features, coalesce(k.weight, 0)::BIGINT AS weight, coalesce(k.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN k ON k.r = w.r WHERE w.bench = 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS place FROM q)
 SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= (SELECT count(*) FILTER (fits) * 25 // 100 FROM q) THEN place END AS rank FROM o"""
