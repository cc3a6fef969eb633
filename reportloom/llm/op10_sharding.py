"""Operator 10: contiguous byte-balanced shards from global prefix sums.

Rows are range-partitioned without their texts, in the order of a 64-bit hash of the text,
then doc_id, and written once; per-partition byte totals, one small row each, give every
partition its offset, and a running sum inside the partition does the rest. Shard s takes the
rows whose byte midpoint lies in [s, s + 1) / n of all bytes, in integers throughout.

Equal texts are neighbours in that order. A group of them of at most 1 / HOLD of a shard's
target goes by the midpoint of the whole group, so it is never split; a larger one goes row by
row, as one group may hold a third of all bytes. A shard is thus within 1 / HOLD of its target
plus one row. A group over several partitions is pieced together from two small rows a
partition (its first and last hash).

Law `bytes`: sizes near equal. Defined results: a null text has size 8 and the checksum of no
bytes (0) and counts as the empty text; repeated rows each get a slot of their own; a null
doc_id sorts first in its group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

HEAD_BYTES = 8
HOLD = 50


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """docs (doc_id, text, any others) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    order = ["h", "doc_id", "text_crc32", "uid"]
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + HEAD_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # the last key keeps rows of one id from meeting in one task; it is written, so stable
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kept = scratch.keep(ranged)
    totals = kept.groupBy("part").agg(F.sum("size").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")).orderBy("part").collect()  # one row a partition
    before, places = 0, []
    for t in totals:
        places.append((t.part, before, t.lo, t.hi))
        before += t.bytes
    offset = spark.createDataFrame(places, "part int, before long, lo long, hi long")
    # groups at the edges of partitions, in order: at most two rows a partition
    edge = kept.join(F.broadcast(offset), "part").filter("h = lo or h = hi").groupBy("part", "h").agg(F.sum("size").alias("bytes")).collect()
    whole: dict[int, int] = {}
    inside = {(e.part, e.h): e.bytes for e in edge}
    for e in edge:
        whole[e.h] = whole.get(e.h, 0) + e.bytes
    end = {t.part: t.bytes for t in totals}
    first: dict[int, int] = {}
    for part, start, lo, hi in places:  # where a group of an edge begins
        first.setdefault(lo, start)
        first.setdefault(hi, start + end[part] - inside[part, hi])
    edges = spark.createDataFrame([(h, first[h], n) for h, n in whole.items()], "h long, edge_start long, edge_bytes long")
    by_row = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("part", "h")
    placed = kept.withColumn("run", F.coalesce(F.sum("size").over(by_row), F.lit(0))).withColumn("bytes", F.sum("size").over(group)).withColumn("group_run", F.min("run").over(group))
    placed = placed.join(F.broadcast(offset.select("part", "before")), "part").join(F.broadcast(edges), "h", "left")
    placed = placed.select("*", F.coalesce("edge_bytes", "bytes").alias("whole"), F.coalesce("edge_start", F.col("before") + F.col("group_run")).alias("start"))
    held = F.col("whole") * shards * HOLD <= before
    if 2 * before * shards >= 1 << 63:
        raise ValueError("too many shards for 64-bit sums")
    middle = F.when(held, F.col("start") * 2 + F.col("whole")).otherwise((F.col("before") + F.col("run")) * 2 + F.col("size"))  # twice the midpoint
    placed = placed.withColumn("middle", middle)
    shard = F.least(F.expr(f"int(middle * {shards}L div {2 * max(before, 1)}L)"), F.lit(shards - 1))
    placed = scratch.keep(placed.select("doc_id", "size", "text_crc32", "h", "uid", "part", shard.alias("shard")))
    # slots: rank inside (part, shard) plus what earlier partitions put into the shard
    cells = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).orderBy("shard", "part").collect()  # at most partitions + shards
    seen, starts = {}, []
    for c in cells:
        starts.append((c.shard, c.part, seen.get(c.shard, 0)))
        seen[c.shard] = seen.get(c.shard, 0) + c.n
    start = spark.createDataFrame(starts, "shard int, part int, start long")
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order))
    return placed.withColumn("rank", rank).join(F.broadcast(start), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark, sf_dir):
    return shard_by_bytes(C.table(spark, sf_dir, "documents"))
