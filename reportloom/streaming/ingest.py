"""Incremental ingest: a stream of reports into the warehouse, and job states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import warehouse as W

STATES = ["PENDING", "PARSING", "EXTRACTING", "RANKING", "COMPLETED", "FAILED"]


def landing(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A landing folder as a stream."""
    return spark.readStream.format(kind).schema(schema).load(path)


def dedup_stream(rows: DataFrame, content: str, time: str, delay: str = "1 day") -> DataFrame:
    """First row of each content hash within the watermark (J4); state is bounded by delay."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withColumn("content_hash", S.content_hash(F.col(content))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(stream: DataFrame, warehouse: str, checkpoint: str, raw_text: str = "raw_text") -> StreamingQuery:
    """Every micro-batch is stored once under its checkpoint's name and number: known hashes are
    dropped against the warehouse, and a batch that is replayed after a failure is either finished
    or skipped (W1, W2)."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, number: int) -> None:
        W.save_reports(batch.sparkSession, batch.withColumn("ord", F.monotonically_increasing_id()), raw_text, warehouse, f"{name}-{number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame) -> DataFrame:
    """events (batch_id, job_id, state, ts) -> the furthest state of each job: a job never goes
    back, and a failure is final (Q1)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    return events.groupBy("batch_id", "job_id").agg(F.max_by("state", F.struct(rank, "ts")).alias("state"), F.max("ts").alias("updated_at"))


def daily_counts(events: DataFrame, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by day and kind with a watermark, for complete or append output."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, "1 day")
    return t.groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


JOBS = "batch_id string, job_id string, state string, ts timestamp"


def save_states(events: DataFrame, path: str) -> None:
    """Append job events (batch_id, job_id, state, ts) to the state table (W7). Appending commits
    atomically, so a state is never half written."""
    events.select("batch_id", "job_id", "state", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").json(path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """The furthest state of each stored job; rows without a batch are skipped, and a table that was
    never written is empty (R15)."""
    if not W.exists(spark, path):
        return job_states(spark.createDataFrame([], JOBS))
    return job_states(spark.read.schema(JOBS).json(path).filter("batch_id is not null"))


def retained(batches: DataFrame, most: int = 50) -> DataFrame:
    """batches (batch_id, ord, is_complete) less the oldest complete ones, so that fewer than `most`
    are left where the incomplete ones allow it (U6): what must make room for a new batch. The
    number of batches is small (at most some thousand states), the window is over complete ones."""
    n = batches.agg(F.count("*").alias("all"))
    rank = F.row_number().over(Window.partitionBy("is_complete").orderBy("ord"))
    marked = batches.withColumn("rank", rank).join(F.broadcast(n))  # one row
    return marked.filter(~(F.col("is_complete") & (F.col("rank") <= F.col("all") - most + 1))).drop("rank", "all")


def run_batch(files: DataFrame, parse, schema: str, most: int = 100, at_once: int = 3) -> DataFrame:
    """Jobs (path, content) through a parser with each failure kept in its own row (Q1). The
    size guard is on the number of jobs of a batch; at most `at_once` jobs run at a time."""
    files = files.repartition(at_once, "path")
    if files.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} jobs")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((path, "COMPLETED", parse(bytes(content)), None))
                except Exception as e:  # noqa: BLE001  one corrupt file must not fail the others
                    rows.append((path, "FAILED", None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "status", "result", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, status string, result {schema}, error string")
