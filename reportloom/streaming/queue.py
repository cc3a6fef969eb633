"""A bounded batch queue as a stateful stream (Q1).

events (queue, batch_id, job_id, kind, ts): SUBMIT puts a job at the end of its queue; of a queue's
jobs at most `at_once` run at a time, in the order they came; DONE ends a running job; ERROR, or a
lease that runs out, sends it to the end of the queue again, after `retries` more attempts it has
FAILED for good and the others go on. A batch takes at most `most` jobs (more are REJECTED); a
queue keeps `retained` batches, and a new one makes room by forgetting the oldest complete ones.

State is kept by queue (transformWithState) in RocksDB: the waiting jobs by place, the running ones,
each batch's jobs, the complete batches by place. A micro-batch works on what it touches in memory and
writes it back once at its end, as every access to the store is a round trip; what came and went within
a micro-batch never reaches it. A queue has one timer, for the lease that ends first. Queues are
independent; a large tenant takes several.

Everything follows event time: before an event at t the leases that end at t or earlier end, and a
timer ends those of queues without further events, once the watermark has passed. So the transitions
do not depend on how events fall into micro-batches, and a restart goes on where the checkpoint is.

Defined results: events of one queue are taken by (ts, kind: DONE, ERROR, SUBMIT, batch_id, job_id),
times in milliseconds; DONE and ERROR without a job are about the job that has run longest; an event
for a job that is not running, a second SUBMIT of a known job, a SUBMIT without a job and a row
without queue, known kind or time are ignored; a null batch is the batch ''; an empty stream gives no
transition.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITION = "queue long, number long, batch_id string, job_id string, state string, attempt int, ts timestamp"
ORDER = {"DONE": 0, "ERROR": 1, "SUBMIT": 2}
#: Transitions that are handed on at once.
FRAME = 50_000


class JobQueue(StatefulProcessor):
    def __init__(self, at_once: int = 3, most: int = 100, retained: int = 50, retries: int = 1, lease_ms: int = 30_000):
        self.at_once, self.most, self.retained, self.retries, self.lease = at_once, most, retained, retries, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "head long, tail long, number long, batches long")
        self.waiting = handle.getMapState("waiting", "place long", "batch string, job string, attempt int")
        self.running = handle.getMapState("running", "batch string, job string", "attempt int, since long")
        self.batches = handle.getMapState("batches", "batch string", "place long, jobs array<string>, open int")
        self.complete = handle.getMapState("complete", "place long", "batch string")

    def start(self, key) -> None:
        self.key, self.out = key[0], []
        head = self.cursor.get() if self.cursor.exists() else None
        self.head, self.tail, self.number, self.n_batches = map(int, head) if head else (0, 0, 0, 0)
        self.line = {}  # jobs that have come since: place -> (batch, job, attempt)
        self.held_active = {tuple(k): tuple(v) for k, v in self.running.iterator()} if head else {}  # at most at_once
        self.active = dict(self.held_active)
        self.any_held = self.n_batches > 0
        self.known: dict[str, list] = {}  # batches touched since: [place, jobs, open]
        self.held: set[str] = set()  # those of them that the store has
        self.gone: set[str] = set()  # those that the store has and that are forgotten
        self.held_complete = {int(k[0]): v[0] for k, v in self.complete.iterator()} if self.any_held else {}
        self.done = dict(self.held_complete)
        self.oldest = sorted(self.done)  # a heap of their places; those reopened since are passed over

    def frame(self) -> pd.DataFrame:
        frame = pd.DataFrame(self.out, columns=["number", "batch_id", "job_id", "state", "attempt", "ts"])
        frame.insert(0, "queue", self.key)
        frame["ts"] = pd.to_datetime(frame["ts"], unit="ms")
        self.out = []
        return frame

    def end(self) -> Iterator[pd.DataFrame]:
        """What has changed goes to the store."""
        self.cursor.update((self.head, self.tail, self.number, self.n_batches))
        for place, job in self.line.items():
            self.waiting.updateValue((place,), job)
        for job in self.held_active.keys() - self.active.keys():
            self.running.removeKey(job)
        for job, at in self.active.items():
            if self.held_active.get(job) != at:
                self.running.updateValue(job, at)
        for batch in self.gone:
            self.batches.removeKey((batch,))
        for batch, (place, names, left) in self.known.items():
            self.batches.updateValue((batch,), (place, list(names), left))
        for place in self.held_complete.keys() - self.done.keys():
            self.complete.removeKey((place,))
        for place in self.done.keys() - self.held_complete.keys():
            self.complete.updateValue((place,), (self.done[place],))
        if self.active:
            self.handle.registerTimer(min(since for _, since in self.active.values()) + self.lease)
        if self.out:
            yield self.frame()

    def batch_of(self, name: str) -> list | None:
        """A known batch, from the store at first; its jobs in order."""
        if name not in self.known and self.any_held and name not in self.gone and self.batches.containsKey((name,)):
            place, names, left = self.batches.getValue((name,))
            self.known[name] = [int(place), dict.fromkeys(names), int(left)]
            self.held.add(name)
        return self.known.get(name)

    def say(self, batch: str, job: str, state: str, attempt: int, at: int) -> None:
        self.out.append((self.number, batch, job, state, attempt, at))
        self.number += 1

    def wait(self, batch: str, job: str, attempt: int, at: int) -> None:
        self.line[self.tail] = (batch, job, attempt)
        self.tail += 1
        self.say(batch, job, "PENDING", attempt, at)

    def admit(self, at: int) -> None:
        while len(self.active) < self.at_once and self.head < self.tail:
            first = self.line.pop(self.head, None)
            if first is None:
                first = self.waiting.getValue((self.head,))
                self.waiting.removeKey((self.head,))
            batch, job, attempt = first
            self.head += 1
            self.active[batch, job] = (attempt, at)
            self.say(batch, job, "PARSING", attempt, at)

    def leave(self, batch: str, job: str, failed: bool, at: int) -> None:
        """A running job ends, or goes back to the end of the queue."""
        attempt, _ = self.active.pop((batch, job))
        if failed and attempt <= self.retries:
            self.wait(batch, job, attempt + 1, at)
        else:
            self.say(batch, job, "FAILED" if failed else "COMPLETED", attempt, at)
            known = self.batch_of(batch)
            known[2] -= 1
            if not known[2]:
                self.done[known[0]] = batch
                heapq.heappush(self.oldest, known[0])
        self.admit(at)

    def expire(self, until: int) -> None:
        """Leases that end up to a time end, the earliest first."""
        while self.active:
            (batch, job), (_, since) = min(self.active.items(), key=lambda x: (x[1][1], x[0]))
            if since + self.lease > until:
                return
            self.leave(batch, job, True, since + self.lease)

    def make_room(self) -> None:
        """The oldest complete batches are forgotten until fewer than `retained` are left."""
        while self.n_batches >= self.retained and self.oldest:
            batch = self.done.pop(heapq.heappop(self.oldest), None)
            if batch is None:
                continue
            if self.known.pop(batch, None) is None or batch in self.held:
                self.gone.add(batch)
            self.n_batches -= 1

    def submit(self, batch: str, job: str, at: int) -> None:
        known = self.batch_of(batch)
        if known is not None and job in known[1]:
            return
        if known is None:
            self.make_room()
            self.n_batches += 1
            known = [self.tail, {}, 0]
        if len(known[1]) >= self.most:
            self.say(batch, job, "REJECTED", 0, at)
            return
        if not known[2]:
            self.done.pop(known[0], None)
        self.known[batch] = known
        known[1][job] = None
        known[2] += 1
        self.wait(batch, job, 1, at)
        self.admit(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.start(key)
        parts = []
        for part in rows:
            rank = part["kind"].map(ORDER)
            part = pd.DataFrame({"ms": part["ts"].astype("datetime64[ms]").astype("int64"), "rank": rank, "batch_id": part["batch_id"], "job_id": part["job_id"]})
            parts.append(part[rank.notna()].astype({"rank": "int8"}))
        events = pd.concat(parts, ignore_index=True).sort_values(["ms", "rank", "batch_id", "job_id"])
        for at, kind, batch, job in zip(events["ms"].tolist(), events["rank"].tolist(), events["batch_id"], events["job_id"], strict=True):
            self.expire(at)
            if kind == ORDER["SUBMIT"]:
                if job is not None:
                    self.submit(batch, job, at)
            else:
                if job is None and self.active:
                    (batch, job), _ = min(self.active.items(), key=lambda x: (x[1][1], x[0]))
                if (batch, job) in self.active:
                    self.leave(batch, job, kind == ORDER["ERROR"], at)
            if len(self.out) >= FRAME:
                yield self.frame()
        yield from self.end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All leases that end before the watermark end, those given meanwhile too."""
        self.start(key)
        self.expire(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1))
        yield from self.end()


def queue_transitions(events: DataFrame, delay: str = "0 seconds", **limits: int) -> DataFrame:
    """The transitions of jobs, as a stream: queue, number (in order within a queue), batch_id, job_id,
    state, attempt, ts."""
    rows = events.select(F.col("queue").cast("long").alias("queue"), F.coalesce(F.col("batch_id").cast("string"), F.lit("")).alias("batch_id"), F.col("job_id").cast("string").alias("job_id"), F.upper("kind").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.filter("queue is not null and ts is not null").withWatermark("ts", delay)
    return rows.groupBy("queue").transformWithStateInPandas(JobQueue(**limits), TRANSITION, "Append", "EventTime")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own, as its state store is RocksDB's; the caller's settings stay."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def run_queue(events: DataFrame, out: str, checkpoint: str, **limits: int) -> None:
    """Read what has come in since the checkpoint, and append its transitions to Parquet files; each
    micro-batch is committed once."""
    stream = queue_transitions(events, **limits).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def queue_states(transitions: DataFrame) -> DataFrame:
    """Where each job stands: queue, batch_id, job_id, state, attempt, ts."""
    last = F.max_by(F.struct("state", "attempt", "ts"), "number").alias("x")
    return transitions.groupBy("queue", "batch_id", "job_id").agg(last).select("queue", "batch_id", "job_id", "x.*")
