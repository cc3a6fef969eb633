"""Helpers shared by the training-data operators: scratch tables on shared storage,
vectorised word hashing over Arrow text columns, and connected components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch space


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary
    one is set only where the session names none and runs on this machine alone (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.made += 1
        path = f"{self.root}/t{self.made}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        del df
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing will read again, and let Spark forget old shuffles."""
        jvm = self.spark._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


#: What a worker holds from task to task and can do without, by its holder: how it is forgotten.
HELD: dict[str, Callable[[], None]] = {}


def release_memory(own: str = "") -> None:
    """Give memory of a reused worker's earlier tasks back to the system: what they freed, and what they
    held for more tasks of other operators than this task's own."""
    for holder, forget in HELD.items():
        if holder != own:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


# ------------------------------------------------------------- vectorised words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64; the table grows as needed."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.string()).cast(pa.binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and len(col) else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, col: str, most: int = CHUNK_BYTES):
    """Slices of a batch with about so many bytes of text each; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_bytes(batch.column(batch.schema.get_field_index(col)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, that of all Unicode included: C2 85, C2 A0, E1 9A 80,
    E2 80 80-8A, E2 80 A8, A9 and AF, E2 81 9F, E3 80 80."""
    m = SPACE[data]
    n = len(data)
    at = np.flatnonzero(data[: n - 1] == 0xC2)
    at = at[np.isin(data[at + 1], (0x85, 0xA0))]
    m[at] = m[at + 1] = True
    at = np.flatnonzero((data[: max(n - 2, 0)] >= 0xE1) & (data[: max(n - 2, 0)] <= 0xE3))
    a, b, c = data[at], data[at + 1], data[at + 2]
    end = np.isin(c, (0xA8, 0xA9, 0xAF)) | (c <= 0x8A)
    at = at[((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & end) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
    m[at] = m[at + 1] = m[at + 2] = True
    return m


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (a run without the six ASCII white spaces)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.searchsorted(off, ws, side="right") - 1


SEEDS = [U64(0x243F6A8885A308D3), U64(0xA4093822299F31D0)]  # fixed values: digits of pi
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
LONG_WORD = 256


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the two lanes are independent of each other.

    Eight bytes a step, each mixed before it is folded in, so no sum over powers of a base
    is taken that words could be built to satisfy. Long words go through BLAKE2."""
    size = we - ws
    seed = SEEDS[lane]
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(data) + 1,), "<u8", buffer=pad, strides=(1,))  # eight bytes from each place
    h = mix(size.astype(U64) ^ seed)
    on = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left, done = ws[on], size[on], 0
    while len(on):
        x = loads[at + done] & LOW_BYTES[np.minimum(left, 8)]
        h[on] = (h[on] ^ mix(x + seed)) * BASE + seed
        h[on] ^= h[on] >> U64(32)
        done, left = done + 8, left - 8
        more = left > 0
        on, at, left = on[more], at[more], left[more]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[ws[i] : we[i]].tobytes(), digest_size=8, salt=int(seed).to_bytes(8, "little")).digest(), "little")
    return mix(h)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, across rows too (callers mask those)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for i in range(n):
        out = (out + h[i : len(h) - n + 1 + i]) * BASE
        out ^= out >> U64(29)
    return mix(out)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64, copy=False).view(np.int64), pa.int64())


def binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each slice of data; slices may overlap."""
    size = ends - starts
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    if len(size) and (starts[1:] == ends[:-1]).all():  # one after the other
        held = np.ascontiguousarray(data[starts[0] : ends[-1]])
    else:
        held = data[np.arange(off[-1]) + np.repeat(starts - off[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(held)])


def packed(col: pa.Array) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col


# --------------------------------------------------------- connected components


LOCAL_EDGES = 1_000_000


def forest(batches):
    """A spanning forest of a task's edges, each node tied to the smallest of its tree.
    Edges are taken in blocks, so memory is bounded."""

    def reduced(held):
        a, b = (np.concatenate([np.asarray(x[i]) for x in held]) for i in (0, 1))
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = where[: len(a)], where[len(a) :]
        low = np.arange(len(ids))
        while True:  # hook to the smaller label, then jump
            x, y = low[u], low[v]
            open_ = x != y
            if not open_.any():
                break
            u, v, x, y = u[open_], v[open_], x[open_], y[open_]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while True:
                jump = low[low]
                if np.array_equal(jump, low):
                    break
                low = jump
        tied = np.flatnonzero(low != np.arange(len(ids)))
        return ids[tied], ids[low[tied]]

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        rows += batch.num_rows
        if rows > LOCAL_EDGES:
            held = [reduced(held)]
            rows = len(held[0][0])
            if rows > LOCAL_EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, rows = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced(held)], ["a", "b"])


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of edges (a, b).

    Each task first reduces its edges to a spanning forest (blocks of bounded size), then
    alternating large-star and small-star steps, each an aggregation and a join over the
    edge table, run until nothing changes; every round is written to shared storage.
    Nothing reaches the driver but the edge count and 128 bits over the edge set."""
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(forest, "a long, b long").distinct())
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    mark = state(now)
    while mark[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, both.a == least.k).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(down, large.a == down.k).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("k", "m")).filter("a <> b").distinct()
        after = scratch.keep(small)
        seen, mark = mark, state(after)
        scratch.drop(now)
        now = after
        if mark == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ------------------------------------------------------------- frequent tokens

COUNT_ROWS = 2_000_000


def local_heavy(tokens_of, share: int):
    """mapInArrow function: tokens that make up 1 / share of a task's tokens, with counts.

    A token that makes up 1 / share of all tokens does so in some task, so none is missed;
    a task holds at most COUNT_ROWS new tokens and 4 * share counted ones at a time."""

    def run(batches):
        total, keys, counts, waiting, held = 0, np.zeros(0, U64), np.zeros(0, np.int64), [], 0

        def merge():
            k = np.concatenate([keys, *waiting])
            c = np.concatenate([counts, np.ones(held, np.int64)])
            k, back = np.unique(k, return_inverse=True)
            c = np.bincount(back, weights=c, minlength=len(k)).astype(np.int64)
            keep = c > total // (4 * share)
            return k[keep], c[keep]

        for whole in batches:
            for b in chunks(whole, "text"):
                g = tokens_of(b)
                total += len(g)
                waiting.append(g)
                held += len(g)
                if held > COUNT_ROWS:
                    keys, counts = merge()
                    waiting, held = [], 0
        if total:
            keys, counts = merge()
            keep = counts >= max(4, total // share)
            yield pa.RecordBatch.from_arrays([as_long(keys[keep]), pa.array(counts[keep], pa.int64()), pa.array(np.full(int(keep.sum()), 0), pa.int64())], ["token", "n", "all"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["token", "n", "all"])

    return run


def heavy_tokens(docs: DataFrame, tokens_of, share: int, least: int = 64) -> np.ndarray:
    """Sorted hashes of the tokens that make up 1 / share of all: at most `share` of them, so
    the list is bounded. Results never depend on it; it only shapes the load."""
    found = docs.select("text").mapInArrow(local_heavy(tokens_of, share), "token long, n long, all long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    found.persist()
    total = (found.filter("token is null").first() or [0, 0, 0])[2] or 0
    got = found.filter("token is not null").filter(F.col("n") >= max(least, total // share)).select("token").collect()
    found.unpersist()
    return np.sort(np.array([r[0] for r in got], np.int64).view(U64))


def among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x
