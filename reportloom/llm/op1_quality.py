"""Operator 1: quality classifier by non-negative positive-unlabelled learning.

Trusted positives are the rows labelled 1, unlabelled rows are web text of unknown quality;
the class prior is estimated as the share of 1 among the labelled training rows. A small
network minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) (sigmoid loss; when the
second term is negative the step follows its own gradient instead, as in Kiryo et al. 2017).
Only rows whose crc32(doc_id as text) mod 5 is not 0 give labels or training texts.

Inputs of a score are whole-text shape statistics: byte classes, word lengths, repetition.
Training uses at most SAMPLE_ROWS labelled positives, those of least xxhash64(doc_id), one
text each. The unlabelled text is every document outside the held-out fold: PLANES random
hyperplanes cut feature space into cells, and each cell counts its documents and their mean,
so what training sees is bounded and yet covers all rows. Scoring covers every row.

Defined results: null and empty texts are scored as a text without bytes; repeated doc_ids
give repeated rows; a null doc_id is scored and not held out; without any positive label in
the training folds every score is 0.5; labels of unknown documents are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_ROWS = 20_000
PLANES = 12
STEPS = 1600
THRESHOLD = 0.3
SYMBOLS = b"#$%&*|!?.,:;@<>{}[]()=_/\\\"'-"


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[65:91] = 1
    kind[97:123] = 2
    kind[48:58] = 3
    kind[[9, 11, 12, 13, 32]] = 4
    kind[10] = 5
    for i, b in enumerate(SYMBOLS):
        kind[b] = 6 + i
    kind[128:] = 6 + len(SYMBOLS)
    return kind


KIND = _classes()
N_KINDS = 7 + len(SYMBOLS)
N_FEATURES = N_KINDS + 12


def features(batch: pa.RecordBatch, col: str = "text") -> np.ndarray:
    """One row of shape statistics for each text."""
    data, off = C.text_bytes(batch.column(batch.schema.get_field_index(col)))
    n = batch.num_rows
    out = np.zeros((n, N_FEATURES), np.float64)
    size = np.diff(off)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    kinds = np.bincount(row * N_KINDS + KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    out[:, :N_KINDS] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
    ws, we, wr = C.words(data, off)
    h = C.word_hashes(data, ws, we)
    count = np.bincount(wr, minlength=n)
    safe = np.maximum(count, 1)
    length = (we - ws).astype(np.float64)
    mean = np.bincount(wr, weights=length, minlength=n) / safe
    k = N_KINDS
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = mean
    out[:, k + 3] = np.sqrt(np.maximum(np.bincount(wr, weights=length**2, minlength=n) / safe - mean**2, 0))
    for i, gap in enumerate((1, 2, 3, 4)):
        if len(h) > gap:
            same = (h[gap:] == h[:-gap]) & (wr[gap:] == wr[:-gap])
            out[:, k + 4 + i] = np.bincount(wr[gap:][same], minlength=n) / safe
    order = np.lexsort((h, wr))
    hs, rs = h[order], wr[order]
    if len(hs):
        first = np.ones(len(hs), bool)
        first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
        at = np.flatnonzero(first)
        run = np.diff(np.append(at, len(hs)))
        out[:, k + 8] = np.bincount(rs[at], minlength=n) / safe
        most = np.zeros(n)
        np.maximum.at(most, rs[at], run)
        out[:, k + 9] = most / safe
        out[:, k + 10] = np.bincount(rs[at], weights=(run == 1), minlength=n) / safe
        p = run / safe[rs[at]]
        out[:, k + 11] = np.bincount(rs[at], weights=-p * np.log(p), minlength=n) / np.log(safe + 1)
    return out


def featured(batches):
    """(kind, features) of training rows."""
    for whole in batches:
        for b in C.chunks(whole, "text"):
            x = features(b).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("positive")), flat], ["positive", "x"])


def expit(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Standardised inputs, one tanh layer, one output."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.parts = mean, scale, w1, b1, w2, b2

    def raw(self, x):
        mean, scale, w1, b1, w2, b2 = self.parts
        return np.tanh(np.clip((x - mean) / scale, -6, 6) @ w1 + b1) @ w2 + b2

    def score(self, x):
        return expit(self.raw(x))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, weight: np.ndarray | None = None, hidden: int = 24, seed: int = 7, steps: int = STEPS) -> Model:
    """Minimise the non-negative unbiased risk with Adam; weight: documents of each row of unl."""
    rng = np.random.default_rng(seed)
    weight = np.ones(len(unl)) if weight is None else weight
    share = np.cumsum(weight) / weight.sum()
    both, w = np.concatenate([pos, unl]), np.concatenate([np.full(len(pos), weight.sum() / len(pos)), weight])
    mean = np.average(both, 0, w)
    scale = np.sqrt(np.average((both - mean) ** 2, 0, w)) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -6, 6)
    pos, unl = norm(pos), norm(unl)
    theta = [rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        p, u = pos[rng.integers(0, len(pos), 512)], unl[np.minimum(np.searchsorted(share, rng.random(512)), len(unl) - 1)]
        x = np.concatenate([p, u])
        h = np.tanh(x @ theta[0] + theta[1])
        s = expit(h @ theta[2] + theta[3])
        ds = s * (1 - s)
        is_p = np.arange(len(x)) < len(p)
        # sigmoid loss: l(z, +1) = 1 - s, l(z, -1) = s
        negative = s[~is_p].mean() - prior * s[is_p].mean()
        g = np.zeros(len(x))
        if negative >= 0:
            g[is_p] = -prior / len(p) - prior / len(p)
            g[~is_p] = 1 / len(u)
        else:  # undo the overfitting of the negative part
            g[is_p] = prior / len(p)
            g[~is_p] = -1 / len(u)
        g *= ds
        back = np.outer(g, theta[2]) * (1 - h**2)
        grads = [x.T @ back + 1e-4 * theta[0], back.sum(0), h.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
        rate = 0.02 * (1 - step / (steps + 1))
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr**2
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *theta)


def held_out(col="doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def celled(mean: np.ndarray, scale: np.ndarray):
    """(cell, n, x): how many documents of a task fall into each cell of feature space, and
    their summed features; at most 2**PLANES rows a task."""
    planes = np.random.default_rng(5).normal(size=(N_FEATURES, PLANES))

    def run(batches):
        C.release_memory()
        count, total = np.zeros(1 << PLANES), np.zeros((1 << PLANES, N_FEATURES))
        for whole in batches:
            for b in C.chunks(whole, "text"):
                x = features(b)
                cell = ((np.clip((x - mean) / scale, -6, 6) @ planes > 0) * (1 << np.arange(PLANES))).sum(1)
                np.add.at(count, cell, 1)
                np.add.at(total, cell, x)
        yield cells_of(np.flatnonzero(count), count, total)

    return run


def cells_of(at, count, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.float64()), pa.array([x.tobytes() for x in total[at]], pa.binary())], ["cell", "n", "x"])


def merged_cells(batches):
    """The cells of several tasks added up."""
    count, total = np.zeros(1 << PLANES), np.zeros((1 << PLANES, N_FEATURES))
    for b in batches:
        cell = np.asarray(b.column(0))
        np.add.at(count, cell, np.asarray(b.column(1)))
        np.add.at(total, cell, np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(-1, N_FEATURES))
    yield cells_of(np.flatnonzero(count), count, total)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from docs (doc_id, text) and labels (doc_id, quality); None without positives."""
    known = labels.filter(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = known.agg(F.avg("quality")).first()[0]
    if not prior:
        return None
    prior = min(max(prior, 0.01), 0.99)
    # texts are fetched for the chosen positives alone, each text of a doc_id once
    chosen = known.filter("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # of repeated ids one text
    got = texts.select(F.lit(True).alias("positive"), "text").mapInArrow(featured, "positive boolean, x array<float>").toArrow()
    if not got.num_rows:
        return None
    pos = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES).astype(np.float64)
    pos = pos[np.lexsort(pos.T)]  # the same order whatever the partitioning
    # all documents outside the held-out fold, unmarked, stand for web text
    web = docs.filter(~held_out()).select("text").mapInArrow(celled(pos.mean(0), pos.std(0) + 1e-3), "cell int, n double, x binary")
    cells = web.repartition("cell").mapInArrow(merged_cells, "cell int, n double, x binary").orderBy("cell").collect()  # at most 2**PLANES rows
    weight = np.array([r.n for r in cells])
    unl = np.stack([np.frombuffer(r.x, np.float64) for r in cells]) / weight[:, None]
    return train(pos, unl, prior, weight)


def scored(model: Model | None):
    def run(batches):
        C.release_memory()
        for whole in batches:
            for b in C.chunks(whole, "text"):
                s = model.score(features(b)) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    cols = docs.select("doc_id", "text")
    kind = cols.schema["doc_id"].dataType.simpleString()
    out = cols.mapInArrow(scored(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""

    def run(batches):
        C.release_memory()
        for whole in batches:
            for b in C.chunks(whole, "text"):
                s = model.score(features(b)) if model else np.full(b.num_rows, 0.5)
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, C.table(spark, sf_dir, "labels")))
