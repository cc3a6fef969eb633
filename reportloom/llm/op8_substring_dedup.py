"""Operator 8: exact removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash among its MMER-word
grams, frequent grams ordered last, so a common line never draws all its contexts into one
bucket. Consecutive windows of one minimiser are a super-k-mer.

1. Super-k-mers are counted by minimiser without their words; those whose minimiser is met
   once in the corpus hold no repeated window and go no further.
2. The others travel as one packed string each to their minimiser's bucket, equal strings of
   a task already counted together; sorting the bucket's windows counts them exactly. A bucket
   above BUCKET_BYTES is counted by window fingerprint over several pieces, so no task holds it.
3. Strings with repeated windows, as bit maps, are joined back to the super-k-mers' places,
   and each document drops the words that a repeated window covers.

Windows are judged on the input; every place of a repeated window is removed, the first one
included. Window identity is a 128-bit fingerprint of the 35 words, 64 bits from each of two
independent hashes of the words' bytes.

Defined results: null, empty and word-less texts have no words and the hash of no bytes;
shorter texts than a window lose nothing; white space never distinguishes windows; repeated
rows count as different places; a null doc_id is kept as it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
WINDOW, MMER = 35, 4
HEAVY_SHARE = 20_000
RUN = 64
COMBINE_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20


def mmers(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the grams of each text."""
    data, off = C.text_bytes(batch.column(batch.schema.get_field_index("text")))
    ws, we, row = C.words(data, off)
    g = C.gram_hashes(C.word_hashes(data, ws, we), MMER)
    return g[row[: len(g)] == row[MMER - 1 :]] if len(g) else g


def super_kmers(data, ws, we, row, heavy: np.ndarray, window: int):
    """First word, number of windows, minimiser and self-repeat flag of each super-k-mer."""
    n = len(ws) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(bool)
    g = C.gram_hashes(C.word_hashes(data, ws, we), MMER)
    v = C.mix(g ^ U64(0x94D049BB133111EB))
    v = np.where(C.among(heavy, g), v | U64(1 << 63), v >> U64(1))
    span, least, width = window - MMER + 1, v, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    least = least[:n]
    valid = row[:n] == row[window - 1 :]
    start = valid.copy()
    start[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
    first = np.flatnonzero(start)
    end = np.flatnonzero(valid & np.append(start[1:] | ~valid[1:], True)) + 1
    k = end - first
    if (k > RUN).any():  # a repeating text: cut its long run
        parts = -(-k // RUN)
        j = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, k = np.repeat(first, parts) + j * RUN, np.minimum(np.repeat(k, parts) - j * RUN, RUN)
    s = np.sort(v)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    return first, k, least[first], C.among(again, least[first])


def placed(heavy: np.ndarray, window: int):
    """(mz, doc_id, th, start, k, w): super-k-mers without words; start counts from the text's first word."""

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole, "text"):
                data, off = C.text_bytes(b.column(1))
                ws, we, row = C.words(data, off)
                s, k, mz, twice = super_kmers(data, ws, we, row, heavy, window)
                r = row[s]
                base = np.searchsorted(row, r)
                yield pa.RecordBatch.from_arrays(
                    [C.as_long(mz), b.column(0).take(pa.array(r)), b.column(2).take(pa.array(r)), pa.array((s - base).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(1 + twice.astype(np.int32))],
                    ["mz", "doc_id", "th", "start", "k", "w"],
                )

    return run


def joined_words(data, ws, we):
    """All words with one space after each, and where each begins (and the end)."""
    size = we - ws + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 32, np.uint8)
    pick = np.arange(at[-1] - len(ws)) + np.repeat(ws - (at[:-1] - np.arange(len(ws))), size - 1)
    mask = np.ones(at[-1], bool)
    mask[at[1:] - 1] = False
    out[mask] = data[pick]
    return out, at


def fingerprints(data, ws, we, row):
    """Two 64-bit fingerprints of each row's word sequence."""
    n = int(row[-1]) + 1 if len(row) else 0
    first = np.searchsorted(row, np.arange(n))
    out = []
    for lane in (0, 1):
        x = C.word_hashes(data, ws, we, lane)
        up, down = C.powers(len(x) + 1)
        p = np.concatenate([[U64(0)], np.cumsum(x * up[: len(x)])])
        last = np.append(first[1:], len(x))
        out.append(C.mix((p[last] - p[first]) * down[first] + (last - first).astype(U64)))
    return out


def strings_of(b: pa.RecordBatch):
    """Packed super-k-mers of the rows (doc_id, th, text, places): their row, start, k,
    minimiser, bytes, and 128-bit fingerprint."""
    data, off = C.text_bytes(b.column(2))
    ws, we, row = C.words(data, off)
    places = b.column(3)
    flat = places.flatten()
    s, k, mz = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(places.offsets)))
    return data, ws, we, row, owner, s.astype(np.int64), k.astype(np.int64), mz


def _packed(b, window):
    data, ws, we, row, owner, s, k, mz = strings_of(b)
    base = np.searchsorted(row, owner) + s
    text, at = joined_words(data, ws, we)
    a, z = at[base], at[base + k + window - 1] - 1
    fp = []
    for lane in (0, 1):
        x = C.word_hashes(data, ws, we, lane)
        up, down = C.powers(len(x) + 1)
        p = np.concatenate([[U64(0)], np.cumsum(x * up[: len(x)])])
        end = base + k + window - 1
        fp.append(C.mix((p[end] - p[base]) * down[base] + (end - base).astype(U64)))
    return text, a, z, owner, s, k, mz, fp


def packed_rows(window: int):
    """(mz, packed, n) with equal strings of about COMBINE_BYTES of text counted together."""

    def out(parts):
        mz = np.concatenate([p[0] for p in parts])
        f1, f2 = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        strings = pa.concat_arrays([p[1] for p in parts])
        order = np.lexsort((f2, f1))
        a, b = f1[order], f2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        pick = order[at]
        return pa.RecordBatch.from_arrays([pa.array(mz[pick]), strings.take(pa.array(pick)), pa.array(np.diff(np.append(at, len(a))))], ["mz", "packed", "n"])

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for b in C.chunks(whole, "text"):
                text, a, z, _, _, _, mz, fp = _packed(b, window)
                if len(mz):
                    held.append((mz, C.binary(text, a, z), *fp))
                    size += int((z - a).sum())
                if size > COMBINE_BYTES:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def string_places(window: int):
    """(f1, f2, doc_id, th, start): the places of packed strings, by fingerprint."""

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole, "text"):
                _, _, _, owner, s, _, _, fp = _packed(b, window)
                o = pa.array(owner)
                yield pa.RecordBatch.from_arrays([C.as_long(fp[0]), C.as_long(fp[1]), b.column(0).take(o), b.column(1).take(o), pa.array(s.astype(np.int32))], ["f1", "f2", "doc_id", "th", "start"])

    return run


def window_prints(data, ws, we, row, window: int):
    """Two fingerprints of each window inside a row, and its row."""
    n = max(len(ws) - window + 1, 0)
    inside = row[:n] == row[window - 1 :] if n else np.zeros(0, bool)
    out = []
    for lane in (0, 1):
        x = C.word_hashes(data, ws, we, lane)
        up, down = C.powers(len(x) + 1)
        p = np.concatenate([[U64(0)], np.cumsum(x * up[: len(x)])])
        out.append(((p[window:] - p[:n]) * down[:n])[inside] if n else np.zeros(0, U64))
    return *out, row[:n][inside]


COUNTED = "f1 long, f2 long, repeats binary, pos int, f long, g long, n long"


def counted(window: int):
    """Rows (mz, packed, n) sorted by mz -> (f1, f2, repeats): the strings with repeated windows, one
    byte a window (1: it is met more than once).

    Whole buckets are taken together, about BUCKET_BYTES of them at a time. A bucket that is larger
    alone is never held: its windows leave one by one (f1, f2, pos, f, g, n), to be added up by
    fingerprint across the pieces."""

    def prints(rows: list[pa.RecordBatch]):
        f, g, weight, owner, names, sizes, seen = [], [], [], [], [], [], 0
        for whole in rows:
            for b in C.chunks(whole, "packed"):
                data, off = C.text_bytes(b.column(1))
                ws, we, row = C.words(data, off)
                x, y, own = window_prints(data, ws, we, row, window)
                f.append(x)
                g.append(y)
                names.append(np.stack(fingerprints(data, ws, we, row), 1))
                owner.append(own + seen)
                weight.append(b.column(2).to_numpy()[own])
                sizes.append(np.bincount(own, minlength=b.num_rows))
                seen += b.num_rows
        return (*(np.concatenate(x) for x in (f, g, weight, owner, names, sizes)), seen)

    def empty(n, kind):
        return pa.nulls(n, kind)

    def whole_buckets(rows):
        f, g, weight, owner, names, size, seen = prints(rows)
        order = np.lexsort((g, f))
        a, b = f[order], g[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(weight[order], at) if len(at) else at
        twice = np.zeros(len(f), np.uint8)
        twice[order] = np.repeat(total > 1, np.diff(np.append(at, len(a))))
        end = np.cumsum(size)
        some = np.flatnonzero(np.bincount(owner, weights=twice, minlength=seen) > 0)
        # equal strings of several tasks give one row
        _, keep = np.unique(names[some], axis=0, return_index=True)
        some = some[keep]
        n = len(some)
        return pa.RecordBatch.from_arrays(
            [C.as_long(names[some, 0]), C.as_long(names[some, 1]), C.binary(twice, (end - size)[some], end[some]), empty(n, pa.int32()), empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.int64())],
            ["f1", "f2", "repeats", "pos", "f", "g", "n"],
        )

    def piece(rows):
        f, g, weight, owner, names, size, _ = prints(rows)
        end = np.cumsum(size)
        pos = np.arange(len(f)) - (end - size)[owner]
        n = len(f)
        return pa.RecordBatch.from_arrays([C.as_long(names[owner, 0]), C.as_long(names[owner, 1]), empty(n, pa.binary()), pa.array(pos.astype(np.int32)), C.as_long(f), C.as_long(g), pa.array(weight)], ["f1", "f2", "repeats", "pos", "f", "g", "n"])

    def run(batches):
        C.release_memory()
        held, size, hot = [], 0, None  # rows of whole buckets so far; the bucket that leaves in pieces
        for whole in batches:
            for b in C.chunks(whole, "packed"):
                mz = b.column(0).to_numpy()
                if hot is not None:
                    still = int(np.searchsorted(mz != hot, True)) if (mz != hot).any() else len(mz)
                    if still:
                        yield piece([b.slice(0, still)])
                    if still == len(mz):
                        continue
                    b, mz, hot = b.slice(still), mz[still:], None
                held.append(b)
                size += b.nbytes
                if size <= BUCKET_BYTES:
                    continue
                cut = np.flatnonzero(mz[1:] != mz[:-1])
                last = mz[-1]
                if len(cut):
                    at = int(cut[-1]) + 1
                    done, rest = [*held[:-1], b.slice(0, at)], [b.slice(at)]
                else:  # the last bucket may have begun in an earlier batch
                    k = len(held) - 1
                    while k > 0 and held[k - 1].column(0)[held[k - 1].num_rows - 1].as_py() == last and held[k - 1].column(0)[0].as_py() == last:
                        k -= 1
                    done, rest = held[:k], held[k:]
                    if k and (before := held[k - 1].column(0).to_numpy())[-1] == last:
                        at = int(np.flatnonzero(before != last)[-1]) + 1
                        done, rest = [*held[: k - 1], held[k - 1].slice(0, at)], [held[k - 1].slice(at), *rest]
                if done:
                    yield whole_buckets(done)
                held, size = rest, sum(x.nbytes for x in rest)
                if size > BUCKET_BYTES:
                    yield piece(held)
                    held, size, hot = [], 0, last
        if held:
            yield whole_buckets(held)

    return run


def bitmaps(window: int):
    """(f1, f2, repeats) from (f1, f2, places) of repeated windows."""

    def run(batches):
        for b in batches:
            out = []
            for places in b.column(2):
                at = np.asarray(places.values)
                flags = np.zeros(int(at.max()) + 1, np.uint8)
                flags[at] = 1
                out.append(flags.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["f1", "f2", "repeats"])

    return run


def trimmed(window: int, keep_text: bool):
    """Applies the windows found to the texts."""

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole, "text"):
                data, off = C.text_bytes(b.column(1))
                ws, we, row = C.words(data, off)
                n = b.num_rows
                first = np.searchsorted(row, np.arange(n + 1))
                step = np.zeros(len(ws) + window + 1, np.int64)
                spans = b.column(2)
                for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    for x in spans[i].as_py():
                        hit = first[i] + x["start"] + np.flatnonzero(np.frombuffer(x["repeats"], np.uint8))
                        np.add.at(step, hit, 1)
                        np.add.at(step, hit + window, -1)
                gone = np.cumsum(step)[: len(ws)] > 0
                kws, kwe, krow = ws[~gone], we[~gone], row[~gone]
                text, at = joined_words(data, kws, kwe)
                cut = at[np.searchsorted(krow, np.arange(n + 1))].tolist()
                raw = memoryview(text.tobytes())
                kept = [raw[a : max(a, z - 1)] for a, z in zip(cut, cut[1:], strict=False)]
                cols = [b.column(0), pa.array(np.diff(first)), pa.array(np.bincount(row, weights=gone, minlength=n).astype(np.int64))]
                names = ["doc_id", "n_words", "n_removed"]
                if keep_text:
                    cols, names = [*cols, pa.array([str(x, "utf-8") for x in kept], pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], [*names, "kept_sha256"])

    return run


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, any others) -> doc_id, n_words, n_removed, (text,) kept_sha256."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "substring")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("th", F.xxhash64("doc_id", "text"))
    heavy = C.heavy_tokens(docs, mmers, HEAVY_SHARE)
    kmers = keyed.select("doc_id", "text", "th").mapInArrow(placed(heavy, window), f"mz long, doc_id {kind}, th long, start int, k int, w int")
    often = kmers.groupBy("mz").agg(F.sum("w").alias("n")).filter("n > 1").select("mz")
    kept = scratch.keep(kmers.join(often, "mz").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "k", "mz")).alias("places")))
    same = keyed.th == F.col("kth")
    places = kept.select(F.col("doc_id").alias("kid"), F.col("th").alias("kth"), "places")
    found = keyed.join(places, same & keyed.doc_id.eqNullSafe(F.col("kid"))).select("doc_id", "th", "text", "places")
    strings = found.mapInArrow(packed_rows(window), "mz long, packed binary, n long").repartition("mz")
    found_windows = scratch.keep(strings.sortWithinPartitions("mz").mapInArrow(counted(window), COUNTED))
    pieces = found_windows.filter("pos is not null")
    often = pieces.groupBy("f", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("f", "g")
    hot = pieces.join(often, ["f", "g"]).groupBy("f1", "f2").agg(F.collect_set("pos").alias("places")).mapInArrow(bitmaps(window), "f1 long, f2 long, repeats binary")
    repeats = found_windows.filter("pos is null").select("f1", "f2", "repeats").union(hot)
    back = found.mapInArrow(string_places(window), f"f1 long, f2 long, doc_id {kind}, th long, start int").join(repeats, ["f1", "f2"])
    spans = scratch.keep(back.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "repeats")).alias("spans"))).select(F.col("doc_id").alias("kid"), F.col("th").alias("kth"), "spans")
    final = keyed.join(spans, same & keyed.doc_id.eqNullSafe(F.col("kid")), "left").select("doc_id", "text", "spans")
    return final.mapInArrow(trimmed(window, keep_text), f"doc_id {kind}, n_words long, n_removed long, {'text string, ' * keep_text}kept_sha256 string")


def query(spark, sf_dir):
    return drop_repeated_windows(C.table(spark, sf_dir, "documents"))
