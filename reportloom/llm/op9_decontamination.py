"""Operator 9: benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased UTF-8 bytes with one space for each run of ASCII
characters other than letters and digits. An item of n bytes may differ by k = n // ERROR_DIVISOR edits; it is cut into
k + 1 pieces, so any occurrence within k edits holds one piece unchanged. All pieces form one
Aho-Corasick automaton; each piece hit places the item in the text, and the hits' windows are
verified with Myers' bit-parallel distance (Python integers as bit vectors, so an item of any length is one vector). An item is reported once a document with its least distance.

The benchmark goes to every task; its size is checked against BENCHMARK_BYTES first, and a
larger one is processed in slices of that size.

Defined results: null and empty texts match nothing; items without a letter or digit, or of
fewer than LEAST_CHARS bytes after normalisation, are matched exactly as whole words;
empty or null items match nothing; repeated items are reported by each item_id; repeated
doc_ids give repeated rows; an empty benchmark or an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ERROR_DIVISOR = 20
LEAST_CHARS = ERROR_DIVISOR  # from here on an item may differ by an edit
BENCHMARK_BYTES = 8 << 20
_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[97:123] = _KEEP[128:] = True


def normals(col: pa.Array) -> list[str]:
    """Lower case, runs of other ASCII characters than letters and digits as one space; one
    character of the result stands for one UTF-8 byte."""
    data, off = C.text_bytes(pc.utf8_lower(col.cast(pa.string())))
    keep = _KEEP[data]
    show = keep.copy()
    show[1:] |= keep[:-1]  # the first byte of a gap stays, as the space
    out = np.where(keep, data, np.uint8(32))[show].tobytes().decode("latin-1")
    at = np.concatenate([[0], np.cumsum(show)])[off].tolist()
    return [out[a:z].strip() for a, z in zip(at, at[1:], strict=False)]


def normal(text: str | None) -> str:
    return normals(pa.array([text], pa.string()))[0]


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of near equal length, with their places."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(masks: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of n bytes to any substring of text, and the
    end of the first such substring."""
    if not n:
        return 0, 0
    pv, mv, score, top = (1 << n) - 1, 0, n, 1 << (n - 1)
    full = (1 << n) - 1
    best, at = n, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, i
    return best, at


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            t = normal(text)
            if not t:
                continue
            short = len(t) < LEAST_CHARS
            errors = 0 if short else len(t) // ERROR_DIVISOR
            i = len(self.items)
            self.items.append((key, t, errors, masks_of(t), short))
            for a, piece in [(1, f" {t} ")] if short else pieces(t, errors):
                places.setdefault(piece, []).append((i, a - 2 * short if short else a))
        self.auto = ahocorasick.Automaton()
        for piece, at in places.items():
            self.auto.add_word(piece, (len(piece), at))
        if places:
            self.auto.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, errors allowed) of the items that occur in text."""
        return self.find_normal(normal(text))

    def find_normal(self, t: str) -> list[tuple[int, int, int]]:
        if self.empty or not t:
            return []
        padded = f" {t} "
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, at) in self.auto.iter(padded):
            start = end - size  # in t, of the piece's first character
            for i, place in at:
                windows.setdefault(i, []).append((start - place, start - place))
        found = []
        for i, spans in windows.items():
            key, item, errors, masks, short = self.items[i]
            if short:
                found.append((key, 0, 0))
                continue
            best = errors + 1
            low = high = None
            # hits whose windows touch are verified in one sweep
            for s, _ in [*sorted(set(spans)), (None, None)]:
                if s is not None and low is not None and s - errors <= high:
                    high = max(high, s + len(item) + errors)
                    continue
                if low is not None:
                    best = min(best, myers(masks, len(item), t[max(low, 0) : max(high, 0)])[0])
                    if not best:
                        break
                if s is not None:
                    low, high = s - errors, s + len(item) + errors
            if best <= errors:
                found.append((key, best, errors))
        return found


def matched(items: list[tuple[int, str]]):
    def run(batches):
        matcher = Matcher(items)
        for whole in batches:
            for b in C.chunks(whole, "text"):
                ids = b.column(0)
                rows, out = [], []
                for i, t in enumerate(normals(b.column(1))):
                    got = matcher.find_normal(t)
                    rows += [i] * len(got)
                    out += got
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *(pa.array([x[j] for x in out], pa.int64()) for j in range(3))], ["doc_id", "item_id", "distance", "allowed"])

    return run


def slices(benchmark: DataFrame, most: int = BENCHMARK_BYTES):
    """The benchmark's (item_id, text) in lists of at most so many bytes."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").toLocalIterator():
        if held and size + len(r[1]) > most:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, distance, allowed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = docs.select("doc_id", "text")
    out = None
    for items in slices(benchmark):
        part = cols.mapInArrow(matched(items), f"doc_id {kind}, item_id long, distance long, allowed long")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, distance long, allowed long")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark."""

    def free_of(items):
        def run(batches):
            matcher = Matcher(items)
            for whole in batches:
                for b in C.chunks(whole, "text"):
                    texts = normals(b.column(b.schema.get_field_index("text")))
                    yield b.filter(pa.array([not matcher.find_normal(t) for t in texts], pa.bool_()))

        return run

    for items in slices(benchmark):
        docs = docs.mapInArrow(free_of(items), docs.schema)
    return docs


def query(spark, sf_dir):
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
