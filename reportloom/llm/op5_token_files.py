"""Operator 5: token ids in frequency-ranked, byte-aligned files, and back.

Texts are range-partitioned by doc_id and encoded in that order. Each block of a file is
self-contained: a table of its distinct ids by falling frequency, the documents' ids and
lengths, a control section of two bits a token (byte count less one, four tokens a byte) and
a data section with each token's rank in that many little-endian bytes, so the most frequent
256 ids of a block cost one byte. Decoding looks the control bytes up in 256-row tables of
lengths, then gathers all ranks with numpy; no loop runs over tokens.

Blocks are the rows of a Parquet table in the shared folder (columns part, block, payload):
Spark's committer makes the write atomic and safe against lost executors on any store.

Encoding runs once over each distinct piece: a text is cut before single spaces with no white
space of Unicode on either side, and between letters, digits and punctuation marks of ASCII (but
the apostrophe, which starts contractions), where the byte-level pattern can't carry a token
across, and a worker keeps the ids of pieces it has seen.

Cached ids are used only where the cached bytes equal the text's own.

Defined results: a null or empty text holds the end id alone; added tokens are taken as the
library takes them; repeated doc_ids keep one entry each; null doc_ids come first and stay
null; a doc_id that is no integer is refused; an empty table gives an empty file set.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"FRVB2\0\0\0"
HEAD = "<8sQQQQQ"
BLOCK_TOKENS = 1_000_000
TABLE = 1 << 18
CACHE_PIECES = 800_000
CACHE_BYTES = 48 << 20
U64 = np.uint64


# ------------------------------------------------------------------- file format


def encode_block(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """docs: int64 document ids, of which the first `nulls` are null; lengths: tokens of each;
    ids: all tokens, uint32."""
    if len(ids) and int(ids.max()) < TABLE + 4 * len(ids):  # a table by id, bounded by the block's size
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        counts, back = counts[names], None
    else:
        names, back, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((names, -counts))
    ranked = names[order].astype(np.uint32)
    rank_of = np.zeros(len(order) if back is not None else int(ranked.max()) + 1, np.uint32)
    rank_of[order if back is not None else ranked] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[ids if back is None else back]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    pad = np.zeros(-len(size) % 4, np.uint8)
    four = np.concatenate([(size - 1).astype(np.uint8), pad]).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4)[None, :] < size[:, None]]
    head = struct.pack(HEAD, MAGIC, len(docs), nulls, len(ids), len(ranked), len(data))
    return b"".join([head, ranked.astype("<u4").tobytes(), docs.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()])


_C = np.arange(256)
LENGTHS = np.stack([(_C >> s & 3) + 1 for s in (0, 2, 4, 6)], 1)


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The inverse of encode_block."""
    magic, n_docs, nulls, n, n_ranked, n_data = struct.unpack_from(HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize(HEAD)

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    ranked, docs, lengths = take("<u4", n_ranked), take("<i8", n_docs), take("<u4", n_docs)
    size = LENGTHS[take(np.uint8, -(-n // 4))].reshape(-1)[:n]
    data = take(np.uint8, n_data)
    end = np.cumsum(size)
    start = end - size
    ranks = np.zeros(n, np.uint32)
    for b in range(int(size.max()) if n else 0):
        has = size > b
        ranks[has] |= data[start[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return docs, lengths, ranked[ranks], nulls


# ----------------------------------------------------------------------- encoding


# of each byte: 1 ASCII letter, 2 digit, 3 punctuation mark but the apostrophe, else 0
CLASS = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 33 <= b <= 126 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8)


# the byte-level alphabet: printable bytes as themselves, the others in order from 256 on
SHOWN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
SHOWN |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
ONE_SPACE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
OLD_LETTERS = "\u0500"  # Latin, Greek and Cyrillic: letters to every version of Unicode


class Encoder:
    """The tokenizers library over distinct pieces, with a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # an added token takes effect wherever it stands, so no piece ends inside one
        self.added = sorted({t.content.encode() for t in self.tok.get_added_tokens_decoder().values()}, key=len, reverse=True)
        split = self.tok.pre_tokenizer.pre_tokenize_str("12") if self.tok.pre_tokenizer else []
        self.digits_apart = len(split) == 2
        # a piece of one class, with a space before it or not, is one word of the model
        spaced = self.tok.pre_tokenizer.pre_tokenize_str(" ab") if self.tok.pre_tokenizer else []
        self.space = spaced[0][0].removesuffix("ab") if len(spaced) == 1 else None
        self.lower = bool(self.tok.normalizer) and self.tok.normalizer.normalize_str("A") == "a"
        # lowering and the Unicode forms act on a letter and its marks, never across a space
        state = json.loads(self.tok.normalizer.__getstate__()) if self.tok.normalizer else {"type": "none"}
        steps = state["normalizers"] if state["type"] == "Sequence" else [state]
        self.words_apart = all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x == ONE_SPACE for x in steps)
        self.forget()

    def forget(self):
        self.slot: dict[int, int] = {}
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows, and tokens by row."""
        n_rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        cut = np.zeros(len(data), bool)
        gap = data == 32
        solid = ~C.white(data)
        cut[1:-1] = gap[1:-1] & solid[:-2] & solid[2:]
        kind = CLASS[data]
        change = kind[1:] != kind[:-1]
        if self.digits_apart:
            change |= kind[1:] == 2
        cut[1:] |= change & (kind[1:] > 0) & (kind[:-1] > 0)
        whole = data.tobytes()
        for t in self.added:
            at = whole.find(t)
            while at >= 0:  # the spaces inside and beside an added token cut nothing
                cut[max(0, at - 1) : at + len(t) + 1] = False
                at = whole.find(t, at + 1)
        starts = off[:-1][off[1:] > off[:-1]]
        cut[starts] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(data))
        key = C.word_hashes(data, s, e)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.slot) + len(uniq) > CACHE_PIECES or len(self.raw) > CACHE_BYTES:
            self.forget()
        get = self.slot.get
        slots = np.fromiter(map(get, uniq.tolist(), repeat(-1)), np.int64, len(uniq))
        new = np.flatnonzero(slots < 0)
        if len(new):
            pieces = [whole[a:b].decode("utf-8") for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            got = self.encoded(pieces, self.one_word(data, kind, s[first[new]], e[first[new]]))
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            base = len(self.at) - 1
            self.raw = np.concatenate([self.raw, np.frombuffer("".join(pieces).encode(), np.uint8)])
            self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum(e[first[new]] - s[first[new]])])
            self.flat = np.concatenate([self.flat, np.array(list(chain.from_iterable(got)), np.uint32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            slots[new] = base + np.arange(len(new))
            self.slot.update(zip(uniq[new].tolist(), slots[new].tolist(), strict=True))
        slots = slots[back]
        # the pieces tile the rows, so their cached bytes, joined, must be the rows' own
        a, b = self.raw_at[slots], self.raw_at[slots + 1]
        place = np.repeat((a - s).astype(np.int32), e - s) if (b - a == e - s).all() else np.zeros(0, np.int32)
        if len(place) != len(data) or not np.array_equal(self.raw.take(place + np.arange(len(data), dtype=np.int32)), data):
            return self.plain(data, off)
        del place
        a, b = self.at[slots], self.at[slots + 1]
        size = b - a
        ends = np.cumsum(size)
        ids = self.flat.take(np.repeat((a - (ends - size)).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32))
        row = np.searchsorted(off, s, side="right") - 1
        return ids, np.bincount(row, weights=size, minlength=n_rows).astype(np.int64)

    def one_word(self, data: np.ndarray, kind: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which pieces are of one class of ASCII but for a first space."""
        after = s + (data[s] == 32)
        whole = after < e
        steps = np.concatenate([[0], np.cumsum(np.concatenate([[False], kind[1:] != kind[:-1]]))])  # changes of class up to a byte
        at, last = np.minimum(after, e - 1), e - 1
        return whole & (kind[at] > 0) & (steps[last + 1] == steps[at + 1])

    def encoded(self, pieces: list[str], one_word: np.ndarray) -> list[list[int]]:
        """Ids of pieces. One word goes to the model at once; the others take the whole way."""
        if self.space is None:
            one_word = np.zeros(len(pieces), bool)
        words = self.tok.model.tokenize
        out: list = [None] * len(pieces)
        for i in np.flatnonzero(one_word).tolist():
            x = pieces[i]
            if x[0] == " ":
                x = self.space + x[1:]
            out[i] = [t.id for t in words(x.lower() if self.lower else x)]
        if self.space is not None:
            # without a space, and of old letters alone; the normalizer takes them at once
            bare = [(i, x[1:] if x[0] == " " else x) for i in np.flatnonzero(~one_word).tolist() for x in (pieces[i],)]
            bare = [(i, y) for i, y in bare if y.isalpha() and max(y) < OLD_LETTERS]
            for (i, _), y in zip(bare, self.normalized([y for _, y in bare]), strict=True):
                if y.isalpha():
                    out[i] = [t.id for t in words((self.space if pieces[i][0] == " " else "") + "".join([SHOWN[b] for b in y.encode()]))]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def normalized(self, words: list[str]) -> list[str]:
        """Words of letters as the normalizer leaves them: in one text, where it keeps words apart."""
        one = self.tok.normalizer.normalize_str if self.tok.normalizer else None
        if one is None or not words:
            return words
        if self.words_apart:
            got = one(" ".join(words)).split(" ")
            if len(got) == len(words):
                return got
        return [one(w) for w in words]

    def plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without pieces or cache, for rows in which two pieces share a key."""
        raw = data.tobytes()
        got = [x.ids for x in self.tok.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)]
        return np.array(list(chain.from_iterable(got)), np.uint32), np.fromiter(map(len, got), np.int64, len(got))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_blocks(path: str, end_id: int):
    """(part, block, tokens, payload) from rows in doc_id order."""

    def run(batches):
        from pyspark import TaskContext

        C.release_memory()
        part = TaskContext.get().partitionId()
        enc = encoder(path)
        docs, lengths, ids, held, block, nulls = [], [], [], 0, 0, 0

        def flush():
            d, n, i = (np.concatenate(x) for x in (docs, lengths, ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(i)], pa.int64()), pa.array([encode_block(d, n, i, nulls)], pa.binary())], ["part", "block", "tokens", "payload"])

        for whole in batches:
            for b in C.chunks(whole, "text", C.CHUNK_BYTES // 2):
                data, off = C.text_bytes(b.column(1))
                got, n = enc(data, off)
                out = np.full(len(got) + len(n), end_id, np.uint32)
                last = np.cumsum(n + 1) - 1
                mask = np.ones(len(out), bool)
                mask[last] = False
                out[mask] = got
                docs.append(b.column(0).fill_null(0).to_numpy().astype(np.int64, copy=False))
                nulls += b.column(0).null_count  # they come first
                lengths.append(n + 1)
                ids.append(out)
                held += len(out)
                if held > BLOCK_TOKENS:
                    yield flush()
                    docs, lengths, ids, held, nulls = [], [], [], 0, 0
                    block += 1
        if docs:
            yield flush()

    return run


def read_blocks(batches):
    """(part, block, place, doc_id, n_tokens, ids_crc32, before): documents of each block, in order."""
    for b in batches:
        for part, block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            docs, lengths, ids, nulls = decode_block(payload.as_py())
            raw = memoryview(ids.astype("<u4").tobytes())
            end = np.cumsum(lengths.astype(np.int64))
            start = end - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(docs, pa.int64(), mask=np.arange(n) < nulls), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(start, pa.int64())],
                ["part", "block", "doc_id", "n_tokens", "ids_crc32", "before"],
            )


def write_tokens(docs: DataFrame, path: str, end_id: int, scratch: C.Scratch) -> DataFrame:
    """Encode docs (doc_id, text) into blocks in ascending doc_id order; returns the file table."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.crc32("text")).sortWithinPartitions("doc_id")
    return scratch.keep(ordered.mapInArrow(write_blocks(path, end_id), "part int, block int, tokens long, payload binary"), codec="none")


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of a file table: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()  # one row a partition
    seen, rows = 0, []
    for x in totals:
        rows.append((x.part, seen))
        seen += x.n
    part_base = spark.createDataFrame(rows, "part int, part_base long")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("part", "block", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("block_base"))
    base = blocks.join(F.broadcast(part_base), "part").select("part", "block", (F.col("part_base") + F.col("block_base")).alias("base"))
    docs = files.select("part", "block", "payload").mapInArrow(read_blocks, "part int, block int, doc_id long, n_tokens long, ids_crc32 long, before long")
    return docs.join(base, ["part", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir, tokenizer: str | None = None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_tokens(write_tokens(C.table(spark, sf_dir, "documents"), tokenizer, 2, C.Scratch(spark, "tokens")))
