"""Operator 11: alignment of two tokenizers over documents, by distinct segments.

A text (a space before it, as the piece model adds one) is cut before runs of white space that
start with a character no token of either vocabulary holds after another character. This is
verified over both vocabularies when they are loaded; only such characters cut. No merge of
either model can then cross a cut, and the byte-level pattern never matches from a character
into a run of white space, so a segment alone has the tokens it has in its text.

1. Tasks cut their documents in blocks of some megabytes. A block is one row: its distinct
   segments, and its documents as numbers into that list.
2. Distinct segments of the whole corpus are tokenised twice and aligned once: groups of tokens
   between byte offsets where tokens of both end. Segments are encoded in runs, as no token
   crosses from one to the next, which the token's bytes show.
3. Alignments are joined back to the blocks, one row a block and distinct segment, and each
   block composes its documents: segment ends are ends of both models' tokens, so groups of a
   document are its segments' groups one after the other.
4. Documents by linked pair are summed from the blocks' distinct pairs; the counts return to the
   blocks the same way and give each document its sums.

What is shuffled grows with distinct segments and pairs of blocks, not with words; a frequent
segment is one row a block, and the joins are sort-merge joins that adaptive execution splits.
No table is gathered or broadcast by hand, no group is larger than one block and its documents.

Defined results: null and empty texts, and texts that the piece model can't give back byte for
byte (those that hold U+2581), have no tokens: zeros, '' for their groups, and no share in the
counts. Repeated rows count as documents of their own; null doc_ids stay null; an empty table
gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .op5_token_files import SHOWN

BLOCK_BYTES = 12 << 20
IN_A_RUN = 200
MARK = "▁"
UNSHOWN = MARK.encode()


class Models:
    """Both tokenizers, the bytes of their tokens, and the characters that may start a segment."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {c: b for b, c in SHOWN.items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n))]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.mark = self.b.piece_to_id(MARK)
        self.starts = [w for w in b" \n" if self.parts(w)]

    def parts(self, w: int) -> bool:
        """No token of either vocabulary holds this character after one that isn't white space; and a
        line feed is in no longer piece at all, so the mark that the model adds stays a token."""
        for token in (*self.a_bytes, *self.b_bytes):
            at = token.find(w, 1)
            while at > 0:
                if not C.white(np.frombuffer(token[:at], np.uint8))[-1]:
                    return False
                at = token.find(w, at + 1)
        return w == 32 or not any(w in p and len(p) > 1 for p in self.b_bytes)

    def cuts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every segment."""
        cut = np.zeros(len(data), bool)
        if len(data):
            blank = C.white(data)
            cut[1:] = np.isin(data[1:], self.starts) & ~blank[:-1]
            cut[off[:-1][off[1:] > off[:-1]]] = True
        s = np.flatnonzero(cut)
        return s, np.append(s[1:], len(data))[: len(s)]

    def pair(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by both models. The piece model puts a mark before what it is given: it stands for a
        text's own first space, and is dropped where the text starts otherwise."""
        a = self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            return a, [self.mark]
        return a, self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def run(self, segments: list[bytes]) -> list[bytes | None]:
        """Groups of each segment as text, `a1,a2|b1;a3|b2`, from the tokens of all in one string; None
        for all if the tokens don't give back the string, or one crosses from segment to segment."""
        whole = b"".join(segments)
        a, b = self.pair(whole.decode("utf-8"))
        bound = np.cumsum([len(x) for x in segments])
        if b"".join([self.a_bytes[x] for x in a]) != whole or b"".join([self.b_bytes[x] for x in b]) != whole:
            return [None] * len(segments)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of = np.searchsorted(bound, common)  # the segment of each group
        if not np.array_equal(common[np.flatnonzero(np.append(np.diff(of) > 0, True))], bound):
            return [None] * len(segments)
        shown_a, shown_b = list(map(str, a)), list(map(str, b))
        many_a, many_b = (np.bincount(np.searchsorted(common, x), minlength=len(common)).tolist() for x in (ends_a, ends_b))
        i = j = 0
        groups = []
        for m, n in zip(many_a, many_b, strict=True):
            groups.append(f"{shown_a[i]}|{shown_b[j]}" if m == n == 1 else f"{','.join(shown_a[i : i + m])}|{','.join(shown_b[j : j + n])}")
            i, j = i + m, j + n
        cut = np.append(0, np.cumsum(np.bincount(of, minlength=len(segments)))).tolist()
        return [";".join(groups[x:y]).encode() for x, y in zip(cut, cut[1:], strict=False)]

    def aligned(self, segments: list[bytes]) -> list[bytes | None]:
        """Groups of each segment; None where a model's tokens don't give the segment back."""
        blank = C.white(np.frombuffer(b"".join(segments), np.uint8))
        end = np.cumsum([len(x) for x in segments]) - 1
        apart = blank[end].tolist()  # the end of a text; what follows would change it
        out: list[bytes | None] = [None] * len(segments)
        together = [i for i, x in enumerate(segments) if not apart[i] and len(x) < 1000 and UNSHOWN not in x]
        alone = [i for i in range(len(segments)) if apart[i] or len(segments[i]) >= 1000 or UNSHOWN in segments[i]]
        for at in range(0, len(together), IN_A_RUN):
            of = together[at : at + IN_A_RUN]
            got = self.run([segments[i] for i in of])
            if got[0] is None:
                alone += of
            else:
                for i, x in zip(of, got, strict=True):
                    out[i] = x
        for i in alone:
            out[i] = self.run([segments[i]])[0]
        return out


_MODELS: dict[tuple[str, str], Models] = {}


def models(a_path: str, b_path: str) -> Models:
    if (a_path, b_path) not in _MODELS:
        _MODELS[a_path, b_path] = Models(a_path, b_path)
    return _MODELS[a_path, b_path]


def small(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each that hold them all: first all low bytes, then all
    next ones, which compress well where large numbers are rare. The first byte says how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def large(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, raw[0]):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def one_list(values: pa.Array) -> pa.Array:
    """A column of one row that holds them all."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# ------------------------------------------------------------------------ blocks

BLOCK = "block long, doc_ids array<bigint>, lens binary, seq binary, segs array<binary>"


def beginnings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice as a number that sorts like them."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.ndarray((len(data) + 1,), ">u8", buffer=pad, strides=(1,))[s].astype(np.uint64)
    short = (8 * (8 - np.minimum(e - s, 8))).astype(np.uint64)
    return np.where(short < 64, first >> np.minimum(short, np.uint64(63)) << np.minimum(short, np.uint64(63)), np.uint64(0))


def cut_blocks(a_path: str, b_path: str):
    def run(batches):
        from pyspark import TaskContext

        C.release_memory()
        m = models(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in C.chunks(whole, "text", BLOCK_BYTES):
                text = pc.fill_null(batch.column(1), "")
                text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(pa.scalar(" "), text, pa.scalar("")))
                data, off = C.text_bytes(text)
                s, e = m.cuts(data, off)
                key = C.word_hashes(data, s, e)
                _, first, back = np.unique(key, return_index=True, return_inverse=True)
                check = C.word_hashes(data, s, e, 1)
                if not (check[first][back] == check).all():  # two segments share a key
                    _, first, back = np.unique(np.stack([key, check], 1), axis=0, return_index=True, return_inverse=True)
                    back = back.reshape(-1)
                # frequent segments have small numbers; those of one frequency stand by their first bytes, which compresses well
                order = np.lexsort((beginnings(data, s[first], e[first]), -np.bincount(back, minlength=len(first))))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                first, back = first[order], rank[back]
                lens = np.bincount(np.searchsorted(off, s, side="right") - 1, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), one_list(C.packed(batch.column(0))), pa.array([small(lens)], pa.binary()), pa.array([small(back)], pa.binary()), one_list(C.binary(data, s[first], e[first]))],
                    ["block", "doc_ids", "lens", "seq", "segs"],
                )
                block += 1

    return run


def align_segments(a_path: str, b_path: str):
    def run(batches):
        C.release_memory()
        m = models(a_path, b_path)
        for whole in batches:
            for batch in C.chunks(whole, "seg"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.aligned(batch.column(0).to_pylist()), pa.binary())], ["seg", "groups"])

    return run


# ------------------------------------------------------------------- composition

COMPOSED = "block long, doc_ids array<bigint>, n_a binary, n_b binary, n_groups binary, n_links binary, shown array<binary>, held binary, which binary, weight binary, pairs array<bigint>, n_docs array<bigint>"


PACKED = "block long, idx binary, sizes binary, texts binary"


def pack_rows(batches):
    """Rows (block, idx, groups) as one row a block and batch: what is shuffled next has no frame for
    each segment. A segment without groups has size 0."""
    for b in batches:
        block = b.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        if not len(order):
            continue
        block, idx = block[order], b.column(1).to_numpy()[order]
        data, off = C.text_bytes(b.column(2).take(pa.array(order)))
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        end = np.append(cut[1:], len(block))
        part = lambda x: pa.array([small(x[i:j]) for i, j in zip(cut, end, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block[cut]), part(idx), part(np.diff(off)), C.binary(data, off[cut], off[end])], ["block", "idx", "sizes", "texts"])


def unpacked(rows: pa.Table) -> pa.Array:
    """The groups of a block's segments in their order; null where they have none."""
    idx = np.concatenate([np.zeros(0, np.int64), *map(large, rows["idx"].to_pylist())])
    size = np.concatenate([np.zeros(0, np.int64), *map(large, rows["sizes"].to_pylist())])
    data = np.frombuffer(b"".join(rows["texts"].to_pylist()), np.uint8)
    order = np.argsort(idx)
    if not np.array_equal(idx[order], np.arange(len(idx))):
        raise RuntimeError("a segment has no alignment, or two")
    start = (np.cumsum(size) - size)[order]
    out = C.binary(data, start, start + size[order])
    return pc.if_else(pa.array(size[order] > 0), out, pa.scalar(None, pa.binary()))


class Groups:
    """The groups of some segments, from their texts: tokens and links by segment."""

    def __init__(self, shown: pa.Array):
        data, off = C.text_bytes(shown)
        digit = (data >= 48) & (data <= 57)
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        first = digit.copy()
        first[1:] &= ~digit[:-1] | edge[1:-1]
        last = digit.copy()
        last[:-1] &= ~digit[1:] | edge[1:-1]
        s, size = np.flatnonzero(first), None
        size = np.flatnonzero(last) + 1 - s
        value = np.zeros(len(s), np.int64)
        for k in range(int(size.max()) if len(s) else 0):
            on = size > k
            value[on] = value[on] * 10 + (data[s[on] + k] - 48)
        at = np.arange(len(s))
        before = np.where(s > 0, data[np.maximum(s - 1, 0)], 0)
        opens = edge[s] | (before == 59)  # a group starts at a text's start or after a semicolon
        right = np.maximum.accumulate(np.where((before == 124) & ~edge[s], at, -1)) > np.maximum.accumulate(np.where(opens, at, -1))
        group = np.cumsum(opens) - 1
        n_groups = int(opens.sum())
        self.n = len(off) - 1
        row = np.searchsorted(off, s, side="right") - 1
        many_a, many_b = (np.bincount(group[x], minlength=n_groups) for x in (~right, right))
        of = row[opens]
        self.n_a, self.n_b = (np.bincount(row[x], minlength=self.n) for x in (~right, right))
        self.n_groups = np.bincount(of, minlength=self.n)
        links = many_a * many_b
        self.n_links = np.bincount(of, weights=links, minlength=self.n).astype(np.int64)
        # all pairs of a group's tokens, as places; group by group
        start = np.flatnonzero(opens)
        g = np.repeat(np.arange(n_groups), links)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(links) - links, links)
        i, j = start[g] + nth // many_b[g], start[g] + many_a[g] + nth % many_b[g]
        self.pairs, which = np.unique(value[i] << 32 | value[j], return_inverse=True)
        wide = max(1, len(self.pairs))
        key, self.times = np.unique(of[g] * wide + which, return_counts=True)
        self.which = key % wide  # distinct pairs of each segment, as places in pairs, and their links
        self.per = np.bincount(key // wide, minlength=self.n)


def compose(digest: bool):
    """One block and its alignments -> the block's documents, its distinct pairs and, sparsely, the
    pairs and links of each document."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lens, seq = large(left["lens"][0].as_py()), large(left["seq"][0].as_py())
        n_docs = len(lens)
        shown_of = unpacked(right)
        if len(shown_of) != (int(seq.max()) + 1 if len(seq) else 0):
            raise RuntimeError("a segment has no alignment")
        x = Groups(shown_of)
        row = np.repeat(np.arange(n_docs), lens)
        bad = np.asarray(shown_of.is_null())
        fine = np.bincount(row[bad[seq]], minlength=n_docs) == 0 if bad.any() else np.ones(n_docs, bool)
        sums = [(np.bincount(row, weights=c[seq].astype(np.float64), minlength=n_docs) * fine).astype(np.int64) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)]
        text = np.array(shown_of.to_pylist(), object)
        end = np.cumsum(lens)
        shown = []
        for a, b, ok in zip((end - lens).tolist(), end.tolist(), fine.tolist(), strict=True):
            whole = b";".join(text[seq[a:b]].tolist()) if ok else b""
            shown.append(hashlib.sha256(whole).hexdigest().encode() if digest and whole else whole)
        # distinct segments of each document, then its distinct pairs
        step = max(1, x.n)
        mine, times = np.unique((row * step + seq)[fine[row]], return_counts=True)
        doc, segment = mine // step, mine % step
        start, many = np.cumsum(x.per) - x.per, x.per[segment]
        place = np.arange(int(many.sum())) + np.repeat(start[segment] - (np.cumsum(many) - many), many)
        wide = max(1, len(x.pairs))
        held, at = np.unique(np.repeat(doc, many) * wide + x.which[place], return_inverse=True)
        weight = np.bincount(at, weights=np.repeat(times, many) * x.times[place].astype(np.float64), minlength=len(held)).astype(np.int64)
        which = held % wide
        docs_of = np.bincount(which, minlength=len(x.pairs))
        used = docs_of > 0
        which = (np.cumsum(used) - 1)[which] if len(which) else which
        return pa.table(
            [
                pa.array([left["block"][0].as_py()]), left["doc_ids"].combine_chunks(), *(pa.array([small(c)], pa.binary()) for c in sums), one_list(pa.array(shown, pa.binary())),
                *(pa.array([small(c)], pa.binary()) for c in (np.bincount(held // wide, minlength=n_docs), which, weight)), one_list(pa.array(x.pairs[used])), one_list(pa.array(docs_of[used])),
            ],
            names=["block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "shown", "held", "which", "weight", "pairs", "n_docs"],
        )

    return run


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, shown binary"


def settle(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """One composed block and the counts of its pairs -> its documents."""
    one = lambda c: large(left[c][0].as_py())
    right = right.sort_by("idx")
    count, best = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
    held, which, weight = one("held"), one("which"), one("weight")
    if right.num_rows != (int(which.max()) + 1 if len(which) else 0):
        raise RuntimeError("a pair has no count, or two")
    before = np.append(0, np.cumsum(held))
    total = lambda x: np.diff(np.append(0, np.cumsum(x * weight))[before])
    ids = C.packed(left["doc_ids"].combine_chunks()).flatten()
    sums = [pa.array(one(c)) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.table([ids, *sums, pa.array(total(best[which])), pa.array(total(count[which])), C.packed(left["shown"].combine_chunks()).flatten()], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "shown"])


def brought_back(blocks: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Each block with the rows found for it, one block at a time in Arrow."""
    rows = rows.withColumn("of", F.col("block") + 0).drop("block")  # a column of its own, as both come from one table
    return blocks.groupBy("block").cogroup(rows.groupBy("of")).applyInArrow(run, schema)


def linked_pairs(composed: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether its A id has no pair with more.
    There are at most as many pairs as products of the two vocabularies' ids."""
    n = composed.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def compose_documents(docs: DataFrame, a_path: str, b_path: str, scratch: C.Scratch, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> composed blocks, written."""
    blocks = scratch.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_blocks(a_path, b_path), BLOCK))
    distinct = blocks.select(F.explode("segs").alias("seg")).distinct()
    segments = scratch.keep(distinct.mapInArrow(align_segments(a_path, b_path), "seg binary, groups binary"))
    scratch.sweep()
    wanted = blocks.select("block", F.posexplode("segs").alias("idx", "seg"))
    # written, so that the join's shuffle can go before the next one comes
    rows = scratch.keep(wanted.join(segments, "seg").select("block", "idx", "groups").mapInArrow(pack_rows, PACKED))
    scratch.drop(segments)
    scratch.sweep()
    out = scratch.keep(brought_back(blocks.select("block", "doc_ids", "lens", "seq"), rows, compose(digest), COMPOSED))
    scratch.drop(blocks, rows)
    scratch.sweep()
    return out


def align_documents(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups (text),
    or with digest groups_sha256."""
    scratch = C.Scratch(docs.sparkSession, "alignment")
    composed = compose_documents(docs, a_path, b_path, scratch, digest)
    pairs = scratch.keep(linked_pairs(composed))
    wanted = composed.select("block", F.posexplode("pairs").alias("idx", "pair"))
    rows = wanted.join(pairs, "pair").select("block", "idx", "n", "best")
    out = brought_back(composed.drop("pairs", "n_docs"), rows, settle, DOCUMENT)
    return out.withColumn("groups_sha256" if digest else "groups", F.col("shown").cast("string")).drop("shown")


def query(spark, sf_dir, a: str | None = None, b: str | None = None):
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(C.table(spark, sf_dir, "documents"), a, b, digest=True)
