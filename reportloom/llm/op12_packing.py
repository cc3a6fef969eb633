"""Operator 12: packing into fixed sequences as vector bin packing, by the dot-product heuristic.

An item is a run of tokens with three sizes: its tokens, one segment, and the tokens of it that
bear loss. A sequence has a limit on each. Items are dealt by a hash of their id into groups of
some thousands, and each group is packed by itself: a sequence is opened, and again and again
the item goes in that fits every limit and whose sizes have the largest dot product with the
room left, each limit weighted by what the group asks of it. Items of equal sizes are one class
with a count, so a step costs a few numpy operations over classes, at most some thousands.

Groups are independent and of bounded size, so the work is one shuffle of short rows; at most
the last sequence or two of a group stay open, well under one in a hundred of its tokens.

`token_table` encodes documents once, into a table of pieces with their ids in the shared
folder; documents longer than a sequence are cut into full sequences and a rest. `pack` places
pieces or any other items, `sequences` joins the ids back into whole sequences. Instruction
data: `conversation_items` gives one item a conversation, in which only the answers bear loss.

Defined results: a null or empty text is the end id alone; repeated rows and null doc_ids are
items of their own; an item above a limit in any size is refused (documents are cut before);
an empty table gives no piece; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .op5_token_files import encoder

GROUP_ITEMS = 4096


class Limits(NamedTuple):
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


PIECES = "piece_id long, doc_id long, start long, length long, loss long, doc_tokens long, ids binary"


def encode(path: str, end_id: int, most: int):
    """(piece_id, doc_id, start, length, loss, doc_tokens, ids) from rows (doc_id, text)."""

    def run(batches):
        from pyspark import TaskContext

        C.release_memory()
        made = TaskContext.get().partitionId() << 40
        enc = encoder(path)
        for whole in batches:
            for b in C.chunks(whole, "text", C.CHUNK_BYTES // 2):
                data, off = C.text_bytes(b.column(1))
                got, n = enc(data, off)
                total = n + 1
                ids = np.full(int(total.sum()), end_id, "<u4")
                keep = np.ones(len(ids), bool)
                keep[np.cumsum(total) - 1] = False
                ids[keep] = got
                pieces = -(-total // most)
                row = np.repeat(np.arange(len(total)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * most
                length = np.minimum(most, total[row] - start)
                at = np.repeat(np.cumsum(total) - total, pieces) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made + np.arange(len(row))), b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(length - 1), pa.array(total[row]), C.binary(ids.view(np.uint8), at * 4, (at + length) * 4)],
                    ["piece_id", "doc_id", "start", "length", "loss", "doc_tokens", "ids"],
                )
                made += len(row)

    return run


def token_table(docs: DataFrame, path: str, end_id: int, scratch: C.Scratch, most: int = 2048) -> DataFrame:
    """Pieces of docs (doc_id, text) of at most so many ids, written once. The first token of a
    piece has nothing before it, so all but that one bear loss."""
    return scratch.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode(path, end_id, most), PIECES))


def place(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each item, and its place there. sizes: items by limits, in integers."""
    if len(sizes) and (sizes > limits).any():
        raise ValueError("an item is larger than a sequence")
    kinds, kind, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    if (np.diff(kinds, axis=0) >= 0).all():
        return place_nested(kinds, kind.reshape(-1), left, limits)
    share = kinds / limits
    asked = share * (left[:, None] / max(1, len(sizes)))
    gain = share * asked.sum(0)  # each limit weighted by what the group asks of it
    order = np.argsort(kind.reshape(-1), kind="stable")  # items class by class
    next_of = np.cumsum(left) - left
    sequence, position = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    waiting, now = len(sizes), -1
    while waiting:
        now += 1
        room, held = limits.copy(), 0
        while True:
            score = np.where((left > 0) & (kinds <= room).all(1), gain @ (room / limits), -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                break
            item = order[next_of[best]]
            sequence[item], position[item] = now, held
            next_of[best] += 1
            left[best] -= 1
            room -= kinds[best]
            held += 1
            waiting -= 1
        if left.min() == 0:  # classes that are used up are not looked at again
            on = left > 0
            kinds, gain, left, next_of = kinds[on], gain[on], left[on], next_of[on]
            if not waiting:
                break
    return sequence, position


def place_nested(kinds: np.ndarray, kind: np.ndarray, left: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`place` where each class holds the one before it in every size: all weights being positive, the
    largest dot product is that of the last class that fits, which is looked up and not searched for."""
    order = np.argsort(kind, kind="stable")
    next_of, left, sizes, columns = (np.cumsum(left) - left).tolist(), left.tolist(), kinds.tolist(), kinds.T.tolist()
    below = list(range(-1, len(sizes)))  # below[c + 1]: the last class up to c that isn't used up, or one nearer to it
    items, sequences, positions, now = [], [], [], -1
    while len(items) < len(order):
        now, room, held = now + 1, limits.tolist(), 0
        while True:
            c = min(map(bisect_right, columns, room)) - 1
            while c != below[c + 1]:
                below[c + 1] = below[below[c + 1] + 1]
                c = below[c + 1]
            if c < 0:
                break
            items.append(next_of[c])
            sequences.append(now)
            positions.append(held)
            next_of[c] += 1
            left[c] -= 1
            if not left[c]:
                below[c + 1] = below[c]
            room = [r - x for r, x in zip(room, sizes[c], strict=True)]
            held += 1
    sequence, position = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    at = order[np.array(items, np.int64)]
    sequence[at], position[at] = sequences, positions
    return sequence, position


def pack_group(limits: Limits):
    room = np.array(limits, np.int64)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_id")
        length = table["length"].to_numpy()
        sequence, position = place(np.stack([length, np.ones_like(length), table["loss"].to_numpy()], 1), room)
        order = np.lexsort((position, sequence))
        end = np.cumsum(length[order])
        fresh = np.append(True, np.diff(sequence[order]) > 0)
        before = (end - length[order])[fresh][np.cumsum(fresh) - 1]
        offset = np.zeros(len(order), np.int64)
        offset[order] = end - length[order] - before
        table = table.append_column("sequence_id", pa.array((table["grp"].to_numpy() << 20) + sequence))
        return table.append_column("offset", pa.array(offset)).drop_columns(["grp"])

    return run


def pack(items: DataFrame, limits: Limits = Limits(), n_items: int | None = None) -> DataFrame:
    """items (piece_id, length, loss, any others) -> the same with sequence_id and offset."""
    n = items.count() if n_items is None else n_items
    groups = max(1, math.ceil(n / GROUP_ITEMS))
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInArrow(pack_group(limits), schema)


def sequences(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_segments, doc_ids, starts, ids): whole sequences, their pieces'
    ids joined in order; at most limits.tokens ids a row."""
    rows = placed.select("piece_id", "sequence_id", "offset").join(tokens.select("piece_id", "doc_id", "start", "length", "ids"), "piece_id")
    held = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    joined = F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return held.select("sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), F.size("p").alias("n_segments"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), joined.alias("ids"))


def conversation_items(turns: DataFrame, tokenizer: str, end_id: int, scratch: C.Scratch, most: int = 2048, bearing: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one item a conversation for `pack`: (piece_id, doc_id,
    length, loss), written once. Each turn is its ids and the end id; those of bearing roles bear
    loss. Only sizes travel. A conversation above `most` tokens is cut at `most` ids into items."""
    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), F.coalesce(F.col("role").isin(*bearing), F.lit(False)).alias("bears"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.select("doc_id", "bears", "text").mapInArrow(count_tokens(tokenizer), "doc_id long, bears boolean, n long")
    whole = sizes.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("bearing"))
    # a conversation that is cut spreads its loss-bearing tokens evenly over its items
    cuts = whole.select("doc_id", "n", "bearing", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(most).cast("long"))).alias("start"))
    end = F.least(F.col("start") + most, F.col("n"))
    upto = lambda x: F.floor(F.col("bearing") * x / F.col("n"))
    return scratch.keep(cuts.select(F.monotonically_increasing_id().alias("piece_id"), "doc_id", "start", (end - F.col("start")).alias("length"), (upto(end) - upto(F.col("start"))).cast("long").alias("loss")))


def count_tokens(path: str):
    def run(batches):
        C.release_memory()
        enc = encoder(path)
        for whole in batches:
            for b in C.chunks(whole, "text", C.CHUNK_BYTES // 2):
                _, n = enc(*C.text_bytes(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n + 1)], ["doc_id", "bears", "n"])

    return run


def query(spark, sf_dir, tokenizer: str | None = None):
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    tokens = token_table(C.table(spark, sf_dir, "documents"), tokenizer, 1, C.Scratch(spark, "packing"))
    pieces = tokens.select("piece_id", "doc_id", "start", "length", "loss", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces, n_items=tokens.count()).drop("piece_id", "loss")
