"""Operator 3: exact n-gram Jaccard self-join by universe partition and pigeonhole.

Each text is the set of hashes of its distinct word shingles. Sets fall into size bands
such that linked sets lie in the same band or in neighbours. A band's scheme splits the
token universe into m = H + 1 + slack segments, H being the largest symmetric difference
that linked sets of the band can have, so linked sets agree on a whole segment subset.

Cost-based allocation: a segment whose tokens are all corpus-wide frequent (or that is
empty) has a long list and is given up by sets that have at most `slack` of them. Sets
with more of them ("poor") give them up too if one-deletion neighbourhoods of their
informative segments can pay for it (2 * (m - given up) > H), else they index every
segment. For any linked pair one of these subsets then still collides (see `signatures`),
and every collision is verified on the texts, so the join is exact.

Colliding sets are first compared with the smallest set of their list only. Lists that
still hold several components are then compared across components, so large groups of
near copies don't expand into all their pairs and no link between different texts is lost
from the components.

Defined results: null and word-less texts have no shingle, size 0, and are their own
component; a text of fewer words than a shingle counts as one shingle; equal texts share a
component; repeated doc_ids give repeated rows, each judged by its own text; a null doc_id
takes part and is never chosen as a component's id while another id is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
HEAVY_SHARE = 1000
HEAVY_LEAST = 50
COMBINE_ROWS = 2_000_000
LOCAL_LIST = 64
SALT_ROWS = 1024
PART_ENTRIES = 4_000_000


class Rule:
    """Shingle width, similarity num/100, lower-casing; and the bands that follow from them."""

    def __init__(self, width: int, percent: int, lower: bool):
        self.width, self.percent, self.lower = width, percent, lower
        low, self.low, self.high = 1, [], []
        while low < 1 << 40:
            self.low.append(low)
            self.high.append(low * 100 // percent)
            low = self.high[-1] + 1
        self.low, self.high = np.array(self.low), np.array(self.high)
        # |x ^ y| <= (x + y) (1 - t) / (1 + t), x + y <= 2 * high
        self.most = 2 * self.high * (100 - percent) // (100 + percent)
        # room for the empty segments that the smallest sets of a scheme are likely to have
        fewest, slack = self.low * percent / 100, np.ones(len(self.low))
        for _ in range(30):
            m = self.most + 1 + slack
            empty = m * np.exp(-fewest / m)
            slack = np.minimum(1 + empty + 3 * np.sqrt(empty), 1 + self.most)
        self.slack = np.ceil(np.where(self.most > 0, slack, 1)).astype(np.int64)
        self.m = self.most + 1 + self.slack


def shingle_sets(batch: pa.RecordBatch, col: str, rule: Rule, lane: int = 0):
    """(row, hash) of the distinct shingles of each text, in that order, and sizes by row.
    Lane 0 serves the index, lane 1, which is independent of it, whatever verifies it."""
    data, off = C.text_bytes(batch.column(batch.schema.get_field_index(col)))
    if rule.lower:
        data = C.LOWER[data]
    ws, we, row = C.words(data, off)
    n_rows = batch.num_rows
    h = C.word_hashes(data, ws, we, lane)
    g = C.gram_hashes(h, rule.width)
    same = row[: len(g)] == row[rule.width - 1 :] if len(g) else np.zeros(0, bool)
    r, g = row[: len(g)][same], g[same]
    n_words = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((n_words > 0) & (n_words < rule.width))
    if len(short):
        first = np.searchsorted(row, short)
        out = n_words[short].astype(U64)
        for i in range(rule.width - 1):
            has = n_words[short] > i
            out[has] = (out[has] + h[np.minimum(first + i, len(h) - 1)][has]) * C.BASE
            out[has] ^= out[has] >> U64(31)
        r, g = np.concatenate([r, short]), np.concatenate([g, C.mix(out)])
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    if len(r):
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        r, g = r[new], g[new]
    return r, g, np.bincount(r, minlength=n_rows)


def sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by key, modulo 2**64 (halves are exact in doubles)."""
    low = np.bincount(keys, weights=(values & U64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    top = np.bincount(keys, weights=(values >> U64(32)).astype(np.float64), minlength=n)
    return low.astype(U64) + (top.astype(U64) << U64(32))


def set_ids(r, g, n_rows):
    return C.mix(sums(r, C.mix(g), n_rows))


def sizes_of(rule: Rule):
    """(doc_id, n_shingles, set_id, check_id) of each document."""

    def run(batches):
        C.release_memory()
        for whole in batches:
            for b in C.chunks(whole, "text"):
                r, g, n = shingle_sets(b, "text", rule)
                one = set_ids(r, g, b.num_rows)
                r, g, _ = shingle_sets(b, "text", rule, 1)
                two = set_ids(r, g, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), C.as_long(one), C.as_long(two)], ["doc_id", "n_shingles", "set_id", "check_id"])

    return run


def local_heavy(rule: Rule):
    """Shingles that many of this task's documents hold, with their counts."""

    def run(batches):
        C.release_memory()
        docs, keys, counts = 0, np.zeros(0, U64), np.zeros(0, np.int64)
        waiting, held = [], 0

        def merge():
            nonlocal keys, counts, waiting, held
            k = np.concatenate([keys, *waiting])
            c = np.concatenate([counts, np.ones(held, np.int64)])
            keys, back = np.unique(k, return_inverse=True)
            counts = np.bincount(back, weights=c).astype(np.int64)
            keep = counts > docs // (4 * HEAVY_SHARE)
            keys, counts, waiting, held = keys[keep], counts[keep], [], 0

        for whole in batches:
            for b in C.chunks(whole, "text"):
                _, g, n = shingle_sets(b, "text", rule)
                docs += b.num_rows
                waiting.append(g)
                held += len(g)
                if held > COMBINE_ROWS:
                    merge()
        if docs:
            merge()
            keep = counts >= max(3, docs // HEAVY_SHARE)
            yield pa.RecordBatch.from_arrays([C.as_long(keys[keep]), pa.array(counts[keep], pa.int64())], ["token", "n"])

    return run


def signatures(r, g, n, member, rule: Rule, heavy: np.ndarray):
    """(signature, member) of one chunk.

    Lost collisions: a set that gives up a segment loses only pairs that agree on it, as the
    choice depends on the segment's content alone. With at most `slack` given up, m - slack >
    H segments are left, each of which differs in a pair without a collision: more than H.
    With one-deletion neighbourhoods on both sides a segment without a collision differs
    twice, and 2 * (m - given up) > H is what `pays` asks for."""
    if not len(r):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.searchsorted(heavy, g)
    rare = heavy[np.minimum(at, len(heavy) - 1)] != g if len(heavy) else np.ones(len(g), bool)
    band = np.searchsorted(rule.low, np.maximum(n, 1), side="right") - 1
    out_s, out_m = [], []
    for step in (0, 1):
        b = band + step
        use = (n > 0) & (100 * n >= rule.percent * rule.low[b]) & (rule.most[b] > 0)
        if not use.any():
            continue
        most, m = np.where(use, rule.most[b], 0), np.where(use, rule.m[b], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        mine = use[r]
        rr, gg, ra = r[mine], g[mine], rare[mine]
        t = C.mix(gg ^ U64(0x2545F4914F6CDD1D))
        seg = base[rr] + ((t >> U64(20)) % m[rr].astype(U64)).astype(np.int64)
        total = int(base[-1])
        content = sums(seg, t, total)
        told = np.bincount(seg, weights=ra, minlength=total) > 0
        owner = np.repeat(np.arange(len(n)), m)
        place = np.arange(total) - base[owner]
        salt = C.mix((b[owner].astype(U64) << U64(40)) + place.astype(U64))
        given = np.bincount(owner, weights=~told, minlength=len(n))
        poor = given > rule.slack[np.minimum(b, len(rule.slack) - 1)]
        pays = 2 * (m - given) > most
        emit = told | (poor & ~pays)[owner]
        out_s.append(C.mix(content[emit] ^ salt[emit]))
        out_m.append(member[owner[emit]])
        near = poor[rr] & told[seg]
        if near.any():
            s = seg[near]
            out_s.append(C.mix((content[s] - t[near]) ^ salt[s]))
            out_m.append(member[owner[s]])
    if not out_s:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_m)


def unique_pairs(s, m):
    order = np.lexsort((m, s))
    s, m = s[order], m[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (m[1:] != m[:-1])
    return s[new], m[new]


KEY_BYTES = 6


def list_ids(s: np.ndarray, parts: int) -> np.ndarray:
    """Signatures cut to KEY_BYTES inside their part. Lists that coincide so only add pairs to
    verify."""
    cut = U64((1 << 8 * KEY_BYTES) - 1)
    return (s // U64(parts) & cut) * U64(parts) + s % U64(parts)


def pack_entries(key: np.ndarray, sig: np.ndarray, mem: np.ndarray, parts: int) -> bytes:
    """Index entries of one part: keys in six bytes, members by place in a table, and the
    list id of the entries that were moved to a key of their own."""
    table, place = np.unique(mem, return_inverse=True)
    wide = len(table) > 1 << 16
    moved = np.flatnonzero(key != sig)
    head = np.array([len(key), len(table), len(moved), wide], "<u4").tobytes()
    short = (key // U64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return b"".join([head, table.astype("<i8").tobytes(), place.astype("<u4" if wide else "<u2").tobytes(), moved.astype("<u4").tobytes(), list_ids(sig[moved], parts).astype("<u8").tobytes(), short.tobytes()])


def unpack_entries(raw: bytes, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, n_table, n_moved, wide = np.frombuffer(raw, "<u4", 4).tolist()
    at = 16

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    table, place = take("<i8", n_table), take("<u4" if wide else "<u2", n)
    moved, own = take("<u4", n_moved), take("<u8", n_moved)
    full = np.zeros((n, 8), np.uint8)
    full[:, :KEY_BYTES] = take(np.uint8, n * KEY_BYTES).reshape(n, KEY_BYTES)
    key = full.view("<u8")[:, 0] * U64(parts) + U64(part)
    sig = key.copy()
    sig[moved] = own
    return key, sig, table[place]


def index_rows(rule: Rule, heavy_list: list[int], lanes: list[int]):
    """(lane, part, entries): the index entries of a task by part, repeated ones once. Long
    local lists go out under keys of their own, in pieces that each hold the list's smallest
    member. lanes[part] is the number that the partitioner sends to partition `part`."""
    heavy = np.sort(np.array(heavy_list, np.int64).view(U64))
    parts = len(lanes)

    def out(held):
        s, m = unique_pairs(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(s)))
        rank = np.arange(len(s)) - np.repeat(start, size)
        lead = m[np.repeat(start, size)]
        key = s.copy()
        move = np.repeat(size > LOCAL_LIST, size) & (rank > 0)
        key[move] = C.mix(s[move] ^ C.mix(lead[move].view(U64) + (rank[move] // SALT_ROWS).astype(U64)))
        extra = move & ((rank == 1) | (rank % SALT_ROWS == 0))
        key, s, m = np.concatenate([key, key[extra]]), np.concatenate([s, s[extra]]), np.concatenate([m, lead[extra]])
        part = (key % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, order[a:z]) for p, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if z > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lanes[p] for p, _ in rows], pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array([pack_entries(key[i], s[i], m[i], parts) for _, i in rows], pa.binary())], ["lane", "part", "entries"]
        )

    def run(batches):
        C.release_memory()
        held, rows = [], 0
        for whole in batches:
            for b in C.chunks(whole, "text"):
                r, g, n = shingle_sets(b, "text", rule)
                one = set_ids(r, g, b.num_rows)
                held.append(signatures(r, g, n, one.view(np.int64), rule, heavy))
                rows += len(held[-1][0])
                if rows > COMBINE_ROWS:
                    yield from out(held)
                    held, rows = [], 0
        if rows:
            yield from out(held)

    return run


def shared_lists(parts: int):
    """Of a partition's index entries, those whose list has two members or more, with the
    smallest of them."""

    def run(batches):
        held = [unpack_entries(raw.as_py(), part, parts) for b in batches for part, raw in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
        if not held:
            return
        key, sig, mem = (np.concatenate([x[i] for x in held]) for i in range(3))
        del held
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.zeros(len(k), bool)  # keys met once go before the full sort
        again[1:] = k[1:] == k[:-1]
        again[:-1] |= again[1:]
        order = order[again]
        key, sig, mem = key[order], sig[order], mem[order]
        order = np.lexsort((mem, key))
        key, sig, mem = key[order], sig[order], mem[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (mem[1:] != mem[:-1])
        key, sig, mem = key[new], sig[new], mem[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(key)))
        two = np.repeat(size > 1, size)
        lead = mem[np.repeat(start, size)]
        yield pa.RecordBatch.from_arrays([C.as_long(sig[two]), pa.array(mem[two], pa.int64()), pa.array(lead[two], pa.int64())], ["sig", "member", "leader"])

    return run


def lanes_of(spark, parts: int) -> list[int]:
    """For each partition of a hash partitioning by an int, a number that falls into it."""
    found: dict[int, int] = {}
    upto = 0
    while len(found) < parts:
        more = spark.range(upto, upto + 16 * parts).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("i").alias("i")).collect()
        for r in more:
            found.setdefault(r.p, r.i)
        upto += 16 * parts
    return [found[p] for p in range(parts)]


def parts_for(sized: DataFrame, rule: Rule, least: int) -> int:
    """So many index partitions that one holds about PART_ENTRIES entries, whatever the input."""
    step = F.floor(F.log2("n_shingles") * 4)  # sizes by quarter octaves: some hundred rows
    sizes = sized.filter("n_shingles > 0").groupBy(step).agg(F.max("n_shingles").alias("n"), F.count("*").alias("sets")).collect()
    band = lambda n: int(np.searchsorted(rule.low, n, side="right")) - 1
    entries = sum(int(rule.m[band(r.n)] + rule.m[band(r.n) + 1]) * r.sets for r in sizes)
    return max(1, least, -(-entries // PART_ENTRIES))


def texts_of(rule: Rule):
    """Keeps the rows whose text has the set id asked for (a doc_id may be repeated)."""

    def run(batches):
        for whole in batches:
            for b in C.chunks(whole, "text"):
                r, g, n = shingle_sets(b, "text", rule)
                one = set_ids(r, g, b.num_rows)
                keep = one.view(np.int64) == b.column(b.schema.get_field_index("member")).to_numpy()
                yield b.select(["member", "text"]).filter(pa.array(keep))

    return run


def linked_pairs(rule: Rule):
    """Verify candidate pairs (a, b, text_a, text_b) exactly."""

    def run(batches):
        for whole in batches:
            for half in C.chunks(whole, "text_a", C.CHUNK_BYTES // 2):
                for b in C.chunks(half, "text_b", C.CHUNK_BYTES // 2):
                    ra, ga, na = shingle_sets(b, "text_a", rule, 1)
                    rb, gb, nb = shingle_sets(b, "text_b", rule, 1)
                    r, g = np.concatenate([ra, rb]), np.concatenate([ga, gb])
                    order = np.lexsort((g, r))
                    r, g = r[order], g[order]
                    both = r[1:][(r[1:] == r[:-1]) & (g[1:] == g[:-1])]
                    inter = np.bincount(both, minlength=b.num_rows)
                    good = pa.array(100 * inter >= rule.percent * (na + nb - inter))
                    yield b.select(["a", "b"]).filter(good)

    return run


BLOCK_STRANGERS, STRANGER_TOKENS = 256, 100_000
BLOCK_MEMBERS, MEMBER_TOKENS = 1024, 400_000
COLUMNS = 4096
CLUSTER_BLOCKS = 16


def across_components(rest: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): components that a link joins. rest: (home, cluster, member, comp, n), the members
    of unfinished lists by the component of the list's smallest member and by the cluster of
    members that collisions connect.

    A cluster of at most CLUSTER_BLOCKS blocks is compared block by block. In a larger one,
    of two members in different components at least one is a stranger to the home, so blocks
    of strangers meet blocks of members. No pair of texts is ever a row."""
    own = lambda of: F.pmod(F.xxhash64("member"), of).cast("int")
    every = lambda upto: F.sequence(F.lit(0), upto - 1)
    block = lambda stranger, mb, ob: F.struct(F.lit(stranger).alias("stranger"), mb.alias("mb"), ob.alias("ob"))
    spread = lambda rows, blocks: rows.select("home", "member", "comp", F.explode(blocks).alias("x")).select("home", "member", "comp", "x.*")
    none = F.array().cast("array<struct<stranger:boolean,mb:int,ob:int>>")
    # each row meets its blocks in one explode, so that the plan reads and joins the rows once for each kind of cluster
    once = rest.select("cluster", "member", "comp", "n").distinct()
    blocks = once.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_STRANGERS, F.sum("n") / STRANGER_TOKENS)).cast("int").alias("nb"))
    fits = F.col("nb") <= CLUSTER_BLOCKS
    placed = once.join(blocks.filter(fits), "cluster").select(F.col("cluster").alias("home"), "member", "comp", "nb", own("nb").alias("mine"))
    mine = F.col("mine")
    later = F.transform(F.sequence(mine, F.col("nb") - 1), lambda ob: block(True, mine, ob))
    earlier = F.when(mine > 0, F.transform(every(F.greatest(mine, F.lit(1))), lambda mb: block(False, mb, mine))).otherwise(none)
    by_cluster = spread(placed, F.concat(later, earlier))
    rest = rest.join(blocks.filter(~fits), "cluster").select("home", "member", "comp", "n").distinct()
    count = rest.groupBy("home").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / MEMBER_TOKENS)).cast("int").alias("mbs"),
        F.ceil(F.greatest(F.count_if(F.col("comp") != F.col("home")) / BLOCK_STRANGERS, F.sum(F.when(F.col("comp") != F.col("home"), F.col("n"))) / STRANGER_TOKENS)).cast("int").alias("obs"),
    )
    sized = rest.join(count, "home").select("home", "member", "comp", "mbs", "obs", own("mbs").alias("mb"), own("obs").alias("ob"))
    as_member = F.transform(every(F.col("obs")), lambda ob: block(False, F.col("mb"), ob))
    as_stranger = F.when(F.col("comp") != F.col("home"), F.transform(every(F.col("mbs")), lambda mb: block(True, mb, F.col("ob")))).otherwise(none)
    # the ids of large clusters' homes can't meet those of small clusters: members differ
    work = spread(sized, F.concat(as_member, as_stranger)).union(by_cluster)

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        flag = np.asarray(rows["stranger"])
        comp = np.asarray(rows["comp"])
        if flag.all():  # one block with itself
            rows = pa.concat_tables([rows, rows]).combine_chunks()
            flag = np.repeat([True, False], len(flag))
            comp = np.concatenate([comp, comp])
        if flag.any():
            r, g, n = [], [], np.zeros(rows.num_rows, np.int64)
            at = 0
            for batch in rows.select(["text"]).to_batches():
                for b in C.chunks(batch, "text"):
                    rr, gg, nn = shingle_sets(b, "text", rule, 1)
                    r.append(rr + at)
                    g.append(gg)
                    n[at : at + b.num_rows] = nn
                    at += b.num_rows
            r, g = np.concatenate(r), np.concatenate(g)
            rank = np.cumsum(flag) - 1
            other = np.cumsum(~flag) - 1
            of = flag[r]
            tokens, col = np.unique(g[of], return_inverse=True)
            ra, rb, gb = rank[r[of]], other[r[~of]], g[~of]
            place = np.minimum(np.searchsorted(tokens, gb), len(tokens) - 1)
            hit = tokens[place] == gb
            rb, place = rb[hit], place[hit]
            inter = np.zeros((flag.sum(), (~flag).sum()), np.float32)
            oa, ob = np.argsort(col, kind="stable"), np.argsort(place, kind="stable")
            ra, ca, rb, cb = ra[oa], col[oa], rb[ob], place[ob]
            for c in range(0, len(tokens), COLUMNS):
                i, j = np.searchsorted(ca, [c, c + COLUMNS]), np.searchsorted(cb, [c, c + COLUMNS])
                left, right = (np.zeros((k, COLUMNS), np.float32) for k in inter.shape)
                left[ra[i[0] : i[1]], ca[i[0] : i[1]] - c] = 1
                right[rb[j[0] : j[1]], cb[j[0] : j[1]] - c] = 1
                inter += left @ right.T
            union = n[flag][:, None] + n[~flag][None, :] - inter
            x, y = np.nonzero((100 * inter >= rule.percent * union) & (comp[flag][:, None] != comp[~flag][None, :]))
            a, b = comp[flag][x], comp[~flag][y]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        else:
            pairs = np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return work.join(texts, "member").groupBy("home", "mb", "ob").applyInArrow(meet, "a long, b long").distinct()


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """docs (doc_id, text, any other columns) -> doc_id, n_shingles, set_id, component_id.

    component_id is the smallest doc_id reachable over links of Jaccard similarity of at
    least percent / 100 on word shingles. Only doc_id and text are read."""
    spark, rule = docs.sparkSession, Rule(width, percent, lower)
    scratch = C.Scratch(spark, "ngram-join")
    docs = docs.select("doc_id", "text")
    sized = scratch.keep(docs.mapInArrow(sizes_of(rule), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_id long, check_id long"))
    classes = sized.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("check_id").alias("c1"), F.max("check_id").alias("c2"), F.max("n_shingles").alias("n"))
    # sets of one id must agree in the other lane's id too, which rests on other word hashes
    if classes.filter("c1 <> c2").limit(1).count():
        raise RuntimeError("two different shingle sets share a 64-bit id; change the hash constants")
    heavy_from = max(HEAVY_LEAST, sized.count() // HEAVY_SHARE)
    heavy = [x.token for x in docs.mapInArrow(local_heavy(rule), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= heavy_from).orderBy(F.desc("n")).limit(20_000).collect()]
    lanes = lanes_of(spark, parts_for(sized, rule, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    entries = docs.mapInArrow(index_rows(rule, heavy, lanes), "lane int, part int, entries binary").repartition(len(lanes), "lane")
    lists = scratch.keep(entries.mapInArrow(shared_lists(len(lanes)), "sig long, member long, leader long"))
    scratch.sweep()  # here and below: lets Spark remove the files of shuffles that are over
    stars = lists.filter("member <> leader").select(F.col("leader").alias("a"), F.col("member").alias("b")).distinct()
    members = lists.select("member").distinct().join(classes.select(F.col("set_id").alias("member"), "rep"), "member")
    texts = scratch.keep(docs.join(members, docs.doc_id.eqNullSafe(members.rep)).select("member", "text").mapInArrow(texts_of(rule), "member long, text string").dropDuplicates(["member"]))
    scratch.sweep()

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("member").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("member").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(linked_pairs(rule), "a long, b long")

    links = scratch.keep(verified(stars))
    scratch.sweep()
    comp = scratch.keep(C.components(spark, links, scratch))
    scratch.drop(links)
    scratch.sweep()
    # lists that still hold several components: compare across them, in blocks
    named = lists.select("sig", "member").distinct().join(comp, F.col("member") == F.col("node"), "left").select("sig", "member", F.coalesce("component", "member").alias("comp"))
    open_lists = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "member").alias("home")).filter("lo <> hi").select("sig", "home")
    clusters = scratch.keep(C.components(spark, stars, scratch)).select(F.col("node").alias("member"), F.col("component").alias("cluster"))
    scratch.sweep()
    # written once: as a plan inside the comparison it would be planned again for each of its uses
    rest = scratch.keep(named.join(open_lists, "sig").select("home", "member", "comp").distinct().join(clusters, "member").join(classes.select(F.col("set_id").alias("member"), "n"), "member"))
    scratch.sweep()
    bridges = scratch.keep(across_components(rest, texts, rule))
    scratch.drop(texts)
    scratch.sweep()
    if bridges.limit(1).count():
        up = C.components(spark, bridges, scratch).select(F.col("node").alias("component"), F.col("component").alias("top"))
        ends = bridges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        known = comp.union(ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("component")))
        comp = known.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    final = classes.select("set_id", "rep").join(comp, F.col("set_id") == F.col("node"), "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("group"))
    least = final.groupBy("group").agg(F.min("rep").alias("component_id"))
    named_classes = final.join(least, "group").select(F.col("set_id").alias("class"), "component_id")
    keyed = sized.withColumn("class", F.when(F.col("n_shingles") > 0, F.col("set_id")))
    return keyed.join(named_classes, "class", "left").select("doc_id", "n_shingles", F.col("class").alias("set_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir):
    return ngram_jaccard_join(C.table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")
