"""Operator 6: n-best SentencePiece segmentation and decoding.

A text is normalised by the model, then cut between characters that stand side by side in no
piece, where none can cross, so its piece lattice is a chain of small lattices. On each distinct one a forward Viterbi pass gives the best score of
every prefix; those scores are the exact heuristic of an A* search that runs backwards from
the end and so pops complete segmentations in falling score. The text's n best are merged
from the chain with a heap: only the n - 1 links with the least loss can take part.

A character without a piece of its own falls back to its byte pieces at a penalty (the least
score less 10), as the library's unigram mode does. Scores are the model's piece scores.
A place is expanded at most n times, which is exact under an exact
heuristic and bounds the search on texts with many equal segmentations. Which of several
segmentations of one score come first is unspecified but the same on every run.

Decoding maps ids back through a byte table, with byte pieces joined to characters.

Defined results: null and empty texts have no piece, one empty segmentation of score 0, and
decode to the empty text; fewer than n segmentations give a shorter list; repeated rows are
encoded alike.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁"
N_BEST = 4
PENALTY = 10.0
CACHE = 300_000
CACHE_CHARS = 8_000_000
TABLE = 0x250
MATRIX = 48
U64 = np.uint64


class Pieces:
    """A model's pieces and a bounded cache of solved lattices."""

    def __init__(self, path: str, n_best: int = N_BEST):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        size = self.sp.get_piece_size()
        self.piece: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = {}
        for i in range(size):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(p[3:-1], 16)]))
            elif self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.piece[p.replace(MARK, " ")] = (i, self.sp.get_score(i))
                self.bytes_of.append(p.replace(MARK, " ").encode())
        usual = [s for _, s in self.piece.values() if s > -1e8]
        self.floor = min(usual) - PENALTY
        self.longest = max(map(len, self.piece))
        # lengths of pieces by their first character: how far to look from it
        self.reach: dict[str, int] = {}
        self.back_reach: dict[str, int] = {}
        for p in self.piece:
            self.reach[p[0]] = max(self.reach.get(p[0], 0), len(p))
            self.back_reach[p[-1]] = max(self.back_reach.get(p[-1], 0), len(p))
        self.beside = np.zeros((TABLE, TABLE), bool)
        self.far_beside = set()
        for p in self.piece:
            for a, b in zip(map(ord, p), map(ord, p[1:]), strict=False):
                if a < TABLE and b < TABLE:
                    self.beside[a, b] = True
                else:
                    self.far_beside.add((a, b))
        self.unknown = self.sp.unk_id()
        self.reach_table = np.array([self.reach.get(chr(c), 0) for c in range(TABLE)] + [self.longest])
        names = sorted((p for p in self.piece if len(p) <= MATRIX), key=len)
        keys, ids = [], []
        for n in sorted(set(map(len, names))):
            own = [p for p in names if len(p) == n]
            keys.append(self.substring_keys(self.running(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)), 0, n))
            ids += own
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise RuntimeError("two pieces share a key")
        self.key_id = np.array([self.piece[p][0] for p in ids])[order]
        self.key_score = np.array([self.piece[p][1] for p in ids])[order]
        self.forget()

    def forget(self):
        self.slot: dict[int, int] = {}
        self.text: list[str] = []
        self.held = 0
        self.score = np.zeros(0)
        self.loss = np.zeros(0)
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.more: dict[int, list] = {}

    def fallback(self, c: str) -> tuple[int, ...]:
        if not self.byte_id:
            return (self.unknown,)
        return tuple(self.byte_id[b] for b in c.encode())

    def edges(self, s: str, i: int):
        """(end, ids, score) of the pieces that start at i."""
        get = self.piece.get
        alone = False
        for j in range(i + 1, min(len(s), i + self.reach.get(s[i], 0)) + 1):
            p = get(s[i:j])
            if p:
                alone |= j == i + 1
                yield j, p[0], p[1]
        if not alone:
            yield i + 1, None, self.floor

    def forward(self, s: str):
        """Best and second-best score of each prefix, and the last piece of the best."""
        n = len(s)
        low = -1e300
        best, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        get, reach = self.piece.get, self.reach
        for i in range(n):
            b, b2 = best[i], second[i]
            alone = False
            for j in range(i + 1, min(n, i + reach.get(s[i], 0)) + 1):
                p = get(s[i:j])
                if p is None:
                    continue
                if j == i + 1:
                    alone = True
                x = b + p[1]
                if x > best[j]:
                    second[j], best[j], back[j] = max(best[j], b2 + p[1]), x, (i, p[0])
                else:
                    y = max(x, b2 + p[1])
                    if y > second[j]:
                        second[j] = y
            if not alone:
                j, x = i + 1, b + self.floor
                if x > best[j]:
                    second[j], best[j], back[j] = max(best[j], b2 + self.floor), x, (i, None)
                else:
                    y = max(x, b2 + self.floor)
                    if y > second[j]:
                        second[j] = y
        return best, second, back

    def solve(self, s: str) -> tuple[list[int], float, float]:
        """The best ids, their score, and what the second best loses."""
        best, second, back = self.forward(s)
        ids, j = [], len(s)
        while j:
            i, p = back[j]
            ids.extend([p] if p is not None else reversed(self.fallback(s[i])))
            j = i
        return ids[::-1], best[-1], (best[-1] - second[-1] if second[-1] > -1e299 else np.inf)

    def substring_keys(self, sums: np.ndarray, i: int, j: int) -> np.ndarray:
        """Keys of the characters i to j of each row, from running sums."""
        return (sums[:, j] - sums[:, i]) * C.powers(MATRIX + 1)[1][i] + U64((j - i) * 0xD6E8FEB86659FD93 % 2**64)

    def running(self, points: np.ndarray) -> np.ndarray:
        sums = np.zeros((points.shape[0], points.shape[1] + 1), U64)
        np.cumsum((points.astype(U64) + U64(1)) * C.powers(MATRIX + 1)[0][: points.shape[1]], axis=1, out=sums[:, 1:])
        return sums

    def solve_many(self, texts: list[str]):
        """solve() for each text, a matrix of texts of one length at a time."""
        out: list = [None] * len(texts)
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        for n, which in by_length.items():
            if n > MATRIX or len(which) < 8:
                for i in which:
                    out[i] = self.solve(texts[i])
                continue
            points = np.frombuffer("".join(texts[i] for i in which).encode("utf-32-le"), np.uint32).reshape(-1, n)
            w = len(which)
            sums = self.running(points)
            best, second = np.full((n + 1, w), -1e300), np.full((n + 1, w), -1e300)
            came, piece = np.zeros((n + 1, w), np.int64), np.full((n + 1, w), -1, np.int64)
            best[0] = 0
            reach = self.reach_table[np.minimum(points, TABLE)]
            for i in range(n):
                alone = np.zeros(w, bool)
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    far = np.flatnonzero(reach[:, i] >= j - i)
                    if not len(far):
                        break
                    key = self.substring_keys(sums[far], i, j)
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[at] == key
                    far, at = far[hit], at[hit]
                    if j == i + 1:
                        alone[far] = True
                    self.step(best, second, came, piece, i, j, far, self.key_score[at], self.key_id[at])
                lone = np.flatnonzero(~alone)
                if len(lone):
                    self.step(best, second, came, piece, i, i + 1, lone, np.full(len(lone), self.floor), np.full(len(lone), -1))
            rows = np.arange(w)
            ids, used, at, broken = np.full((n, w), -1, np.int64), np.zeros((n, w), bool), np.full(w, n), np.zeros(w, bool)
            for k in range(n - 1, -1, -1):
                live = at > 0
                ids[k, live] = piece[at[live], rows[live]]
                used[k] = live
                broken |= live & (ids[k] < 0)
                at = np.where(live, came[at, rows], 0)
            loss = np.where(second[n] > -1e299, best[n] - second[n], np.inf)
            flat, size = ids.T[used.T], used.sum(0)
            cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
            flat = flat.tolist()
            for r, i in enumerate(which):
                out[i] = self.solve(texts[i]) if broken[r] else (flat[cuts[r] : cuts[r + 1]], best[n, r], loss[r])
        return out

    @staticmethod
    def step(best, second, came, piece, i, j, rows, score, ids):
        """Relax the edges i -> j of the given rows."""
        x, y = best[i, rows] + score, second[i, rows] + score
        b, b2 = best[j, rows], second[j, rows]
        up = x > b
        second[j, rows] = np.maximum(np.where(up, b, np.maximum(x, b2)), y)
        best[j, rows] = np.where(up, x, b)
        came[j, rows] = np.where(up, i, came[j, rows])
        piece[j, rows] = np.where(up, ids, piece[j, rows])

    def endings(self, s: str, j: int):
        """(start, id, score) of the pieces that end at j."""
        get = self.piece.get
        alone = False
        for i in range(j - 1, max(0, j - self.back_reach.get(s[j - 1], 0)) - 1, -1):
            p = get(s[i:j])
            if p:
                alone |= i == j - 1
                yield i, p[0], p[1]
        if not alone:
            yield j - 1, None, self.floor

    def a_star(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, searched backwards with exact forward scores.

        The first n visits to a place bring its n best tails, so later ones are dropped; of
        equal scores the smaller place goes first, so ties are walked to their end one by one.
        At most n visits a place bound the search on any text."""
        best, _, _ = self.forward(s)
        visits: dict[int, int] = {}
        # an entry: -(score of the tail + best score of the rest), place, order, tail score, tail
        heap, tick, out = [(-best[-1], len(s), 0, 0.0, None)], 0, []
        while heap and len(out) < n:
            _, j, _, tail, path = heapq.heappop(heap)
            if not j:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((tail, tuple(ids)))
                continue
            visits[j] = visits.get(j, 0) + 1
            if visits[j] > n:
                continue
            for i, p, x in self.endings(s, j):
                tick += 1
                ids = (p,) if p is not None else self.fallback(s[i])
                heapq.heappush(heap, (-(tail + x + best[i]), i, tick, tail + x, (ids, path)))
        return out

    def links(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and row of each link of the chains: a cut stands between two characters
        that stand side by side in no piece."""
        cut = np.zeros(len(points), bool)
        a, b = points[:-1], points[1:]
        near = (a < TABLE) & (b < TABLE)
        cut[1:] = ~self.beside[np.where(near, a, 0), np.where(near, b, 0)]
        for i in np.flatnonzero(~near).tolist():
            cut[i + 1] = (int(a[i]), int(b[i])) not in self.far_beside
        cut[off[:-1][off[1:] > off[:-1]]] = True
        s = np.flatnonzero(cut)
        return s, np.searchsorted(off, s, side="right") - 1

    def slots(self, whole: str, data: np.ndarray, s: np.ndarray) -> np.ndarray:
        e = np.append(s[1:], len(data))
        key = C.word_hashes(data.view(np.uint8), 4 * s, 4 * e)
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.slot) + len(uniq) > CACHE or self.held > CACHE_CHARS:
            self.forget()
        get = self.slot.get
        slot = np.fromiter((get(k, -1) for k in uniq.tolist()), np.int64, len(uniq))
        new = np.flatnonzero(slot < 0)
        if len(new):
            texts = [whole[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            got = self.solve_many(texts)
            base = len(self.text)
            self.text += texts
            self.held += sum(map(len, texts))
            sizes = np.array([len(g[0]) for g in got], np.int64)
            self.flat = np.concatenate([self.flat, np.array([i for g in got for i in g[0]], np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.score = np.concatenate([self.score, [g[1] for g in got]])
            self.loss = np.concatenate([self.loss, [g[2] for g in got]])
            slot[new] = base + np.arange(len(new))
            self.slot.update(zip(uniq[new].tolist(), slot[new].tolist(), strict=True))
        slot = slot[back]
        # the links tile the chunk, so their cached texts, joined, must be the chunk itself
        if "".join(map(self.text.__getitem__, slot.tolist())) != whole:
            raise RuntimeError("two words share a 64-bit key")
        return slot

    def options(self, slot: int) -> list[tuple[float, tuple[int, ...]]]:
        if slot not in self.more:
            self.more[slot] = self.a_star(self.text[slot], self.n_best)
        return self.more[slot]

    def merge(self, slots: np.ndarray) -> list[tuple[float, list[tuple[int, int]]]]:
        """The n best of a chain: score, and (link, option) where it leaves the best."""
        total = float(self.score[slots].sum())
        loss = self.loss[slots]
        k = min(self.n_best - 1, len(loss))
        near = np.argpartition(loss, k - 1)[:k] if k else []
        near = sorted((x for x in near if np.isfinite(loss[x])), key=lambda x: (loss[x], x))
        lists = [self.options(int(slots[x])) for x in near]
        heap, seen, out = [(0.0, (0,) * len(near))], set(), []
        while heap and len(out) < self.n_best:
            lost, state = heapq.heappop(heap)
            out.append((total - lost, [(int(x), r) for x, r in zip(near, state, strict=True) if r]))
            for i, r in enumerate(state):
                if r + 1 < len(lists[i]):
                    to = (*state[:i], r + 1, *state[i + 1 :])
                    if to not in seen:
                        seen.add(to)
                        heapq.heappush(heap, (sum(lists[q][0][0] - lists[q][v][0] for q, v in enumerate(to)), to))
        return out

    def segmentations(self, texts: list[str | None]):
        """For each text its n best (score, ids), best first."""
        norm = [self.sp.normalize(t).replace(MARK, " ") if t else "" for t in texts]
        whole = "".join(norm)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for t in norm], dtype=np.int64)])
        s, row = self.links(points, off) if len(points) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        slots = self.slots(whole, points, s) if len(s) else np.zeros(0, np.int64)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            mine = slots[a:z]
            if not len(mine):
                yield [(0.0, np.zeros(0, np.int32))]
                continue
            lo, size = self.at[mine], self.at[mine + 1] - self.at[mine]
            ends = np.cumsum(size)
            ids = self.flat[np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)]
            out = []
            for score, changes in self.merge(mine):
                if not changes:
                    out.append((score, ids))
                    continue
                parts, at = [], 0
                for x, r in sorted(changes):
                    parts += [ids[at : ends[x] - size[x]], np.array(self.options(int(mine[x]))[r][1], np.int32)]
                    at = ends[x]
                out.append((score, np.concatenate([*parts, ids[at:]])))
            yield out

    def decode(self, ids) -> str:
        """The text of piece ids, without the dummy space before the first word."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


_MODELS: dict[tuple[str, int], Pieces] = {}
C.HELD["nbest"] = _MODELS.clear


def model(path: str, n_best: int) -> Pieces:
    if (path, n_best) not in _MODELS:
        _MODELS[path, n_best] = Pieces(path, n_best)
    return _MODELS[path, n_best]


def encoded(path: str, n_best: int, digest: bool):
    def run(batches):
        C.release_memory("nbest")
        m = model(path, n_best)
        for whole in batches:
            for b in C.chunks(whole, "text", C.CHUNK_BYTES // 2):
                texts = b.column(1).to_pylist()
                rows, out = [], []
                for i, (t, got) in enumerate(zip(texts, m.segmentations(texts), strict=True)):
                    best = got[0][1]
                    if digest:
                        out.append((len(best), [x for x, _ in got], [zlib.crc32(y.astype("<u4").tobytes()) for _, y in got], m.decode(best) == (t or "")))
                        continue
                    for r, (x, y) in enumerate(got):
                        rows.append(i)
                        out.append((r, x, y))
                if digest:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64())), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.bool_())], ["doc_id", "n_pieces", "scores", "ids_crc32", "round_trip"])
                elif rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["doc_id", "rank", "score", "ids"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def nbest_segmentations(docs: DataFrame, path: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """docs (doc_id, text, any others) -> doc_id, rank, score, ids: each text's n best."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded(path or default_model(), n_best, False), f"doc_id {kind}, rank int, score double, ids array<int>")


def nbest_digests(docs: DataFrame, path: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """One row a document: pieces of the best, scores and id checksums of the n best, and
    whether the best decodes to the text itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded(path or default_model(), n_best, True), f"doc_id {kind}, n_pieces long, scores array<double>, ids_crc32 array<long>, round_trip boolean")


def query(spark, sf_dir):
    return nbest_digests(C.table(spark, sf_dir, "documents"))
