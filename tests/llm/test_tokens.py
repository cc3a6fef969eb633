"""Alignment, packing and resampling against plain versions; cuts of texts against whole texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportloom.llm import common as C
from reportloom.llm import op5_token_files as op5
from reportloom.llm import op11_alignment as op11
from reportloom.llm import op12_packing as op12
from reportloom.llm import op13_resampling as op13

from .test_operators import TEXTS

P = pytest.importorskip("public_tokenizers")
A, B, WORDS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
WHITE = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SAID = [*"abcXY12.,-()<|>_'", "é", "ü", "日", "́", "̸", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", "</s>", "\0", "🙂", ";\r", " the", "ing", *WHITE, *[" "] * 12, *["\n"] * 4]


def fuzz(n, seed, longest=20, more=()):
    g = np.random.default_rng(seed)
    said = [*SAID, *more]
    return ["".join(said[k] for k in g.integers(0, len(said), g.integers(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "a b"), (30, "日本" * 2000), (31, " "), (32, "\n"), (33, "U+2581 ▁ here"), (34, "a\xa0 b"), *((100 + i, t) for i, t in enumerate(fuzz(400, 1, more=["▁"])))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("block", "idx", "groups", "segs", "n_a", "piece_id", "ids", "length", "loss", "grp", "b", "n_words", "fits", "tie", "part", "score", "rank", "weight", "_n", "_w")
    return df.withColumns({c: F.lit(7) for c in clash}).repartition(3)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_any_text_match_the_library(name):
    """Cuts beside all white space of Unicode, added tokens, contractions and combining marks."""
    enc = op5.Encoder(P.path(name))
    texts = fuzz(20_000, 3, 16) + ["foo \xa0 \xa0 bar", "a　 b", "x  y"]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        ids, n = enc(*C.text_bytes(pa.array(some)))
        want = [e.ids for e in enc.tok.encode_batch_fast(some, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


# ------------------------------------------------------------------------ alignment


def whole_alignments(rows):
    """Both tokenizers on whole texts, groups between common ends, and counts over all documents."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    said_a = lambda i: bytes(byte_of[c] for c in tok.id_to_token(i))
    said_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found, n_docs = [], Counter()
    for k, t in rows:
        links, groups, a, b = Counter(), [], [], []
        if t:
            a, b, want = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
            xa, xb = [said_a(i) for i in a], [said_b(i) for i in b]
            if b"".join(xa) != want or b"".join(xb) != want:
                a, b = [], []
            ends = [np.cumsum([len(x) for x in y]).tolist() for y in (xa, xb)] if a else [[], []]
            low = 0
            for z in sorted(set(ends[0]) & set(ends[1])):
                ga, gb = ([i for i, e in zip(ids, at, strict=True) if low < e <= z] for ids, at in ((a, ends[0]), (b, ends[1]))) if len(a) < 300 else (None, None)
                if ga is None:
                    break
                groups.append((ga, gb))
                low = z
            if a and not groups:  # long texts: the same by walking along both
                groups = walked(a, b, *ends)
            for ga, gb in groups:
                links.update((x, y) for x in ga for y in gb)
        for p in links:
            n_docs[p] += 1
        found.append((k, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in n_docs.items():
        best[x] = max(best[x], n)
    out = Counter()
    for k, na, nb, groups, links in found:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[k, na, nb, len(groups), sum(links.values()), sum(n for p, n in links.items() if n_docs[p] == best[p[0]]), sum(n * n_docs[p] for p, n in links.items()), shown] += 1
    return out


def walked(a, b, ends_a, ends_b):
    out, i, j = [], 0, 0
    for z in sorted(set(ends_a) & set(ends_b)):
        ga, gb = [], []
        while i < len(a) and ends_a[i] <= z:
            ga.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= z:
            gb.append(b[j])
            j += 1
        out.append((ga, gb))
    return out


@pytest.mark.parametrize("block", [2000, 12 << 20])
def test_alignment(spark, docs, monkeypatch, block):
    monkeypatch.setattr(op11, "BLOCK_BYTES", block)
    rows = rows_of(docs)
    want = whole_alignments(rows)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in op11.align_documents(docs, A, B).collect())
    assert got == want
    assert sum(n for k, n in want.items() if k[1] == 0 and k[7] == "") > 5
    digests = Counter((r.doc_id, r.groups_sha256) for r in op11.align_documents(docs, A, B, digest=True).select("doc_id", "groups_sha256").collect())
    assert digests == Counter((k[0], hashlib.sha256(k[7].encode()).hexdigest() if k[7] else "") for k in want.elements())


def test_alignment_of_nothing(docs):
    assert op11.align_documents(docs.limit(0), A, B).count() == 0
    assert {r.n_a for r in op11.align_documents(docs.filter("text is null or text = ''"), A, B).collect()} == {0}


def test_only_verified_characters_cut():
    m = op11.models(A, B)
    assert m.starts == [32, 10] and not m.parts(13) and not m.parts(ord("a"))
    data, off = C.text_bytes(pa.array([" a b", " c\xa0 d  e", ""]))
    s, e = m.cuts(data, off)
    assert [data[x:y].tobytes().decode() for x, y in zip(s, e, strict=True)] == [" a", " b", " c\xa0 d", "  e"]


# ------------------------------------------------------------------------ packing


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    scratch = C.Scratch(spark, "t")
    tokens = op12.token_table(docs, WORDS, 1, scratch, most=256)
    limits = op12.Limits(256, 8, 256)
    placed = op12.pack(tokens.drop("ids"), limits)
    out = placed.collect()
    ids = {r.piece_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.collect()}
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens, tuple(ids[r.piece_id])))
    want = defaultdict(list)
    for k, t in rows_of(docs):
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[k] += [(s, len(x[s : s + 256]), len(x), tuple(x[s : s + 256])) for s in range(0, len(x), 256)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length, r.loss))
    for parts in held.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
        assert sum(p[1] for p in parts) <= 256 and len(parts) <= 8 and sum(p[2] for p in parts) <= 256
    whole = {r.sequence_id: r for r in op12.sequences(placed, tokens).collect()}
    for q, parts in held.items():
        assert whole[q].n_tokens == sum(p[1] for p in parts) == len(whole[q].ids) // 4 and whole[q].n_segments == len(parts)
    assert op12.pack(op12.token_table(docs.limit(0), WORDS, 1, scratch)).count() == 0
    again = {(r.piece_id, r.sequence_id, r.offset) for r in op12.pack(tokens.drop("ids").repartition(5), limits).collect()}
    assert again == {(r.piece_id, r.sequence_id, r.offset) for r in out}  # wherever the rows come from


def plain_placing(sizes, limits):
    """Dot-product packing item by item, without classes."""
    share = sizes / limits
    weight = share.mean(0)
    left, out = set(range(len(sizes))), [None] * len(sizes)
    order = {i: tuple(sizes[i]) for i in left}
    bins = 0
    while left:
        room, held = limits.copy(), 0
        while True:
            fit = [i for i in left if (sizes[i] <= room).all()]
            if not fit:
                break
            best = max(fit, key=lambda i: (round(float((share[i] * weight * (room / limits)).sum()), 9), [-x for x in order[i]], -i))
            out[best] = (bins, held)
            room = room - sizes[best]
            held += 1
            left.remove(best)
        bins += 1
    return out, bins


def test_placing_under_three_limits():
    g = np.random.default_rng(3)
    n = g.integers(1, 60, 300)
    sizes = np.stack([n, np.ones_like(n), np.minimum(n * g.random(300), 40).astype(np.int64)], 1)
    limits = np.array([100, 5, 40])
    seq, at = op12.place(sizes, limits)
    _, bins = plain_placing(sizes, limits)
    assert abs(int(seq.max()) + 1 - bins) <= 1
    for s in range(int(seq.max()) + 1):
        assert (sizes[seq == s].sum(0) <= limits).all() and sorted(at[seq == s]) == list(range(int((seq == s).sum())))
    least = max(math.ceil(x) for x in sizes.sum(0) / limits)
    assert int(seq.max()) + 1 <= 1.2 * least
    with pytest.raises(ValueError):
        op12.place(np.array([[101, 1, 1]]), limits)
    assert [x.tolist() for x in op12.place(np.zeros((0, 3), np.int64), limits)] == [[], []]


def test_instruction_data(spark):
    """A conversation is one item; only the answers bear loss, which has a limit of its own."""
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (c % 7 + 1)) for c in range(40) for t in range(c % 5 + 1)] + [(99, 0, None, None), (98, 0, "assistant", "word " * 900)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    n = lambda x: len(tok.encode(x or "", add_special_tokens=False).ids) + 1
    items = op12.conversation_items(df, WORDS, 1, C.Scratch(spark, "t"), most=256)
    got = defaultdict(lambda: [0, 0, 0])
    for r in items.collect():
        got[r.doc_id][0] += r.length
        got[r.doc_id][1] += r.loss
        got[r.doc_id][2] += 1
        assert 0 < r.length <= 256 and 0 <= r.loss <= r.length
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        total = sum(n(t[3]) for t in own)
        assert got[c] == [total, sum(n(t[3]) for t in own if t[2] == "assistant"), -(-total // 256)]
    packed = op12.pack(items, op12.Limits(256, 6, 256)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss").alias("loss")).collect()
    assert all(r.n <= 256 and r.k <= 6 and r.loss <= 256 for r in packed)


# ------------------------------------------------------------------------ resampling


def plain_resampling(rows, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    small = {i: i + 32 for i in range(65, 91)}

    def features(t):
        w = word.findall((t or "").translate(small))
        return w, [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    found = [(k, *features(t)) for k, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in range(10_000)]
    out = []
    for k, w, f in found:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(fit[: 25 * len(fit) // 100]):
        x[4] = i + 1
    return Counter(tuple(x[:5]) for x in out)


def test_resampling(spark, docs):
    g = np.random.default_rng(8)
    more = spark.createDataFrame([(1000 + i, " ".join(TEXTS[16].split()[i : i + int(g.integers(15, 60))])) for i in range(120)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more).repartition(4)
    target = spark.createDataFrame([(1, TEXTS[10]), (2, None), (3, "É a Ünï 12x")], "item_id long, text string")
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in op13.resample(df, target).collect())
    assert got == plain_resampling(rows_of(df), [r.text for r in target.collect()])
    assert op13.resample(docs, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert op13.resample(df.limit(0), target).count() == 0
    nothing = op13.resample(df.filter("doc_id < 3"), target.limit(0)).collect()
    assert {(r.n_features, r.weight, r.rank) for r in nothing} == {(0, 0, None)}


def test_resampling_sql(spark):
    """The query against its SQL on whole tables."""
    import os

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = Counter(c.execute(op13.ORACLE_SQL).fetchall())
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in op13.query(spark, sf).collect()) == want


def test_held_models_are_freed_by_other_operators():
    """A reused worker keeps an operator's model for that operator's tasks alone."""
    from reportloom.llm import common as C
    from reportloom.llm import op6_nbest

    op6_nbest._MODELS["x", 1] = object()
    C.release_memory("nbest")
    assert ("x", 1) in op6_nbest._MODELS
    C.release_memory()
    assert not op6_nbest._MODELS
