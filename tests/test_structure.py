"""Footnotes and job queues against plain versions written for the test."""

import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reportloom.operators import footnotes as FN
from reportloom.operators import structure as ST
from reportloom.plans import structure
from reportloom.streaming import queue as JQ


# ------------------------------------------------------------------------ footnotes


def plain_targets(elements):
    """{(doc, ord): (number, marker, target)} of the footnotes, one document after the other."""
    out, docs = {}, {}
    for d, o, t, x in sorted(elements, key=lambda e: (str(e[0]), e[1])):
        docs.setdefault(d, []).append((o, t, x or ""))
    for d, body in docs.items():
        number = 0
        for at, (o, t, x) in enumerate(body):
            if t != "FOOTNOTE":
                continue
            number += 1
            m = re.match(r"\*?[0-9]+|\[[0-9]+\]|\(\*\)|\*", x)
            marker = re.sub(r"[^0-9]", "", m[0]) if m else ""
            n = marker or "[0-9]"
            shape = re.compile(rf"(?:[^\W\d_]{n}|\){n}|[0-9]{{4}}{n}|\[\s*{n}\s*\]|\(\s*{n}\s*\))(?:[.,;:]|\s|$)")
            near = [p for p, k, y in body[:at] if k != "FOOTNOTE" and o - p <= FN.REACH and shape.search(y)]
            any_ = [p for p, k, _ in body[:at] if k != "FOOTNOTE"]
            out[d, o] = (number, marker, near[-1] if near else any_[-1] if any_ else None)
    return out


def test_footnotes_against_plain_search(spark):
    g = random.Random(3)
    said = ["theo1, nguồn", "năm 20202;", "xem [ 3 ].", "(4) rồi", "số12", "không", "12345678 x", "a1b2.", "", None, "[1] và (2)\nx7", ")9"]
    notes = ["1 A", "[2] B", "*3. C", "(*) D", "* E", "Nguồn: F", "12 G\n- một\n\n- hai", "[9]: H", None]
    rows = []
    for d in (1, 2, None):
        for o in range(400 if d == 1 else 70):
            note = g.random() < (0.6 if o % 100 > 60 else 0.1)
            rows.append((d, o, "FOOTNOTE" if note else g.choice(["PARAGRAPH", "HEADING_1", None]), g.choice(notes if note else said)))
    rows += [(3, o, "FOOTNOTE", "1 x") for o in range(3)]  # no body at all
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, text string").withColumns({c: F.lit(1) for c in ("block", "number", "at", "marker", "d")}).repartition(3)
    got = {(r.doc_id, r.ord): (r.number, r.marker, r.target) for r in FN.footnotes(df).collect()}
    assert got == plain_targets(rows)
    assert FN.footnotes(df.limit(0)).count() == 0
    body = FN.anchored(df).collect()
    assert len(body) == sum(t != "FOOTNOTE" for _, _, t, _ in rows)
    assert sum(r.n_notes for r in body) == sum(t is not None for _, _, t in got.values())
    assert sum(len(re.findall(r"\[\^\d+\]", r.text)) for r in body) == sum(r.n_notes for r in body)


def test_long_documents_are_cut_in_blocks(spark, monkeypatch):
    """One document over many blocks gives what one block gives."""
    rows = [(1, o, "FOOTNOTE" if o % 97 > 90 or 300 < o < 380 else "PARAGRAPH", f"{o % 5} chữ{o % 4}.") for o in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, text string")
    want = plain_targets(rows)
    for size in (16, 1024):
        monkeypatch.setattr(FN, "BLOCK", size)
        assert {(r.doc_id, r.ord): (r.number, r.marker, r.target) for r in FN.footnotes(df).collect()} == want


def test_note_texts(spark):
    rows = [(1, 0, "PARAGRAPH", "Thu  **tăng**1, chi"), (1, 1, "FOOTNOTE", "1. Nguồn\n  - một \n\n- hai"), (1, 2, "FOOTNOTE", "(*)Ghi"), (1, 3, "FOOTNOTE", "x")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, text string")
    assert [r.text for r in FN.footnotes(df).orderBy("ord").collect()] == ["Nguồn\n- một\n- hai", "Ghi", "x"]
    assert [r.text for r in FN.anchored(df).collect()] == ["Thu tăng[^1], chi[^2][^3]"]


def test_markers_are_read_once_and_before_any_window(spark):
    """Texts that may carry a marker go straight from the elements to the join, each regex once."""
    df = spark.createDataFrame([(1, 0, "PARAGRAPH", "chữ1, năm 20203; [ 4 ] (55)."), (1, 1, None, None), (1, 2, "X", "không")], "doc_id long, ord int, type string, text string")
    got = {r.ord: r.m for r in df.select("ord", FN.carried_markers(F.col("text")).alias("m")).collect()}
    assert (sorted(got[0]), got[1], got[2]) == (["", "1", "3", "4", "55"], [], [])
    plan = df.select(FN.carried_markers(F.col("text")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4


def test_numbers_are_no_places_where_a_marker_stands_elsewhere(spark):
    """Tails of long numbers are places only where nothing else carries the marker."""
    texts = ["Thu 12341 tỷ1, chi.", "Thu 20201 tỷ, năm 20201; chi.", "Thu 12341 tỷ [ 1 ].", "Ngày 1/1/20201, số 55551.", "Thu 12341 tỷ."]
    rows = [x for i, t in enumerate(texts) for x in ((i, 0, "PARAGRAPH", t), (i, 1, "FOOTNOTE", "1. Nguồn"))]
    got = FN.anchored(spark.createDataFrame(rows, "doc_id long, ord int, type string, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["Thu 12341 tỷ[^1], chi.", "Thu 20201 tỷ, năm 2020[^1]; chi.", "Thu 12341 tỷ[^1].", "Ngày 1/1/2020[^1], số 55551.", "Thu 1234[^1] tỷ."]


# ------------------------------------------------------------------------ job queues


class Replay:
    """The queue's rules in plain Python: one list, no state store, no micro-batches."""

    def __init__(self, at_once, most, retained, retries, lease_ms):
        self.at_once, self.most, self.retained, self.retries, self.lease = at_once, most, retained, retries, lease_ms
        self.line, self.running, self.state, self.batches, self.log = [], {}, {}, {}, []

    def say(self, key, state, attempt, at):
        self.log.append((len(self.log), *key, state, attempt, at))

    def admit(self, at):
        while self.line and len(self.running) < self.at_once:
            key, attempt = self.line.pop(0)
            self.running[key] = (at, attempt)
            self.say(key, "PARSING", attempt, at)

    def finish(self, key, bad, at):
        _, attempt = self.running.pop(key)
        if bad and attempt <= self.retries:
            self.line.append((key, attempt + 1))
            self.say(key, "PENDING", attempt + 1, at)
        else:
            self.state[key] = "FAILED" if bad else "COMPLETED"
            self.say(key, self.state[key], attempt, at)
        self.admit(at)

    def leases(self, until):
        while self.running:
            key = min(self.running, key=lambda k: (self.running[k][0], k))
            if self.running[key][0] + self.lease > until:
                break
            self.finish(key, True, self.running[key][0] + self.lease)

    def done(self, batch):
        return all(self.state[k] in ("FAILED", "COMPLETED") for k in self.batches[batch])

    def event(self, at, kind, batch, job):
        self.leases(at)
        key = (batch, job)
        if kind == "SUBMIT":
            if job is None or key in self.state:
                return
            if batch not in self.batches:
                over = len(self.batches) - self.retained + 1
                for old in [b for b in self.batches if self.done(b)][: max(0, over)]:
                    for k in self.batches.pop(old):
                        del self.state[k]
                self.batches[batch] = []
            if len(self.batches[batch]) >= self.most:
                self.say(key, "REJECTED", 0, at)
                return
            self.batches[batch].append(key)
            self.state[key] = "PENDING"
            self.line.append((key, 1))
            self.say(key, "PENDING", 1, at)
            self.admit(at)
            return
        if job is None and self.running:
            key = min(self.running, key=lambda k: (self.running[k][0], k))
        if key in self.running:
            self.finish(key, kind == "ERROR", at)


def replay(events, limits):
    """Transitions by queue; leases that end before the last event of all end too, as the watermark says."""
    out, last = set(), max(e[4] for e in events)
    for q in {e[0] for e in events}:
        r = Replay(**limits)
        for _, batch, job, kind, at in sorted((e for e in events if e[0] == q), key=lambda e: (e[4], JQ.ORDER[e[3]], e[1], e[2] or "~")):
            r.event(at, kind, batch, job)
        r.leases(last - 1)
        out |= {(q, *x) for x in r.log}
    return out


LIMITS = {"at_once": 2, "most": 4, "retained": 3, "retries": 1, "lease_ms": 4000}


def some_events(n=260):
    g = random.Random(1)
    events, at = [], 0
    for i in range(n):
        at += g.choice([0, 1, 300, 2500])
        kind = g.choice(["SUBMIT", "SUBMIT", "DONE", "ERROR"])
        batch = f"b{i // 16}"
        job = f"j{g.randrange(8)}" if kind == "SUBMIT" or g.random() < 0.5 else None
        events.append((g.randrange(2), batch, job, kind, at))
    return events


def write(spark, rows, path):
    ts = F.timestamp_millis("ms")
    spark.createDataFrame(rows, "queue long, batch_id string, job_id string, kind string, ms long").withColumn("ts", ts).coalesce(1).write.mode("append").parquet(path)


def transitions(spark, at):
    return [(r.queue, r.number, r.batch_id, r.job_id, r.state, r.attempt, r.ms) for r in spark.read.parquet(f"{at}/out").withColumn("ms", F.unix_millis("ts")).collect()]


@pytest.mark.parametrize("parts", [1, 3])
def test_queue_restarts_where_it_stopped(spark, tmp_path, parts):
    """Run after each part of the input from one checkpoint: the same transitions as a replay of all."""
    events = some_events()
    own = JQ.state_session(spark)
    schema = "queue long, batch_id string, job_id string, kind string, ms long, ts timestamp"
    # a part starts after the one before it has ended: what comes later than that is late
    starts = [next(i for i in range(p * len(events) // parts, len(events)) if i == 0 or events[i][4] > events[i - 1][4]) for p in range(parts)]
    for a, z in zip(starts, [*starts[1:], len(events)], strict=True):
        write(spark, events[a:z], f"{tmp_path}/in")
        stream = own.readStream.schema(schema).parquet(f"{tmp_path}/in")
        JQ.run_queue(stream, f"{tmp_path}/out", f"{tmp_path}/check", **LIMITS)
    got = transitions(spark, tmp_path)
    want = replay(events, LIMITS)
    assert len(got) == len(set(got)) and set(got) == want
    kinds = {x[4] for x in want}
    assert kinds == {"PENDING", "PARSING", "COMPLETED", "FAILED", "REJECTED"}
    running = {}
    for q, _, b, j, state, _, _ in sorted(got):
        held = running.setdefault(q, set())
        held.add((b, j)) if state == "PARSING" else held.discard((b, j)) if state != "REJECTED" else None
        assert len(held) <= LIMITS["at_once"]
    states = {(r.queue, r.batch_id, r.job_id): r.state for r in JQ.queue_states(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert states == {x[0:1] + x[2:4]: x[4] for x in sorted(got)}


def test_job_queue_query(spark):
    """The registered query against the replay of the same events."""
    sf = "/root/testdata/sf0.001"
    try:
        raw = spark.read.parquet(f"{sf}/events.parquet")
    except Exception:
        pytest.skip("no test tables")
    rows = structure.made_jobs(raw).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).collect()
    want = replay([(r.queue, r.batch_id, r.job_id, r.kind, r.ms) for r in rows], structure.LIMITS)
    got = structure.job_queue(spark, sf).withColumn("ms", F.unix_millis("ts")).collect()
    assert {(r.queue, r.number, r.batch_id, r.job_id, r.state, r.attempt, r.ms) for r in got} == want and len(got) == len(want)


def test_queue_writes_its_state_once(spark):
    """Many jobs that come and go within a micro-batch cost no access to the store: what is left goes there."""
    calls = []

    class Store:
        def __init__(self):
            self.d = {}

        def __getattr__(self, name):
            acts = {"exists": lambda: bool(self.d), "get": lambda: self.d.get(()), "update": lambda v: self.d.update({(): v}), "updateValue": lambda k, v: self.d.update({k: v}), "getValue": self.d.get, "removeKey": lambda k: self.d.pop(k, None), "containsKey": lambda k: k in self.d, "iterator": lambda: iter(list(self.d.items()))}
            return lambda *x: (calls.append(name), acts[name](*x))[1]

    class Handle:
        def __init__(self):
            self.stores = {}

        def getMapState(self, name, *_):  # noqa: N802
            return self.stores.setdefault(name, Store())

        getValueState = getMapState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            calls.append("timer")

    events = [(0, f"b{i // 7}", f"j{i}", "SUBMIT", 10 * i) for i in range(2000)] + [(0, f"b{i // 7}", None, ("DONE", "ERROR")[i % 5 == 4], 10 * i + 5) for i in range(2000)]
    queue, handle, out = JQ.JobQueue(**LIMITS), Handle(), []
    queue.init(handle)
    frame = pd.DataFrame(sorted(events, key=lambda e: e[4]), columns=["queue", "batch_id", "job_id", "kind", "ms"])
    frame["ts"] = pd.to_datetime(frame["ms"], unit="ms")
    for part in (frame[:2500], frame[2500:]):  # two micro-batches
        out += list(queue.handleInputRows((0,), iter([part[:1000], part[1000:]]), None))
    got = {(int(r.queue), r.number, r.batch_id, r.job_id, r.state, r.attempt, int(r.ts.timestamp() * 1000 + 0.5)) for r in pd.concat(out).itertuples()}
    want = Replay(**LIMITS)
    for _, batch, job, kind, at in sorted(events, key=lambda e: e[4]):
        want.event(at, kind, batch, job)
    assert got == {(0, *x) for x in want.log}
    assert len(calls) < 1500 and calls.count("timer") <= 2
    assert {k[0] for k in handle.stores["batches"].d} == set(want.batches)


def test_queue_ignores_what_it_can_not_place(spark, tmp_path):
    rows = [(None, "b", "j", "SUBMIT", 1), (1, None, "j", "SUBMIT", 2), (1, "b", None, "SUBMIT", 3), (1, "b", "j", "BAD", 4), (1, "b", "x", "DONE", 5), (1, None, "j", "done", 6)]
    write(spark, rows, f"{tmp_path}/in")
    own = JQ.state_session(spark)
    stream = own.readStream.schema("queue long, batch_id string, job_id string, kind string, ms long, ts timestamp").parquet(f"{tmp_path}/in")
    JQ.run_queue(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(transitions(spark, tmp_path)) == [(1, 0, "", "j", "PENDING", 1, 2), (1, 1, "", "j", "PARSING", 1, 2), (1, 2, "", "j", "COMPLETED", 1, 6)]


# ------------------------------------------------------------------------ structure

REPORT = """ỦY BAN NHÂN DÂN
XÃ MINH
CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM
Số: 34/BC-UBND
Minh, ngày 15 tháng 12 năm 2025

BÁO CÁO
Kết quả hoạt động phong trào văn
hóa năm 2025

I. TÌNH HÌNH CHUNG VỀ PHONG
TRÀO
1. Đặc điểm tình hình
Xã được thành lập trên cơ sở sáp nhập diện tích tự nhiên
và quy mô dân số, tỷ lệ hộ cận
nghèo 2,9% thuộc TP.
Hồ Chí Minh theo đ/c.
Bí thư. Chú trọng
tập trung đầu tư.
- Tuyên truyền các tiêu
chuẩn văn hóa;
- Kiểm tra kỷ cương
(số liệu tạm)
2. Đánh giá
Ghi chú: Số liệu ước tính chưa gồm
nguồn vốn khác.
- từ tỉnh
(*) Lưu ý: nộp trước ngày 15/7.
7
hành chính.
PHẦN II
KIẾN NGHỊ
Nơi nhận:
- Như trên;
- Lưu: VT.
KT. CHỦ TỊCH
PHÓ CHỦ TỊCH
Nguyễn Văn A"""


def test_document_structure(spark):
    zones, body = ST.document_structure(spark.createDataFrame([(1, REPORT), (2, None), (3, "\n \n")], "doc_id long, text string"))
    z = {r.doc_id: r for r in zones.collect()}
    assert (z[1].superior, z[1].issuer, z[1].number, z[1].dated) == ("ỦY BAN NHÂN DÂN", "XÃ MINH", "Số: 34/BC-UBND", "Minh, ngày 15 tháng 12 năm 2025")
    assert z[1].subject == "Kết quả hoạt động phong trào văn hóa năm 2025" and z[1].recipients == ["Như trên", "Lưu: VT."]
    assert (z[1].signer_title, z[1].signer) == ("PHÓ CHỦ TỊCH", "Nguyễn Văn A") and z[2].title == z[3].title == "BÁO CÁO"
    got = [(r.type, r.text) for r in body.orderBy("doc_id", "ord").collect()]
    assert got == [
        ("HEADING_1", "I. TÌNH HÌNH CHUNG VỀ PHONG TRÀO"), ("HEADING_2", "1. Đặc điểm tình hình"),
        ("PARAGRAPH", "Xã được thành lập trên cơ sở sáp nhập diện tích tự nhiên và quy mô dân số, tỷ lệ hộ cận nghèo 2,9% thuộc TP. Hồ Chí Minh theo đ/c. Bí thư. Chú trọng tập trung đầu tư."),
        ("LIST_ITEM", "- Tuyên truyền các tiêu chuẩn văn hóa;"), ("LIST_ITEM", "- Kiểm tra kỷ cương hành chính."), ("SUB_NOTE", "(số liệu tạm)"),
        ("FOOTNOTE", "Ghi chú: Số liệu ước tính chưa gồm nguồn vốn khác.\n- từ tỉnh"), ("FOOTNOTE", "(*) Lưu ý: nộp trước ngày 15/7."), ("HEADING_2", "2. Đánh giá"), ("HEADING_1", "PHẦN II: KIẾN NGHỊ"),
    ]


def test_long_bodies_are_cut_in_blocks(spark, monkeypatch):
    """Blocks of a few lines give what one block gives, and what the steps give one after the other."""
    g = random.Random(7)
    said = ["I. MỤC", "PHẦN II", "2. Việc", "- mục;", "- mục", "(ghi)", "Ghi chú: A", "Câu đầy đủ.", "câu thường", "câu hỏi:", "ABC", "TP.", "Số 5.", "7 ngày", "12", "", "và hết.", "“nói.”", None, "x"]
    rows = [(d, o, g.choice(said)) for d in (1, None) for o in range(700)] + [(2, 5, "một dòng")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, line string").repartition(4)
    want = None
    for size in (10_000, 512, 13):
        monkeypatch.setattr(ST, "BLOCK", size)
        got = sorted(((str(r.doc_id), r.ord, r.type, r.text) for r in ST.stitched(df).collect()))
        assert want is None or got == want
        want = got
    assert [x[1] for x in want if x[0] == "1"] == list(range(sum(x[0] == "1" for x in want)))
    masks = {(r.doc_id, r.ord): r.m for r in df.filter("line is not null").select("doc_id", "ord", ST.mask(F.col("line")).alias("m")).collect()}
    _, out = ST.followed([masks[1, o] for d, o, t in rows if d == 1 and t is not None], ST.Entry())
    assert sum(1 for _, kind, _ in out if kind) == sum(x[0] == "1" for x in want)
    assert ST.stitched(df.limit(0)).count() == 0


def test_short_documents_meet_no_step_a_group(spark):
    """Documents of one block are stitched in one pass over sorted lines, without a group a document or
    block and without joins; the shuffle of the lines is the only one of theirs."""
    said = ["I. MỤC", "Ghi chú: A", "Ghi chú: B", "câu thường", "và hết.", "  x y.\t"]
    rows = [(d, o, said[(d * 5 + o * o) % 6]) for d in range(300) for o in range(d % 20)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, line string").repartition(4)
    got = sorted((r.doc_id, r.ord, r.type, r.text) for r in ST.stitched(df).collect())
    marked = df.withColumn("line", F.trim("line")).withColumn("mask", ST.mask(F.col("line"))).withColumn("ord", F.col("ord").cast("long"))
    assert got == sorted((r.doc_id, r.ord, r.type, r.text.strip()) for r in ST.stitched_in_blocks(marked.withColumn("line", F.regexp_replace("line", r"\t$", "")), "bigint").collect())
    b = pa.RecordBatch.from_pylist([{"doc_id": 1, "is_long": False, "mask": 0, "line": "x"}, {"doc_id": 2, "is_long": True, "mask": -1, "line": ""}, {"doc_id": 2, "is_long": False, "mask": 0, "line": "y"}])
    assert [r for x in ST.stitch_documents(iter([b])) for r in x.to_pylist()] == [{"doc_id": 1, "ord": 0, "type": "PARAGRAPH", "n": 1, "text": "x"}]
    assert [r for x in ST.lines_of_longer(iter([b])) for r in x.to_pylist()] == [{"doc_id": 2, "mask": 0, "line": "y"}]
    line = "a" * 20_000
    assert spark.range(1).select(ST.mask(F.lit(line)).alias("m")).first().m == spark.range(1).select(ST.mask(F.lit("aaa")).alias("m")).first().m


def test_block_functions_agree_with_steps():
    """The function of a run of lines, for every state, is what following the lines gives."""
    g = random.Random(2)
    masks = [None if g.random() < 0.1 else -1 if g.random() < 0.1 else sum(1 << i for i in range(len(ST.FEATURES)) if g.random() < 0.2) for _ in range(30)]
    entries = [ST.Entry(s, 0, -1 if s.waits == 1 else ST.CARRIED) for s in ST.all_states()]
    for n in (0, 1, 2, 5, 30):
        for e, after in zip(entries, ST.summed(masks[:n], entries), strict=True):
            want = ST.followed(masks[:n], e)[0]
            assert (after.state, after.n) == (want.state, want.n) and (want.state.waits == 0 or after.waits == want.waits)
