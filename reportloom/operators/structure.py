"""Structure of administrative documents: body elements stitched from broken lines (V5, V12, X11) and
the zones around them.

Stitching is an automaton over lines. What it remembers is finite: the kind of the last element, how
its last line ends, whether it is inside a footnote, and whether an unfinished sentence waits in the
last element or an earlier one. So a run of lines is a function from state to state, and runs combine:
documents are cut into blocks of BLOCK lines; of documents with several blocks each block is first
summed up as that function (entry states that have met are followed once), the functions are applied
one after the other (one small row a block), and then every block is stitched from its own entry state.
A document of any length is thus spread over many tasks; those of a single block, nearly all, are stitched
whole in one pass over lines sorted by document, so they meet one shuffle and no step a group.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import footnotes as FN

BLOCK = 512
# fixed values: how lines begin and end
UPPER = r"A-Z\x{C0}-\x{1EF8}\p{Lu}"
ANY_LETTER = r"A-Z\x{C0}-\x{1EF8}a-z\x{E0}-\x{1EF9}"
STARTS = {
    "h1": rf"^(?i:I|II|III|IV|V|VI|VII|VIII|IX|X)\.|^(?iu:PHẦN|MỤC)\s+(?:(?iu:THỨ)\s+)?[{ANY_LETTER}\d]+|^[A-Z]\.\s+[{UPPER}]",
    "h2": rf"^\d+(?:\s*\.\s*\d+)*[.)]\s+[{UPPER}]",
    "item": r"^[-*•+]|^[A-Za-zđĐ]\)\s+",
    "sub": r"^\([^)]+\)$",
    "note": rf"^(?:\*?\s*(?:Ghi chú|Chú thích|Nguồn|Lưu ý)\s*:|\(\*\)|\(\d+\)\s+|\[\d+\]|[*†‡]\s*(?:Bảng|Nguồn|Số liệu|Ghi chú)|[1-9]\d?(?:\s*[-–—]\s*|\s+)[{UPPER}])",
    "lower": r"^\p{Ll}",
    "goes_on": r"^(?:[\p{Ll},;)\]”’]|[-–—]\s+[a-zà-ỹ\p{Ll}])",
    "of": r"^(?iu:và|về|của|trong|tại|theo|giai đoạn)(?![0-9A-Za-z_])",
    "bullet": r"^[-*•+]",
    "digit": r"^\d",
    "section": rf"^(?iu:PHẦN|MỤC)\s+(?:(?iu:THỨ)\s+)?[{ANY_LETTER}\d]+$",
}
ENDS = {"head": r"[.:!?]$", "stop": "[.:!?][\"'”’]?$", "list": r"[.;!?]$", "short": r"(?iu:TP|Tx|Tt|Ths|Bs|Gs|TS|PGS|K/g|Đ/c|Đc|v\.v|v\.v\.|NĐ-CP|QĐ-UBND|BC-UBND|TTr-UBND|CV-UBND|Số)\.$", "number": r"\d\.$"}
#: More than the longest end that the patterns look for.
END_CHARS = 16
PAGE_LINE = r"^(?i:---\s*PAGE\s+\d+\s*---)$|^\d{1,3}$"
MOTTO = r"^(?iu:CỘNG\s*HÒA\s*XÃ\s*HỘI|CỘNGHÒAXÃHỘI|Độc\s*lập\s*-\s*Tự\s*do|Độc\s*lập\s*–\s*Tự\s*do|Độclập-Tựdo|UBND|Số:)"
FEATURES = [*STARTS, "upper", *ENDS]
KINDS = ["HEADING_1", "HEADING_2", "LIST_ITEM", "PARAGRAPH", "SUB_NOTE", "FOOTNOTE"]


class State(NamedTuple):
    kind: str = ""  # of the last element
    ends: frozenset = frozenset()  # how its last line ends
    section: bool = False  # it is nothing but a section's number
    inside: bool = False  # inside a footnote
    waits: int = 0  # an unfinished sentence: 0 none, 1 in the last element, 2 in an earlier one
    stopped: bool = False  # an earlier one that ends a sentence after all


@lru_cache(maxsize=200_000)
def step(s: State, line: frozenset | None) -> tuple[State, str, str]:
    """The state after a line (its features; None for a page's edge), what becomes of the line (a kind:
    it begins an element; `last`, `waiting`: it goes on there; ``: nothing) and what stands before it."""
    if line is None:
        return s._replace(inside=False), "", ""
    heading = not line.isdisjoint(("h1", "h2"))
    plain = not heading and line.isdisjoint(("item", "sub", "note"))
    ends = line & frozenset(ENDS)
    kind = "HEADING_1" if "h1" in line else "HEADING_2" if "h2" in line else "LIST_ITEM" if "item" in line else "PARAGRAPH"
    inside = s.inside and not heading
    left = (2, "stop" in s.ends) if s.waits == 1 else (s.waits, s.stopped)  # once another element is the last
    if "sub" in line or "note" in line:
        kind = "SUB_NOTE" if "sub" in line else "FOOTNOTE"
        return State(kind, ends, False, kind == "FOOTNOTE", *left), kind, ""
    if inside and s.kind == "FOOTNOTE":
        apart = "bullet" in line or ("list" in s.ends and "lower" not in line)
        return s._replace(ends=ends, inside=True), "last", "\n" if apart else " "
    s = s._replace(inside=inside)
    open_ = s.waits and not ("stop" in s.ends if s.waits == 1 else s.stopped)
    if not inside and open_ and "lower" in line and plain:
        grown = s._replace(ends=ends) if s.waits == 1 else s
        return grown._replace(waits=0 if "stop" in ends else s.waits, stopped=False), "waiting", " "
    if s.kind == "SUB_NOTE":
        return State(kind, ends, "section" in line and kind == "HEADING_1", inside, *left), kind, ""
    grown = s._replace(ends=ends, section=False)
    body = not heading and "item" not in line
    if s.kind == "HEADING_1" and body and "head" not in s.ends and not line.isdisjoint(("upper", "lower")):
        return grown, "last", ": " if s.section else " "
    if s.kind == "HEADING_2" and body and "head" not in s.ends and not line.isdisjoint(("lower", "of")):
        return grown, "last", " "
    if s.kind == "LIST_ITEM" and body and ("list" not in s.ends or "goes_on" in line):
        return grown._replace(waits=0 if "list" in ends else 1, stopped=False), "last", " "
    if s.kind == "PARAGRAPH" and body:
        ended = "stop" in s.ends and "short" not in s.ends and not ("number" in s.ends and "digit" in line)
        if not ended or "goes_on" in line:
            return grown._replace(waits=0 if "stop" in ends else 1, stopped=False), "last", " "
    return State(kind, ends, "section" in line and kind == "HEADING_1", inside, 0 if "stop" in ends else 1, False), kind, ""


# ------------------------------------------------------------------------ lines


def mask(line: Column) -> Column:
    """The features of a line as bits; null for a page's edge, -1 for a line that is left out."""
    return trimmed_mask(S.web_trim(line))


def trimmed_mask(text: Column) -> Column:
    """The mask of a line that is trimmed. As a column it is trimmed once, as an expression in each use."""
    # anchored as a whole, so that no other place of the line is tried; ends are read in the last characters
    starts = lambda pattern: text.rlike(rf"\A(?:{pattern})")
    tail = F.right(text, F.lit(END_CHARS))
    bits = [starts(STARTS[n]) if n in STARTS else tail.rlike(ENDS[n]) if n in ENDS else text == F.upper(text) for n in FEATURES]
    sum_ = F.lit(0)
    for i, b in enumerate(bits):
        sum_ = sum_ + F.when(b, 1 << i).otherwise(0)
    bare = F.regexp_replace(text, rf"^(?:[-*•+]|{S.SPACE_CLASS})+", "")
    out = (F.length(text) <= 1) | ((F.length(bare) <= 2) & ~bare.rlike(r"^\d+\.?$")) | text.rlike(MOTTO)
    return F.when(starts(PAGE_LINE), F.lit(None).cast("int")).when(out, -1).otherwise(sum_)


@lru_cache(maxsize=100_000)
def features(bits: int) -> frozenset:
    return frozenset(n for i, n in enumerate(FEATURES) if bits >> i & 1)


class Entry(NamedTuple):
    """Where a block begins: the state, elements so far, and the element that waits."""

    state: State = State()
    n: int = 0
    waits: int = -1


NUMBERS: dict[State, int] = {}
STATES: list[State] = []
MOVES: dict[tuple, tuple] = {}


def number_of(s: State) -> int:
    if s not in NUMBERS:
        NUMBERS[s] = len(STATES)
        STATES.append(s)
    return NUMBERS[s]


def move(at: int, m: int | None) -> tuple:
    """A step between numbered states, kept (states and masks of real lines are few): the state after it,
    what becomes of the line, what stands before it, and whether the last element waits."""
    s, what, before = step(STATES[at], None if m is None else features(m))
    if len(MOVES) > 200_000:
        MOVES.clear()
    MOVES[at, m] = (number_of(s), what, before, s.waits == 1)
    return MOVES[at, m]


def followed(masks: list, entry: Entry):
    """Entry after all lines, and (element, kind if it begins one, what stands before) of each line."""
    s, n, waits, out = number_of(entry.state), entry.n, entry.waits, []
    for m in masks:
        if m == -1:
            out.append((-1, "", ""))
            continue
        s, what, before, last_waits = MOVES.get((s, m)) or move(s, m)
        if what == "last":
            out.append((n - 1, "", before))
        elif what == "waiting":
            out.append((waits, "", before))
        elif what:
            out.append((n, what, ""))
            n += 1
        else:
            out.append((-1, "", ""))
        if last_waits:
            waits = n - 1
    return Entry(STATES[s], n, waits), out


def summed(masks: list, entries: list[Entry]) -> list[Entry]:
    """Where each entry leads. Entries that have met, in one state with the same element waiting, are
    followed once; each keeps how many elements it is ahead."""
    here: dict[tuple, list] = {}  # (state, the waiting element counted from n) -> [n, [(entry, ahead)]]

    def put(to: dict, e: Entry, members: list) -> None:
        key = (e.state, None if e.state.waits != 2 else CARRIED if e.waits == CARRIED else e.waits - e.n)
        held = to.setdefault(key, [e.n, []])
        held[1].extend((i, ahead + e.n - held[0]) for i, ahead in members)

    for i, e in enumerate(entries):
        put(here, e, [(i, 0)])
    for m in masks:
        if m == -1:
            continue
        merged: dict[tuple, list] = {}
        for (state, ago), (n, members) in here.items():
            waits = n - 1 if state.waits == 1 else CARRIED if ago in (None, CARRIED) else n + ago
            put(merged, followed([m], Entry(state, n, waits))[0], members)
        here = merged
    out = list(entries)
    for (state, ago), (n, members) in here.items():
        for i, ahead in members:
            at = n + ahead
            out[i] = Entry(state, at, at - 1 if state.waits == 1 else CARRIED if ago in (None, CARRIED) else at + ago)
    return out


def codes(s: State) -> str:
    return "|".join([s.kind, ",".join(sorted(s.ends)), str(int(s.section)), str(int(s.inside)), str(s.waits), str(int(s.stopped))])


def decoded(text: str) -> State:
    kind, ends, *rest = text.split("|")
    section, inside, waits, stopped = map(int, rest)
    return State(kind, frozenset(x for x in ends.split(",") if x), bool(section), bool(inside), waits, bool(stopped))


@lru_cache(maxsize=1)
def all_states() -> list[State]:
    """Every state there is: kinds by ways to end, and what may wait."""
    ends = [frozenset(x.split()) for x in ("", "list", "head stop", "head stop list", "stop", "head stop list short", "head stop list number")]
    waits = [(0, False), (1, False), (2, False), (2, True)]
    some = [State(k, e, sec, ins, *w) for k in KINDS for e in ends for sec in (False, True) for ins in (False, True) for w in waits]
    return [State(), State(inside=True), *some]


# ------------------------------------------------------------------------ stitching

#: An element that waits at a block's entry is known only later; it stands for that.
CARRIED = -2_000_000_000


def block_function(key, table):
    masks = table.sort_by("ord")["mask"].to_pylist()
    states = all_states()
    entries = [Entry(s, 0, -1 if s.waits == 1 else CARRIED) for s in states]
    after = summed(masks, entries)
    n = len(states)
    return pa.table(
        [pa.array([key[0].as_py()] * n, table.schema.field("doc_id").type), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(list(map(codes, states))), pa.array([codes(e.state) for e in after]), pa.array([e.n for e in after], pa.int64()), pa.array([e.waits for e in after], pa.int64())],
        names=["doc_id", "block", "entry", "state", "n", "waits"],
    )


def entries_of(key, table):
    """(doc_id, block, state, n, waits) of each block of a document after its first, from their functions."""
    by = {}
    for b, entry, state, n, waits in zip(*(table[c].to_pylist() for c in ("block", "entry", "state", "n", "waits")), strict=True):
        by.setdefault(b, {})[entry] = (state, n, waits)
    at, out = Entry(), []
    for b in range(max(by) + 1):
        if b in by:
            state, n, waits = by[b][codes(at.state)]
            at = Entry(decoded(state), at.n + n, at.waits if waits == CARRIED else at.n + waits)
        out.append((b + 1, codes(at.state), at.n, at.waits))
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array([key[0].as_py()] * len(out), table.schema.field("doc_id").type), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "block", "state", "n", "waits"])


def stitch_block(key, table):
    table = table.sort_by("ord")
    state, n, waits = (table[c][0].as_py() for c in ("state", "n", "waits"))
    _, out = followed(table["mask"].to_pylist(), Entry() if state is None else Entry(decoded(state), n, waits))
    el, kind, before = zip(*out, strict=True)
    return pa.table([table["doc_id"], table["ord"], table["line"], pa.array(el, pa.int64()), pa.array(kind), pa.array(before)], names=["doc_id", "ord", "line", "element", "kind", "before"])


def elements_of(masks: list, lines: list) -> list[tuple]:
    """(place, type, lines, text) of a whole document's elements; footnotes right after a heading stand
    before it (V12)."""
    kinds, texts = [], []
    for (at, kind, before), line in zip(followed(masks, Entry())[1], lines, strict=True):
        if kind:
            kinds.append(kind)
            texts.append([line])
        elif at >= 0:
            texts[at].append(before + line)
    places = list(range(len(kinds)))
    head = -1  # the heading that the footnotes here follow
    for i, kind in enumerate(kinds):
        if kind != "FOOTNOTE":
            head = i if kind.startswith("HEADING") else -1
        elif head >= 0:
            places[i] -= 1
            places[head] += 1
    return [(p, k, len(t), "".join(t)) for p, k, t in zip(places, kinds, texts, strict=True)]


def stitch_documents(batches):
    """Whole documents of one block each, sorted; those marked as longer are passed over."""
    schema = None

    def rows():
        nonlocal schema
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("ord", pa.int64()), ("type", pa.string()), ("n", pa.int64()), ("text", pa.string())])
            yield zip(*(b[c].to_pylist() for c in ("doc_id", "is_long", "mask", "line")), strict=True)

    out: list[tuple] = []
    for doc, group in groupby(chain.from_iterable(rows()), itemgetter(0)):
        _, longer, masks, lines = zip(*group, strict=True)
        if not longer[0]:
            out.extend((doc, *e) for e in elements_of(masks, lines))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def lines_of_longer(batches):
    """The lines of documents that are marked as longer."""
    doc, longer = object(), False
    for b in batches:
        keep = []
        for d, is_mark in zip(b["doc_id"].to_pylist(), b["is_long"].to_pylist(), strict=True):
            if d != doc:
                doc, longer = d, is_mark  # the mark is sorted first
            keep.append(longer and not is_mark)
        if any(keep):
            yield b.filter(pa.array(keep, pa.bool_())).drop_columns(["is_long"])


def tidied(text: Column, n: Column, type_: Column) -> Column:
    """The text of an element of so many lines."""
    return F.when(n == 1, text).when(type_ == "FOOTNOTE", F.regexp_replace(text, r"[ \t]+", " ")).otherwise(F.regexp_replace(text, f"{S.SPACE_CLASS}+", " "))


def stitched(lines: DataFrame) -> DataFrame:
    """lines (doc_id, ord, line) of bodies, ord in order -> (doc_id, ord, type, text): elements, numbered
    from 0. Null lines are left out, null doc_ids are one document; footnotes right after a heading stand
    before it (V12)."""
    kind = lines.schema["doc_id"].dataType.simpleString()
    rows = lines.filter("line is not null").select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("line").cast("string").alias("line"))

    def masked(some: DataFrame) -> DataFrame:
        # few lines begin or end with a space; the others aren't searched for one
        spaced = F.concat(F.left("line", F.lit(1)), F.right("line", F.lit(3))).rlike(S.SPACE_CLASS)
        return some.withColumn("line", F.when(spaced, S.web_trim(F.col("line"))).otherwise(F.col("line"))).withColumn("mask", trimmed_mask(F.col("line")))

    first, later = rows.filter(F.col("ord") < BLOCK), rows.filter(F.col("ord") >= BLOCK)
    marks = later.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("ord"), F.lit("").alias("line"), F.lit(-1).alias("mask"), F.lit(True).alias("is_long"))
    sorted_ = masked(first).withColumn("is_long", F.lit(False)).unionByName(marks).repartition("doc_id").sortWithinPartitions("doc_id", F.desc("is_long"), "ord")
    whole = sorted_.mapInArrow(stitch_documents, f"doc_id {kind}, ord long, type string, n long, text string")
    whole = whole.select("doc_id", "ord", "type", tidied(F.col("text"), F.col("n"), F.col("type")).alias("text"))
    longer = sorted_.mapInArrow(lines_of_longer, f"doc_id {kind}, ord long, line string, mask int").unionByName(masked(later))
    return whole.unionByName(stitched_in_blocks(longer, kind))


def stitched_in_blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Documents of several blocks (doc_id, ord, line, mask): blocks summed up, then stitched."""
    rows = rows.withColumn("block", F.floor(F.col("ord") / BLOCK).cast("long"))
    functions = rows.select("doc_id", "block", "ord", "mask").groupBy("doc_id", "block").applyInArrow(block_function, f"doc_id {kind}, block long, entry string, state string, n long, waits long")
    entries = functions.groupBy("doc_id").applyInArrow(entries_of, f"doc_id {kind}, block long, state string, n long, waits long")
    entries = entries.select(F.col("doc_id").alias("d"), F.col("block").alias("b"), "state", "n", "waits")
    joined = rows.join(entries, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("block") == F.col("b")), "left").drop("d", "b")
    parts = joined.groupBy("doc_id", "block").applyInArrow(stitch_block, f"doc_id {kind}, ord long, line string, element long, kind string, before string").filter("element >= 0")
    held = parts.groupBy("doc_id", "element").agg(F.max("kind").alias("type"), F.array_sort(F.collect_list(F.struct("ord", "before", "line"))).alias("l"))
    text = F.concat_ws("", F.transform("l", lambda x: F.concat(x["before"], x["line"])))
    return before_headings(held.select("doc_id", F.col("element").alias("ord"), "type", tidied(text, F.size("l"), F.col("type")).alias("text")))


def before_headings(elements: DataFrame) -> DataFrame:
    """Footnotes right after a heading belong to what stands before it: the two change places."""
    near = FN.numbered(elements).select("doc_id", "ord", "type", "text", "is_note", "body")
    heads = elements.filter(F.col("type").startswith("HEADING")).select(F.col("doc_id").alias("d"), F.col("ord").alias("h"))
    moved = near.filter("is_note").join(heads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("h")), "left_semi")
    runs = moved.groupBy(F.col("doc_id").alias("d"), F.col("body").alias("h")).agg(F.count("*").alias("k"))
    at = F.when(F.col("is_note"), F.col("body")).otherwise(F.col("ord"))
    out = near.join(runs, F.col("doc_id").eqNullSafe(F.col("d")) & (at == F.col("h")), "left")
    place = F.when(F.col("k").isNull(), F.col("ord")).when(F.col("is_note"), F.col("ord") - 1).otherwise(F.col("ord") + F.col("k"))
    return out.select("doc_id", place.alias("ord"), "type", "text")


# ------------------------------------------------------------------------ zones

# fixed values: lines of the head and the foot of a document
AGENCY = r"^(?:ỦY\s*BAN\s*NHÂN\s*DÂN|UỶ\s*BAN\s*NHÂN\s*DÂN|UBND|HỘI\s*ĐỒNG\s*NHÂN\s*DÂN|HĐND|BỘ|SỞ|PHÒNG|BAN|CHI\s*CỤC|ĐỘI|CÔNG\s*AN|VĂN\s*PHÒNG|TẬP\s*ĐOÀN|TỔNG\s*CÔNG\s*TY|CÔNG\s*TY|TRUNG\s*TÂM|XÃ|PHƯỜNG|THỊ\s*TRẤN|HUYỆN|QUẬN|THÀNH\s*PHỐ|THỊ\s*XÃ|TỈNH)(?![0-9A-Za-z_])"
NO_AGENCY = r"ban\s*hành|hướng\s*dẫn|công\s*văn"
SUPERIOR = r"^(?:TẬP\s*ĐOÀN|BỘ|ỦY\s*BAN\s*NHÂN\s*DÂN|UỶ\s*BAN\s*NHÂN\s*DÂN|UBND)(?![0-9A-Za-z_])"
TWO_AGENCIES = r"^(ỦY BAN NHÂN DÂN|UỶ BAN NHÂN DÂN|UBND|TẬP ĐOÀN|TỔNG CÔNG TY)\s+(.+)$"
ANY_AGENCY = "ỦY BAN NHÂN DÂN"
NUMBER = r"^Số\s*(?!liệu|lượng|thứ|phận|hóa)[:.]?\s*([0-9a-zA-Z\-_.]*\s*/\s*[0-9a-zA-Z\-_.]+|[0-9a-zA-Z/\-_.]{2,})"
NO_NUMBER = r"^(?:trong|ngày|tháng|năm|li)$"
DATED = r"(?:([A-ZÀ-Ỹa-zà-ỹ\s]+),\s*)?ngày\s*(\d{1,2}|[.]{2,}|…)?\s*tháng\s*(\d{1,2}|[.]{2,}|…)\s*năm\s*(\d{4})"
TITLE = r"^(?:BÁO CÁO|PHIẾU TRÌNH|TỜ TRÌNH|QUYẾT ĐỊNH|THÔNG BÁO|KẾ HOẠCH|CÔNG VĂN|GIẤY MỜI)(?![0-9A-Za-z_])"
BODY = r"^(?:Kính gửi|Đơn vị trình|Thực hiện|Căn cứ|Nơi nhận|Theo đề nghị|Theo|Tại|Căn cứ vào|Nhằm)(?:[\s:\-,.]|$)|^(?:CỘNG HÒA|ỦY BAN|UBND|Số:)"
NEXT_PART = r"^(?:[A-Z0-9IVX]+\.|PHẦN|[-*•+]|[a-zđ]\))"
NUMBERED = r"^(?:[IVX|]+\.|\d+[.)]|PHẦN)"
ABOUT = r"^(?:Cải cách|Công tác|Kết quả|Tình hình|Phương hướng|Kế hoạch|Nhiệm vụ|Sơ kết|Tổng kết|Đánh giá|Báo cáo|Về việc|V/v|Về)(?:[\s:\-,.]|$)"
REGARDING = r"^(?:V/v|Về việc)(?![0-9A-Za-z_])"
AFTER_REGARDING = r"^(?:Kính gửi|Hà Nội|TP|Ngày|Căn cứ|[IVX|]+\.|\d+\.)"
SIGNER = r"^(?:CHỦ TỊCH|Q\.\s*CHỦ TỊCH|PHÓ CHỦ TỊCH|GIÁM ĐỐC|PHÓ GIÁM ĐỐC|TỔNG GIÁM ĐỐC|PHÓ TỔNG GIÁM ĐỐC|TRƯỞNG PHÒNG|TRƯỞNG CÔNG AN|CHÁNH VĂN PHÒNG|KT\.\s*CHỦ TỊCH|KT\.\s*TỔNG GIÁM ĐỐC|KT\.\s*GIÁM ĐỐC|TM\.\s*ỦY BAN NHÂN DÂN)"
RANK = r"^(?:PHÓ\s+CHỦ\s+TỊCH|CHỦ\s+TỊCH|PHÓ\s+GIÁM\s+ĐỐC|GIÁM\s+ĐỐC|ỦY\s+VIÊN)"
NO_NAME = r"^(?:Nơi nhận|Lưu:|BIỂU|BẢNG|PHỤ LỤC)"
HEAD_LINES, SUBJECT_LINES = 25, 6
DEFAULTS = {"title": "BÁO CÁO", "number": "Số: .../BC-UBND", "dated": "Ngày ... tháng ... năm ...", "signer_title": "CHỦ TỊCH"}


def like(x: Column, pattern: str, ignore_case: bool = True) -> Column:
    return x.rlike(S.web_regex(pattern, ignore_case))


def first_at(lines: Column, fits, start=1) -> Column:
    """The place, from 1, of the first line that fits (from a place on); 0 for none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x, i: F.coalesce(fits(x), F.lit(False)) & (i + 1 >= start)), True), F.lit(0)).cast("int")


def last_at(lines: Column, fits, start=1) -> Column:
    back = F.array_position(F.reverse(F.transform(lines, lambda x, i: F.coalesce(fits(x), F.lit(False)) & (i + 1 >= start))), True)
    return F.when(back > 0, F.size(lines) - back + 1).otherwise(0).cast("int")


def run_from(lines: Column, start: Column, most: int, goes_on, last=None) -> Column:
    """How many lines from a place on, at most so many, go on; a line that is the last ends the run."""
    some = F.slice(lines, F.greatest(start, F.lit(1)), most)
    begin = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step_(a, x):
        ok = a["open"] & goes_on(x)
        return F.struct((a["n"] + ok.cast("int")).alias("n"), (ok & ~last(x) if last else ok).alias("open"))

    return F.when(start > F.size(lines), 0).otherwise(F.aggregate(some, begin, step_, lambda a: a["n"]))


def joined_lines(lines: Column, start: Column, n: Column) -> Column:
    return S.web_trim(F.regexp_replace(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), n), " "), f"{S.SPACE_CLASS}+", " "))


def zones(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lines, and the zones of each document (X11): superior, issuer, number, dated, title,
    subject, to, unit, recipients, signer_title, signer, and the body's first and last line (from 1;
    last before first for an empty body). The head is looked for in the first HEAD_LINES lines; what is
    not found has its default or is null. Null and empty texts have no line."""
    from . import textops as TX

    L = F.col("lines")
    d = docs.select("doc_id", TX.body_lines(F.col(text)).alias("lines"))
    d = d.withColumn("t", first_at(F.slice(L, 1, HEAD_LINES), lambda x: like(x, TITLE)))
    d = d.withColumn("head", F.slice(L, 1, F.when(F.col("t") > 0, F.col("t")).otherwise(HEAD_LINES)))
    H, n = F.col("head"), F.size(L)
    top = F.slice(L, 1, 15)
    line = lambda i: F.get(L, i - 1)

    # agencies: a fold over the lines that name one
    named = F.filter(H, lambda x: (F.length(x) <= 80) & ~like(x, NO_AGENCY) & like(x, AGENCY))
    nothing = F.lit(None).cast("string")

    def agency(a, x):
        up, free = F.upper(x), a["sup"].isNull()
        takes, default = like(x, SUPERIOR) & free, a["iss"] == ANY_AGENCY
        return F.struct(F.when(takes, up).when(~default & free, a["iss"]).otherwise(a["sup"]).alias("sup"), F.when(takes, a["iss"]).when(default | free, up).otherwise(a["iss"]).alias("iss"))

    found = F.aggregate(named, F.struct(nothing.alias("sup"), F.lit(ANY_AGENCY).alias("iss")), agency)
    # number and date: the last line of the head that has one
    numbers = F.transform(H, lambda x, i: F.when(like(x, NUMBER) & ~like(F.regexp_extract(x, S.web_regex(NUMBER), 1), NO_NUMBER), F.trim(F.regexp_extract(x, S.web_regex(NUMBER), 1))).when(like(x, r"^Số\s*:\s*$") & line(i + 2).rlike(r"^[0-9a-zA-Z/\-_.]+$"), line(i + 2)))
    number = F.element_at(F.concat(F.array(nothing), F.filter(numbers, lambda x: x.isNotNull())), -1)
    dates = F.filter(H, lambda x: like(x, DATED))
    # as columns of their own: as expressions the lines would be searched again in each of their uses
    d = d.withColumn("f", found).withColumn("number", number).withColumn("said", F.element_at(F.concat(F.array(nothing), dates), -1))
    number, said = F.col("number"), F.col("said")
    alone = F.get(F.filter(top, lambda x: x.rlike(r"^\d{1,5}$")), F.lit(0))
    number = F.when(number.startswith("/"), F.concat(F.coalesce(alone, F.lit("")), number)).otherwise(number)
    part = lambda i: F.trim(F.regexp_extract(said, S.web_regex(DATED), i))
    day = F.get(F.filter(top, lambda x: x.rlike(r"^(?:0?[1-9]|[12]\d|3[01])$")), F.lit(0)).cast("int").cast("string")
    day = F.when((part(2) == "") | part(2).contains("."), day).otherwise(part(2))
    place = F.when(part(1) == "", "").otherwise(F.concat(part(1), F.lit(", ")))
    dated = F.when(day.isNotNull(), F.concat(place, F.lit("ngày "), day, F.lit(" tháng "), part(3), F.lit(" năm "), part(4))).otherwise(F.trim(F.regexp_extract(said, S.web_regex(DATED), 0)))
    d = d.select("doc_id", "lines", "t", "f", F.when(number.isNotNull(), F.concat(F.lit("Số: "), F.regexp_replace(number, r"\s*/\s*", "/"))).alias("number"), F.when(said.isNotNull(), dated).alias("dated"))

    # title and subject
    t = F.col("t")
    after = line(t + 1)
    no_body = ~like(after, BODY) & ~like(after, NEXT_PART) & ~like(after, r"^\d+\)")
    upper = (after == F.upper(after)) & (F.length(after) > 5)
    starts = (t > 0) & no_body & (like(line(t + 2), NUMBERED) | like(after, ABOUT) | upper) & (F.length(after) < 250)
    more = run_from(L, t + 2, SUBJECT_LINES - 2, lambda x: ~like(x, BODY) & ~like(x, NEXT_PART) & ~x.startswith("(") & (F.length(x) <= 250), lambda x: x.rlike(r"[.:]$"))
    starts = F.coalesce(starts, F.lit(False))
    v = F.when(t == 0, first_at(F.slice(L, 1, 18), lambda x: like(x, REGARDING))).otherwise(0)
    d = d.withColumn("more", F.when(starts, 1 + more).otherwise(0)).withColumn("v", v)
    v, more = F.col("v"), F.col("more")
    also = run_from(L, v + 1, 3, lambda x: ~like(x, AFTER_REGARDING) & (F.length(x) <= 150))
    d = d.withColumn("also", F.when(v > 0, also).otherwise(0))
    subject = F.when(more > 0, joined_lines(L, t + 1, more)).when(v > 0, joined_lines(L, v, F.col("also") + 1))
    start = F.when(t > 0, t + 1 + more).when(v > 0, v + F.col("also") + 1).otherwise(1)
    d = d.withColumn("title", F.when(t > 0, F.upper(line(t))).when(v > 0, "CÔNG VĂN").otherwise(DEFAULTS["title"])).withColumn("subject0", subject).withColumn("start", start)

    # whom it is for and who submits it: among the ten lines after the head, counted from the last of them
    opening = F.transform(F.slice(L, F.greatest("start", F.lit(1)), 30), lambda x, i: F.struct((i + F.col("start")).alias("at"), x.alias("x")))
    begin = F.struct(F.col("start").alias("from"), nothing.alias("to"), nothing.alias("unit"), F.col("subject0").alias("subject"))

    def open_step(a, y):
        x, near = y["x"], y["at"] < a["from"] + 10
        to, unit = near & like(x, r"^Kính gửi\s*[:\s]"), near & like(x, r"^Đơn vị trình\s*[:\s]")
        about = near & ~to & ~unit & like(x, r"^Về việc(?![0-9A-Za-z_])") & a["subject"].isNull()
        return F.struct(F.when(to | unit | about, y["at"] + 1).otherwise(a["from"]).alias("from"), F.when(to, x).otherwise(a["to"]).alias("to"), F.when(unit, x).otherwise(a["unit"]).alias("unit"), F.when(about, x).otherwise(a["subject"]).alias("subject"))

    d = d.withColumn("o", F.aggregate(opening, begin, open_step))

    # foot: the last signer's title, and the lists of recipients
    start = F.col("o.from")
    d = d.withColumn("s", last_at(L, lambda x: like(x, SIGNER), start)).withColumn("r", first_at(L, lambda x: like(x, r"^Nơi nhận\s*[:\s]"), start))
    s, r = F.col("s"), F.col("r")
    ranks = F.when(s > 0, run_from(L, s + 1, 3, lambda x: like(x, RANK))).otherwise(0)
    d = d.withColumn("ranks", ranks)
    name = line(s + F.col("ranks") + 1)
    is_name = ~like(name, NO_NAME) & (F.length(name) < 40) & (F.size(F.split(name, " ")) >= 2) & ~name.rlike("[0-9:.]")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, rf"^(?:[-*•+]|{S.SPACE_CLASS})+", ""), ";$", ""))
    listed = run_from(L, r + 1, 100_000, lambda x: x.startswith("-") | ((F.length(bare(x)) >= 3) & (x.rlike(r"^[*+]") | F.lower(x).startswith("lưu:"))))
    given = F.array_distinct(F.filter(F.transform(F.slice(L, F.greatest(r + 1, F.lit(1)), F.when(r > 0, listed).otherwise(0)), bare), lambda x: F.length(x) >= 3))
    end = F.least(F.when(s > 0, s - 1).otherwise(n), F.when(r > 0, r - 1).otherwise(n))

    # one agency may hold the other's name
    sup, iss = F.col("f.sup"), F.col("f.iss")
    rest = F.trim(F.regexp_replace(F.replace(iss, sup, F.lit("")), r"^[\s\-–—:]+", ""))
    inside = sup.isNotNull() & F.contains(iss, sup)
    two = sup.isNull() & like(iss, TWO_AGENCIES)
    issuer = F.when(inside & (rest != ""), rest).when(two, F.upper(F.regexp_extract(iss, S.web_regex(TWO_AGENCIES), 2))).otherwise(iss)
    superior = F.when(inside & (rest == ""), nothing).when(two, F.upper(F.regexp_extract(iss, S.web_regex(TWO_AGENCIES), 1))).otherwise(sup)
    return d.select(
        "doc_id", "lines", F.when(superior != issuer, superior).alias("superior"), issuer.alias("issuer"), F.coalesce("number", F.lit(DEFAULTS["number"])).alias("number"), F.coalesce("dated", F.lit(DEFAULTS["dated"])).alias("dated"),
        "title", F.col("o.subject").alias("subject"), F.col("o.to").alias("to"), F.col("o.unit").alias("unit"), given.alias("recipients"),
        F.coalesce(F.when(s > 0, F.array_join(F.slice(L, F.greatest(s, F.lit(1)), F.col("ranks") + 1), "\n")), F.lit(DEFAULTS["signer_title"])).alias("signer_title"), F.when((s > 0) & is_name, name).alias("signer"), F.col("o.from").alias("first"), end.alias("last"),
    )


def body_of(zoned: DataFrame) -> DataFrame:
    """(doc_id, ord, line) of the bodies of zoned documents, without lines that repeat a zone."""
    repeated = F.array("superior", "issuer", "number", "dated", "title", "subject", "to", "unit")
    some = F.slice("lines", F.greatest("first", F.lit(1)), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)))
    keep = F.transform(some, lambda x: F.when(~F.exists(repeated, lambda y: F.coalesce(x == y, F.lit(False))), x))
    return zoned.select("doc_id", F.posexplode(keep).alias("ord", "line"))


def document_structure(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The zones of documents (doc_id, text), one row each, and their body elements."""
    zoned = zones(docs)
    return zoned.drop("lines", "first", "last"), stitched(body_of(zoned))
