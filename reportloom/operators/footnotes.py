"""Footnotes of document bodies (X12): each gets a number, the element that carries its marker, and
its place in that element's text.

elements (doc_id, ord, type, text) hold a document's body in order, ord counting 0, 1, 2... Both
joins are as-of joins cut into blocks of positions, so a document of any length is spread over many
tasks: a marker reaches REACH positions, so it is met in at most two blocks; numbers and the nearest
body element come from a window inside blocks of BLOCK positions plus one row a block.
A null doc_id is a document like any other; null texts carry no marker; repeated (doc_id, ord) rows
are read as one position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

REACH = 30
BLOCK = 1024
# fixed values: how a note starts, and how a text carries its marker
NOTE_START = r"^(\*?\d+|\[\d+\]|\(\*\)|\*)"
ENDS = rf"(?:[.,;:]|{S.SPACE_CLASS}|\z)"
RUN = rf"([\p{{L}})]?)(\d+)(?={ENDS})"
SQUARE = rf"\[{S.SPACE_CLASS}*(\d+){S.SPACE_CLASS}*\](?={ENDS})"
ROUND = rf"\({S.SPACE_CLASS}*(\d+){S.SPACE_CLASS}*\)(?={ENDS})"


def note_marker(text: Column) -> Column:
    """The digits of a note's own marker; empty for a star or none."""
    return F.regexp_replace(F.regexp_extract(text, NOTE_START, 1), r"\D", "")


def carried_markers(text: Column) -> Column:
    """All markers that a text carries: a number right after a letter or a bracket, one after a
    year's four digits (every such tail of a run of digits), one alone in brackets. A note without a
    number is carried by any single digit, which is listed as ''."""
    none = F.array().cast("array<string>")
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # what is used several times is bound as a lambda's variable, so that no regex runs twice
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def of_runs(runs):
        after_letter = F.transform(F.filter(runs, lambda x: x["before"] != ""), lambda x: x["run"])
        long = F.filter(runs, lambda x: F.length(x["run"]) > 4)
        return F.concat(after_letter, F.flatten(F.transform(long, lambda x: F.transform(F.sequence(F.lit(1), F.length(x["run"]) - 4), lambda n: F.right(x["run"], n)))))

    runs = F.arrays_zip(found(RUN, 1).alias("before"), found(RUN, 2).alias("run"))
    every = F.concat(bound(runs, of_runs), found(SQUARE, 1), found(ROUND, 1))
    starred = lambda a: F.concat(a, F.when(F.exists(a, lambda m: F.length(m) == 1), F.array(F.lit(""))).otherwise(none))
    return F.when(text.rlike(r"\d"), F.array_distinct(bound(every, starred))).otherwise(none)


def numbered(elements: DataFrame) -> DataFrame:
    """Elements with is_note, number (of notes up to here, from 1) and body (the nearest position
    before with another type)."""
    note = F.coalesce(F.col("type") == "FOOTNOTE", F.lit(False))
    rows = elements.select("doc_id", F.col("ord").cast("long").alias("ord"), "type", "text").withColumn("is_note", note).withColumn("block", F.floor(F.col("ord") / BLOCK))
    inside = Window.partitionBy("doc_id", "block").orderBy("ord")
    other = F.when(~F.col("is_note"), F.col("ord"))
    rows = rows.withColumn("number", F.sum(F.col("is_note").cast("long")).over(inside)).withColumn("body", F.max(other).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("doc_id", "block").agg(F.count_if("is_note").alias("n"), F.max(other).alias("last"))
    blocks = blocks.select(F.col("doc_id").alias("d"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("last").over(earlier).alias("body_before"))
    joined = rows.join(blocks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("block") == F.col("b")))
    return joined.select("doc_id", "ord", "type", "text", "is_note", (F.col("number") + F.col("n_before")).alias("number"), F.coalesce("body", "body_before").alias("body"))


def footnotes(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, number, marker, target, text) of every footnote: target is the nearest element
    at most REACH positions before it that carries its marker, else the nearest body element before it
    (null where there is none); text is without the marker, one line a paragraph."""
    is_note = F.coalesce(F.col("type") == "FOOTNOTE", F.lit(False))
    # the others' texts aren't needed for numbers and places
    rows = numbered(elements.withColumn("text", F.when(is_note, F.col("text"))))
    notes = rows.filter("is_note").withColumn("marker", note_marker(F.coalesce("text", F.lit(""))))
    wanted = notes.select(F.col("doc_id").alias("d"), F.col("ord").alias("at"), F.col("marker").alias("m"), F.floor(F.col("ord") / REACH).alias("cell"))
    carriers = elements.filter(~is_note).select("doc_id", F.col("ord").cast("long").alias("ord"), F.explode(carried_markers(F.col("text"))).alias("marker"))
    cells = F.array_distinct(F.array(F.floor((F.col("ord") + 1) / REACH), F.floor((F.col("ord") + REACH) / REACH)))
    carriers = carriers.select("doc_id", "ord", "marker", F.explode(cells).alias("block"))
    met = carriers.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("marker") == F.col("m")) & (F.col("block") == F.col("cell")) & (F.col("at") - F.col("ord")).between(1, REACH))
    carried = met.groupBy("d", "at").agg(F.max("ord").alias("carrier"))
    out = notes.join(carried, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("ord") == F.col("at")), "left")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), S.web_trim), lambda x: x != "")
    first = F.regexp_replace(F.get(lines, F.lit(0)), rf"{NOTE_START}[.:]?{S.SPACE_CLASS}*", "")
    body = F.array_join(F.concat(F.array(F.coalesce(first, F.lit(""))), F.slice(lines, 2, 10_000)), "\n")
    return out.select("doc_id", "ord", "number", "marker", F.coalesce("carrier", "body").alias("target"), body.alias("text"))


def with_references(text: Column, notes: Column) -> Column:
    """text with `[^number]` in place of each note's marker, in the notes' order: the first place that
    carries the marker in what is left of the text; at the end where none does. A place is a letter, a
    bracket or a said year (after "năm" or a date's stroke) before the marker, or the marker in brackets;
    only where there is none, the tail of any other number (12341 for marker 1) is read as a place, since
    it is rather a number of its own. notes is an array of (number, marker)."""
    said = lambda n: F.concat(F.lit("[^"), n["number"].cast("string"), F.lit("]"))

    def step(acc, n):
        m, sp = n["marker"], S.SPACE_CLASS
        bracketed = F.concat(m, F.lit(rf"|{sp}*\[{sp}*"), m, F.lit(rf"{sp}*\]|{sp}*\({sp}*"), m, F.lit(rf"{sp}*\))({ENDS})(.*)\z"))
        clear = F.concat(F.lit(rf"(?s)\A(.*?)(?:([\p{{L}})]|(?:[Nn]ăm{sp}*|/)\d{{4}})"), bracketed)
        tail = F.concat(F.lit(r"(?s)\A(.*?)(?:(\d{4})"), bracketed)
        is_clear = F.call_function("rlike", acc["rest"], clear)
        shape = F.when(is_clear, clear).otherwise(tail)
        part = lambda i: F.call_function("regexp_extract", acc["rest"], shape, F.lit(i))
        placed = (m != "") & (is_clear | F.call_function("rlike", acc["rest"], tail))
        done = F.when(placed, F.concat(acc["done"], part(1), part(2), said(n))).otherwise(acc["done"])
        rest = F.when(placed, F.concat(part(3), part(4))).otherwise(acc["rest"])
        late = F.when(placed, acc["late"]).otherwise(F.concat(acc["late"], said(n)))
        return F.struct(done.alias("done"), rest.alias("rest"), late.alias("late"))

    start = F.struct(F.lit("").alias("done"), text.alias("rest"), F.lit("").alias("late"))
    return F.aggregate(notes, start, step, lambda a: F.concat(a["done"], a["rest"], a["late"]))


def anchored(elements: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The body without its footnotes (doc_id, ord, type, text, n_notes), references in place and texts
    cleaned. An element holds the notes that follow it at most, so its list stays short."""
    notes = footnotes(elements) if notes is None else notes
    held = notes.filter("target is not null").groupBy(F.col("doc_id").alias("d"), F.col("target").alias("at")).agg(F.array_sort(F.collect_list(F.struct("number", "marker"))).alias("notes"))
    body = elements.filter(F.coalesce(F.col("type") != "FOOTNOTE", F.lit(True))).select("doc_id", F.col("ord").cast("long").alias("ord"), "type", S.clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    joined = body.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("ord") == F.col("at")), "left")
    text = F.when(F.col("notes").isNull(), F.col("text")).otherwise(with_references(F.col("text"), F.col("notes")))
    return joined.select("doc_id", "ord", "type", text.alias("text"), F.coalesce(F.size("notes"), F.lit(0)).alias("n_notes"))
