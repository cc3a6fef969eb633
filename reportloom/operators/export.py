"""Exports: CSV of several tables, JSON, markdown rows, and what printed layouts show."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import tables as T

EMPTY_CSV = "Không có bảng số liệu"


def csv_lines(tables: DataFrame) -> DataFrame:
    """tables (doc_id, ord, title, page_ref, headers, rows) -> doc_id, ord, line_no, line."""
    cell = lambda r: F.array_join(F.transform(r, S.csv_cell), ",")
    title = F.replace(F.col("title"), F.lit('"'), F.lit('""'))
    head = F.concat(F.lit('"=== BẢNG '), F.col("ord"), F.lit(": "), title, F.lit(" (Trang "), F.col("page_ref"), F.lit(') ==="'))
    body = F.concat(F.array(head, cell(F.col("headers"))), F.transform("rows", cell), F.array(F.lit(""), F.lit("")))
    return tables.select("doc_id", "ord", F.posexplode(body).alias("line_no", "line"))


def csv_documents(tables: DataFrame) -> DataFrame:
    """One CSV text a document: BOM, CRLF."""
    lines = csv_lines(tables).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line_no", "line"))).alias("l"))
    return lines.select("doc_id", F.concat(F.lit("﻿"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")).alias("csv"))


def json_documents(rows: DataFrame) -> DataFrame:
    """Each row as pretty JSON, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def layout_rows(tables: DataFrame) -> DataFrame:
    """Data decisions of the printed layouts: row class, sub-header, at most 100 rows."""
    return tables.select("doc_id", "ord", T.sub_header(F.col("rows")).alias("has_sub_header"), F.posexplode(F.slice("rows", 1, 100)).alias("row_no", "row")).withColumn("row_class", T.row_class(F.col("row")))


def report_rows(tables: DataFrame, metrics: DataFrame, most_rows: int = 100, most_metrics: int = 50) -> dict[str, DataFrame]:
    """What a printed report shows: layout rows of each table, and the first metrics of a document
    (W5, W6, O9)."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return {"tables": layout_rows(tables).filter(F.col("row_no") < most_rows), "metrics": metrics.withColumn("n", n).filter(F.col("n") <= most_metrics)}


# fixed values: widths of columns, on a page of 482 points
STT = r"^(stt|#|số tt|tt)$"
NARROW, WIDE = {"stt": 30, "unit": 75, "number": 55, "note": 70, "text": 55}, {"stt": 38, "unit": 90, "number": 68, "note": 85, "text": 75}
SUB_HEADER = "^(đơn vị|đvt|số liệu|kế hoạch|thực hiện|tỷ lệ|kết quả|kinh phí|ngân sách|số lượng|ghi chú|tháng|năm|nam|nữ)"


def column_roles(headers: list[str], second: list[str]) -> list[str]:
    out = []
    for i, h in enumerate(headers):
        under = second[i].strip() if i < len(second) else ""
        both = f"{h.strip()} {under}".strip().lower()
        if re.match("đơn vị|đvt", both) or re.search("đơn vị|đvt", under.lower()):
            out.append("unit")
        elif re.match("số liệu|kết quả|thực hiện|kế hoạch|tỷ lệ|ước thực hiện", both) or re.match("số liệu|tỷ lệ", under.lower()):
            out.append("number")
        else:
            out.append("note" if re.match("ghi chú|note", both) else "text")
    return out


def has_second_header(headers: list[str], rows: list[list[str]]) -> bool:
    """Whether the first row is a second tier of headers (V9)."""
    if len(rows) < 2 or not rows[0] or not rows[1] or rows[0][0].strip() not in ("", "-", "—") or not rows[1][0].strip():
        return False
    blank = any(not h.strip() for h in headers)
    like = any(re.match(SUB_HEADER, c.strip(), re.I) or (blank and c.strip()) for c in rows[0])
    return bool(like) and all(len(c.strip()) <= 40 for c in rows[0])


def column_widths(headers: list[str], rows: list[list[str]], total: int) -> list[int]:
    """Widths that add up to `total` (S33): a share by content to the power 0.65, a least width by
    role, and no column above 48 % of what is dealt where there are four or more."""
    n = max(len(headers), len(rows[0]) if rows else 1)
    if n <= 1:
        return [total]
    headers = [*headers, *[""] * (n - len(headers))]
    half_up = lambda x: math.floor(x + 0.5)
    cell = lambda r, c: (r[c] or "").strip() if c < len(r) else ""
    two = has_second_header(headers, rows)
    second = rows[0] if two else []
    twips = total > 1000
    scale = total / 482 if twips else 1
    least_of = WIDE if total > (11000 if twips else 600) else NARROW
    numbered = bool(re.match(STT, headers[0].strip(), re.I)) or (bool(rows) and all(len(cell(r, 0)) <= 4 for r in [*rows[:2], []][:2]))
    roles = column_roles(headers, second)
    if numbered:
        roles[0] = "stt"
    least = [half_up(least_of[r] * scale) for r in roles]
    if sum(least) > total * 0.92:
        shrink = total * 0.92 / sum(least)
        least = [max(400 if twips else 20, math.floor(w * shrink)) for w in least]
    size = []
    for c in range(n):
        lengths = [x for x in (len(cell(r, c)) for r in (rows[1:] if two else rows)[:30]) if x]
        typical = min(half_up(sum(lengths) / len(lengths) * 0.5 + max(lengths) * 0.5), 150) if lengths else 0
        size.append(max(len(headers[c].strip()), len(cell(second, c)), typical, 4))
    first = 1 if numbered else 0
    left = total - (least[0] if numbered else 0)
    weight = [x**0.65 for x in size[first:]]
    out = least[:first] + [max(w, half_up(x / sum(weight) * left)) for w, x in zip(least[first:], weight, strict=True)]
    if n >= 4:
        top = max(range(first, n), key=lambda c: (out[c], -c))
        over = out[top] - half_up(left * 0.48)
        if over > 0:
            others = [c for c in range(n) if c != top]
            out[top] -= over
            for c in others:
                out[c] += over // len(others)
    out[max(range(first, n), key=lambda c: (out[c], -c))] += total - sum(out)
    return [w if w > 0 else max(500 if twips else 25, total // n) for w in out]


def table_widths(tables: DataFrame, total: int = 482) -> DataFrame:
    """tables (doc_id, ord, headers, rows) -> doc_id, ord, widths. One small table at a time, so a
    vectorised Python function over batches of tables."""

    @F.pandas_udf("array<int>")
    def widths(headers: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([column_widths([x or "" for x in h], [[x or "" for x in r] for r in t], total) for h, t in zip(headers, rows, strict=True)])

    return tables.select("doc_id", "ord", widths("headers", "rows").alias("widths"))


def markdown_tables(tables: DataFrame) -> DataFrame:
    return tables.select("doc_id", "ord", T.markdown(F.col("headers"), F.col("rows")).alias("markdown"))
