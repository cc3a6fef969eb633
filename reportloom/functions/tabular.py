"""Table functions for SQL: what a document holds, as rows.

    register(spark)
    SELECT p.page_id, b.* FROM pages p, LATERAL html_blocks(p.html) b
    SELECT d.doc_id, l.* FROM documents d, LATERAL text_lines(d.text) l

`html_blocks` gives headings, paragraphs and tables in page order (R5), and with each table its rows and
cells: (ord, tag, row_index, col_index, text), row_index and col_index null for a block as a whole. A
cell counts for the table it stands in; a paragraph in a cell is part of the cell. `text_lines` gives the
trimmed lines of a text that are not empty, with their place among all lines (V4's input). Null and empty
inputs give no row; markup that is left open is closed at the end.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

BREAKS = {"br", "div", "li", "p", "tr"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "table"}


class Blocks(HTMLParser):
    """Blocks in order; of nested blocks the outermost counts, of nested tables the cells of the first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, list[str], list[list[list[str]]]]] = []
        self.open: str | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if self.open is None and tag in BLOCKS:
            self.open, self.depth = tag, 1
            self.out.append((tag, [], []))
            return
        if self.open is None:
            return
        self.depth += tag == self.open
        if tag == "br":
            self.out[-1][1].append("\n")
        if self.open == "table" and self.depth == 1:
            if tag == "tr":
                self.out[-1][2].append([])
            elif tag in ("td", "th"):
                if not self.out[-1][2]:
                    self.out[-1][2].append([])
                self.out[-1][2][-1].append([])

    def handle_endtag(self, tag):
        if self.open is None:
            return
        if tag in BREAKS:
            self.out[-1][1].append("\n")
        if tag == self.open:
            self.depth -= 1
            if not self.depth:
                self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.out[-1][1].append(data)
            rows = self.out[-1][2]
            if rows and rows[-1]:
                rows[-1][-1].append(data)


def tidy(parts: list[str]) -> str:
    """Lines without white space at their ends, none of them empty."""
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


@udtf(returnType="ord int, tag string, row_index int, col_index int, text string")
class HtmlBlocks:
    def eval(self, html: str):
        if not html:
            return
        page = Blocks()
        page.feed(html)
        page.close()
        for i, (tag, parts, rows) in enumerate(page.out):
            yield i, tag, None, None, tidy(parts)
            for r, row in enumerate(rows):
                for c, cell in enumerate(row):
                    yield i, tag, r, c, " ".join("".join(cell).split())


@udtf(returnType="ord int, line string")
class TextLines:
    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                yield i, line.strip()


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_blocks", HtmlBlocks)
    spark.udtf.register("text_lines", TextLines)
