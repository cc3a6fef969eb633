"""DOCX documents: parts to blocks with pages and tables, blocks to parts, and both as data sources.

    register(spark)
    spark.read.format("report_docx").load(folder)          path, ord, kind, text, page, table_id, rows, error
    spark.readStream.format("report_docx").load(folder)    the same, of files as they come in
    df.write.format("report_docx").mode("overwrite").save(folder)    one file a row (name, blocks)
    df.write.format("report_files").option("extension", "csv").mode("append").save(folder)    (name, content)

Reading is planned in partitions of about maxPartitionBytes (option) of whole files. A schema given
with .schema(...) picks columns; a file is opened only if one of its contents is asked for. With
the option pushFilters, equality and IN filters on path choose files before they are opened. A broken
file is one row with its error.

Writing puts each task's files below _temporary; the commit moves the files of the tasks that count
and leaves a list of them, an abort deletes them. Overwriting removes the files of the list before.
Rows that share a name are refused, and nothing is left of such a write.

Folders are what pyarrow.fs opens from a path or URI: local and mounted paths, s3, gs, hdfs. For a
store that only Spark reads use sources.files.scan, which gives the same blocks.
"""

from __future__ import annotations

import io
import json
import math
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
WORD = f"{{{W}}}"
BLOCK = "path string, ord int, kind string, text string, page int, table_id string, rows array<array<string>>, error string"
# fixed values: a logical page's size and what may start a page
PAGE_CHARS, SECTION_CHARS = 2200, 800
TOP, BOTTOM = 50, 760
MAJOR = re.compile(r"^(?:[I|V|X]+\.|PHẦN\b|BÁO CÁO\b)", re.I)


@dataclass
class Block:
    kind: str  # heading, paragraph or table
    text: str
    rows: list[list[str]] | None = None
    page: int = 1
    table_id: str | None = None


# ------------------------------------------------------------------------ parsing


def body_blocks(content: bytes) -> list[Block]:
    """The blocks of a DOCX body in order; tables as rows of cells, their text tab-separated."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{WORD}p":
            text = said(e).strip()
            style = e.find(f"{WORD}pPr/{WORD}pStyle")
            head = style is not None and re.match("(?i)heading|title", style.get(f"{WORD}val") or "")
            if text:
                out.append(Block("heading" if head else "paragraph", text))
        elif e.tag == f"{WORD}tbl":
            rows = [[" ".join(" ".join(said(p) for p in c.iter(f"{WORD}p")).split()) for c in r.iter(f"{WORD}tc")] for r in e.iter(f"{WORD}tr")]
            out.append(Block("table", "\n".join("\t".join(r) for r in rows), rows))
    return out


def said(e) -> str:
    """The text of an element; tabs and breaks are white space."""
    part = {f"{WORD}t": lambda x: x.text or "", f"{WORD}tab": lambda _: "\t", f"{WORD}br": lambda _: "\n", f"{WORD}cr": lambda _: "\n"}
    return "".join(part[x.tag](x) for x in e.iter() if x.tag in part)


def height(b: Block) -> int:
    """What a block takes of a page, with the space after it."""
    return min(300, (len(b.rows) + 1) * 22) + 15 if b.rows is not None else max(18, math.ceil(len(b.text) / 80) * 16) + 10


def paged(blocks: list[Block]) -> list[Block]:
    """Blocks with their logical page and tables with their number: a page is full at PAGE_CHARS, at
    its bottom edge, or at SECTION_CHARS where a section starts."""
    page, chars, y, tables = 1, 0, TOP, 0
    for b in blocks:
        starts = b.kind == "heading" or bool(MAJOR.match(b.text))
        if chars >= PAGE_CHARS or (chars >= SECTION_CHARS and starts):
            page, chars, y = page + 1, 0, TOP
        b.page = page
        if b.rows is not None:
            tables += 1
            b.table_id = f"word-table-{tables}"
        chars += len(b.text)
        y += height(b)
        if y >= BOTTOM:
            page, chars, y = page + 1, 0, TOP
    return blocks


# ------------------------------------------------------------------------ writing parts

TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
NOT_XML = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")


def run(text: str) -> str:
    lines = NOT_XML.sub("", text).replace("\r\n", "\n").split("\n")
    return "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in lines) + "</w:r>"


def part(kind: str, text: str | None, rows: list[list[str | None]] | None) -> str:
    if kind == "table":
        cell = lambda c: f"<w:tc><w:p>{run(c or '')}</w:p></w:tc>"
        return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r or []))}</w:tr>" for r in rows or []) + "</w:tbl>"
    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if kind == "heading" else ""
    return f"<w:p>{style}{run(text or '')}</w:p>"


def docx_bytes(blocks) -> bytes:
    """A DOCX of blocks (kind, text, rows); equal blocks give equal bytes."""
    body = "".join(part(k, t, r) for k, t, r in blocks)
    parts = {"[Content_Types].xml": TYPES, "_rels/.rels": RELATIONS, "word/document.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


# ------------------------------------------------------------------------ folders


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
    return system, inner.rstrip("/")


def documents(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the .docx files below a folder, or of one file."""
    from pyarrow import fs

    system, inner = opened(path)
    at = system.get_file_info(inner)
    found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(inner) :].split("/") if x)
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".docx") and not hidden(f.path))


class Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


def planned(root: str, files: list[tuple[str, int, int]], most: int) -> list[Files]:
    """Runs of files of about `most` bytes; a larger file stands alone."""
    out: list[Files] = []
    size = most + 1
    for path, n, _ in files:
        if size + n > most and size:
            out.append(Files(root, []))
            size = 0
        out[-1].paths.append(path)
        size += max(n, 1)
    return out


def rows_of(part: Files, columns: list[str]) -> Iterator[tuple]:
    system, _ = opened(part.root)
    for path in part.paths:
        if set(columns) == {"path"}:
            yield (path,)
            continue
        try:
            with system.open_input_stream(path) as f:
                blocks = paged(body_blocks(f.read()))
            rows = [(path, i, b.kind, b.text, b.page, b.table_id, b.rows, None) for i, b in enumerate(blocks)]
        except Exception as e:  # noqa: BLE001  one broken file must not fail the others
            rows = [(path, 0, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]
        names = [x.split()[0] for x in BLOCK.split(", ")]
        for r in rows:
            value = dict(zip(names, r, strict=True))
            yield tuple(value[c] for c in columns)


# ------------------------------------------------------------------------ sources


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_docx"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> DataSourceReader:
        return (ChoosingReader if str(self.options.get("pushFilters")).lower() == "true" else DocxReader)(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DocxStream(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocxWriter(schema, self.options, overwrite)


def settings(options) -> tuple[str, int]:
    if "path" not in options:
        raise ValueError("a path is needed")
    return options["path"], int(options.get("maxPartitionBytes", 32 << 20))


class DocxReader(DataSourceReader):
    def __init__(self, schema, options):
        self.root, self.most = settings(options)
        self.columns, self.wanted = schema.fieldNames(), None

    def partitions(self):
        return planned(self.root, [f for f in documents(self.root) if self.wanted is None or f[0] in self.wanted], self.most) or [Files(self.root, [])]

    def read(self, partition):
        return rows_of(partition, self.columns)


class ChoosingReader(DocxReader):
    """A reader that takes filters on path. Spark allows one only where its setting
    spark.sql.python.filterPushdown.enabled is on."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class DocxStream(DataSourceStreamReader):
    """Files in the order of their change; the offset is the last one read. A file whose time of change
    is before that is not seen any more, so a landing folder gets its files by moves."""

    def __init__(self, schema, options):
        self.root, self.most = settings(options)
        self.columns = schema.fieldNames()

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((t, p) for p, _, t in documents(self.root)), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict):
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return planned(self.root, [f for f in documents(self.root) if low < (f[2], f[0]) <= high], self.most) or [Files(self.root, [])]

    def read(self, partition):
        return rows_of(partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # name, where it waits


class FilesWriter(DataSourceWriter):
    """One file a row (name, content), text or bytes, with the extension of the option of that name."""

    LIST = "_documents.json"
    NEEDED = {"name", "content"}

    def __init__(self, schema, options, overwrite: bool):
        self.root, _ = settings(options)
        self.overwrite, self.extension = overwrite, options.get("extension", "txt")
        missing = self.NEEDED - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows need {', '.join(sorted(self.NEEDED))}; there is no {', '.join(sorted(missing))}")
        self.job = uuid.uuid4().hex

    def content(self, row) -> bytes:
        x = row["content"]
        return x.encode() if isinstance(x, str) else bytes(x or b"")

    def waiting(self, inner: str) -> str:
        return f"{inner}/_temporary/{self.job}"

    def write(self, iterator) -> Written:
        system, inner = opened(self.root)
        at = f"{self.waiting(inner)}/{uuid.uuid4().hex}"  # of this attempt alone
        system.create_dir(at, recursive=True)
        files = []
        for row in iterator:
            name = re.sub(r"[^\w.-]+", "_", row["name"] or "").strip("._") or "document"
            with system.open_output_stream(f"{at}/{len(files)}") as f:
                f.write(self.content(row))
            files.append((f"{name}.{self.extension}", f"{at}/{len(files)}"))
        return Written(files)

    def commit(self, messages) -> None:
        system, inner = opened(self.root)
        files = [f for m in messages if m for f in m.files]
        names = sorted(n for n, _ in files)
        twice = sorted({a for a, b in zip(names, names[1:], strict=False) if a == b})
        known = self.known(system, inner)
        clash = twice or ([] if self.overwrite else sorted(set(names) & set(known)))
        if clash:
            self.abort(messages)
            raise ValueError(f"documents share a name: {', '.join(clash[:5])}")
        if self.overwrite:
            for n in set(known) - set(names):
                system.delete_file(f"{inner}/{n}")
            known = []
        for n, at in files:
            system.move(at, f"{inner}/{n}")
        with system.open_output_stream(f"{inner}/{self.LIST}") as f:
            f.write(json.dumps(sorted({*known, *names})).encode())
        self.abort(messages)

    def known(self, system, inner: str) -> list[str]:
        """The documents of the writes before."""
        from pyarrow import fs

        if system.get_file_info(f"{inner}/{self.LIST}").type != fs.FileType.File:
            return []
        with system.open_input_stream(f"{inner}/{self.LIST}") as f:
            return json.loads(f.read())

    def abort(self, messages) -> None:
        """Nothing of this job is left below _temporary."""
        from pyarrow import fs

        system, inner = opened(self.root)
        if system.get_file_info(self.waiting(inner)).type == fs.FileType.Directory:
            system.delete_dir(self.waiting(inner))
        above = f"{inner}/_temporary"
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


class DocxWriter(FilesWriter):
    """One DOCX a row (name, blocks)."""

    NEEDED = {"name", "blocks"}

    def __init__(self, schema, options, overwrite: bool):
        super().__init__(schema, options, overwrite)
        self.extension = "docx"

    def content(self, row) -> bytes:
        return docx_bytes((b["kind"], b["text"], b["rows"]) for b in row["blocks"] or [])


class FilesSink(DataSource):
    """Exports as files: CSV, JSON, markdown or whatever text or bytes a row holds."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session; a session may know them from another one."""
    for source in (DocxSource, FilesSink):
        try:
            spark.dataSource.register(source)
        except AnalysisException as e:
            if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                raise
