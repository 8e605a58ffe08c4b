"""Scan of word-processing packages into paragraph rows.

One pass of expat over the main part: ordinals, table places, both text projections, the
structures that protect text, and the byte span of each paragraph, so that a later save can
copy all others as they are. A document that cannot be read gives one row with an ``error``.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from fnmatch import fnmatch
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumite.functions.text import ESCAPED_START, MARKER_END, MARKER_START

#: The main part and the namespaces of its elements.
MAIN_PART = "word/document.xml"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W14 = "http://schemas.microsoft.com/office/word/2010/wordml"

CONTEXT = "struct<table_index:int,row_index:int,physical_cell_index:int,logical_column_index:int,grid_span:int,grid_before:int,vertical_merge:string,nesting_depth:int,paragraph_index_in_cell:int>"
SEGMENTS = "array<struct<vstart:int,vend:int,mstart:int,mend:int,node:int,marker:string,structures:array<string>>>"
FIELDS = f"id string, record_pos int, global_ordinal int, container int, style_id string, w14_para_id string, table_context {CONTEXT}, text string, marked_text string, segments {SEGMENTS}, protected array<string>, ppr_xml string, rpr_xml string, xml string, span struct<start:long,end:long>"
SCHEMA = f"path string, source struct<sha256:string,size:long,modified:timestamp>, {FIELDS}, error struct<code:string,path:string,reason:string>"

_START_TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
_DECLARED = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"'][^>]*\?>")
_VISIBLE = {"tab": ("TAB", "\t"), "br": ("LINE_BREAK", "\n"), "cr": ("CR", "\r")}
_SURROUND = ("hyperlink", "ins", "fldSimple")
#: Labels of what a paragraph holds besides plain runs, in the order in which they are told.
_PROTECTING = {"hyperlink": "hyperlink", "fldChar": "field", "fldSimple": "field", "instrText": "field", "bookmarkStart": "bookmark", "bookmarkEnd": "bookmark", "permStart": "permission", "permEnd": "permission", "commentRangeStart": "comment", "commentRangeEnd": "comment", "commentReference": "comment", "ins": "revision_ins", "del": "revision_del"}
_LABELS = [*dict.fromkeys(_PROTECTING.values()), "run_styling"]


class Unreadable(Exception):
    """A package or part that cannot be read; the reason is the message."""


@dataclass
class _Paragraph:
    start: int
    ordinal: int
    container: int
    hidden: int
    boxed: int
    inside_sdt: bool
    context: dict | None
    para_id: str | None
    scope: dict[str, str]
    style: str | None = None
    text: list[str] = field(default_factory=list)
    marked: list[str] = field(default_factory=list)
    segments: list[dict] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)
    at: int = 0
    at_marked: int = 0
    nodes: int = 0
    ppr: str = ""
    rpr: str | None = None
    run_rpr: str = ""
    run_text: bool = False
    run_field: bool = False
    surround: list[str] = field(default_factory=list)

    def emit(self, shown: str, marked: str, marker: str | None, in_marked: bool) -> None:
        if not shown:
            return
        self.text.append(shown)
        width = len(marked) if in_marked else 0
        self.segments.append({"vstart": self.at, "vend": self.at + len(shown), "mstart": self.at_marked, "mend": self.at_marked + width, "node": self.nodes, "marker": marker, "structures": [f"w:{x}" for x in self.surround]})
        self.at += len(shown)
        self.nodes += 1
        if in_marked:
            self.marked.append(marked)
            self.at_marked += width


def utf8(raw: bytes) -> bytes:
    """The part in UTF-8, without a declaration of another encoding."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if raw.startswith(mark):
            raw = raw.decode(name).encode()
            break
    else:
        m = _DECLARED.match(raw)
        if m and m[1].lower() not in (b"utf-8", b"utf8", b"us-ascii"):
            raw = raw.decode(m[1].decode()).encode()
    return re.sub(rb"^\s*<\?xml[^>]*\?>\s*", b"", raw)


def _integer(x: str | None, least: int) -> int:
    return max(least, int(x)) if x and re.fullmatch(r"[+-]?[0-9]+", x) else least


class _Scan:
    """Handlers of one pass."""

    def __init__(self, data: bytes) -> None:
        self.data, self.rows = data, []
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.CharacterDataHandler = self.characters
        self.parser.StartNamespaceDeclHandler, self.parser.EndNamespaceDeclHandler = self.declare, self.forget
        self.parser.StartDoctypeDeclHandler = self.parser.EntityDeclHandler = self.refuse
        self.scope: dict[str, list[str]] = {}
        self.stack: list[tuple[str, int, int]] = []  # name, first byte, number
        self.numbered = self.ordinal = self.tables = self.hidden = self.boxed = self.properties = 0
        self.frames: list[dict] = []  # tables, rows and cells that are open
        self.open: list[_Paragraph] = []
        self.letters: list[str] | None = None

    def refuse(self, *_) -> None:
        raise Unreadable("document type declarations are not allowed")

    def declare(self, prefix: str | None, uri: str) -> None:
        self.scope.setdefault(prefix or "", []).append(uri)

    def forget(self, prefix: str | None) -> None:
        self.scope[prefix or ""].pop()

    def _context(self) -> dict | None:
        cell = next((f for f in reversed(self.frames) if f["kind"] == "tc"), None)
        row = next((f for f in reversed(self.frames) if f["kind"] == "tr"), None)
        table = next((f for f in reversed(self.frames) if f["kind"] == "tbl"), None)
        if not (cell and row and table):
            return None
        out = {"table_index": table["index"], "row_index": row["index"], "physical_cell_index": cell["index"], "logical_column_index": cell["column"], "grid_span": cell["span"], "grid_before": row["before"], "vertical_merge": cell["merge"], "nesting_depth": sum(f["kind"] == "tbl" for f in self.frames) - 1, "paragraph_index_in_cell": cell["paragraphs"]}
        cell["paragraphs"] += 1
        return out

    def start(self, name: str, attributes: dict[str, str]) -> None:
        uri, _, local = name.rpartition(" ")
        tag = local if uri == W else ""
        self.numbered += 1
        at = self.parser.CurrentByteIndex
        parent = self.stack[-1][2] if self.stack else 0
        self.stack.append((tag, at, self.numbered))
        value = attributes.get(f"{W} val")
        if tag == "p":
            self.ordinal += 1
            context = None if self.boxed and not self.open else self._context()
            scope = {k: v[-1] for k, v in self.scope.items() if v}
            self.open.append(_Paragraph(at, self.ordinal, parent, self.hidden, self.boxed, self.boxed > 0 and any(x[0] == "sdt" for x in self.stack), context, attributes.get(f"{W14} paraId"), scope))
            return
        if tag == "tbl":
            self.frames.append({"kind": "tbl", "index": self.tables, "rows": 0})
            self.tables += 1
        elif tag == "tr" and self.frames:
            table = next(f for f in reversed(self.frames) if f["kind"] == "tbl")
            self.frames.append({"kind": "tr", "index": table["rows"], "cells": 0, "before": 0, "column": 0})
            table["rows"] += 1
        elif tag == "tc" and self.frames and self.frames[-1]["kind"] == "tr":
            row = self.frames[-1]
            self.frames.append({"kind": "tc", "index": row["cells"], "column": row["column"] + row["before"], "span": 1, "merge": "none", "paragraphs": 0})
            row["cells"] += 1
        elif tag == "gridSpan" and self.frames and self.frames[-1]["kind"] == "tc":
            self.frames[-1]["span"] = _integer(value, 1)
        elif tag == "gridBefore" and self.frames and self.frames[-1]["kind"] == "tr":
            self.frames[-1]["before"] = _integer(value, 0)
        elif tag == "vMerge" and self.frames and self.frames[-1]["kind"] == "tc":
            self.frames[-1]["merge"] = "restart" if value == "restart" else "continue"
        self.hidden += tag == "del"
        self.boxed += tag in ("sdt", "instrText")
        self.properties += tag == "pPr"
        above = [x[0] for x in self.stack[-3:-1]]
        for p in self.open:
            if tag in _PROTECTING and not self.properties:
                p.seen.add(_PROTECTING[tag])
            if tag == "rPr" and above[-1:] == ["r"]:
                p.seen.add("run_styling")
            if tag in _SURROUND:
                p.surround.append(tag)
        if self.open:
            p = self.open[-1]
            if tag == "pStyle" and above == ["p", "pPr"]:
                p.style = value
            if tag == "r":
                p.run_rpr, p.run_text, p.run_field = "", False, False
            p.run_field = p.run_field or tag in ("fldChar", "instrText")
            if tag == "t":
                p.run_text = True
                self.letters = []
            elif tag in _VISIBLE and not self.properties:
                kind, shown = _VISIBLE[tag]
                if tag == "br":
                    kind = {"page": "PAGE_BREAK", "column": "COLUMN_BREAK"}.get(attributes.get(f"{W} type"), kind)
                self._emit(shown, f"{MARKER_START}{kind}{MARKER_END}", kind)

    def _emit(self, shown: str, marked: str, marker: str | None) -> None:
        for p in self.open:
            if self.hidden == p.hidden:
                p.emit(shown, marked, marker, self.boxed == p.boxed)

    def characters(self, x: str) -> None:
        if self.letters is not None:
            self.letters.append(x)

    def _slice(self, at: int) -> tuple[int, int]:
        """First byte and the one past the end of the element that ends now."""
        head = _START_TAG.match(self.data, at)
        if head[0].endswith(b"/>"):
            return at, head.end()
        return at, self.data.index(b">", self.parser.CurrentByteIndex) + 1

    def end(self, name: str) -> None:
        tag, at, _ = self.stack.pop()
        if tag == "t" and self.letters is not None:
            text = "".join(self.letters)
            self.letters = None
            self._emit(text, text.replace(MARKER_START, ESCAPED_START), None)
        elif tag in ("tbl", "tr", "tc") and self.frames and self.frames[-1]["kind"] == tag:
            done = self.frames.pop()
            if tag == "tc" and self.frames:
                self.frames[-1]["column"] += done["span"]
        self.hidden -= tag == "del"
        self.boxed -= tag in ("sdt", "instrText")
        self.properties -= tag == "pPr"
        for p in self.open:
            if tag in _SURROUND and p.surround:
                p.surround.pop()
        if not self.open:
            return
        p = self.open[-1]
        parent = self.stack[-1][0] if self.stack else ""
        if tag == "rPr" and parent == "r":
            a, b = self._slice(at)
            p.run_rpr = self.data[a:b].decode()
        elif tag == "r" and p.rpr is None and p.run_text and not p.run_field and self.hidden == p.hidden and self.boxed == p.boxed:
            p.rpr = p.run_rpr
        elif tag == "pPr" and parent == "p":
            a, b = self._slice(at)
            p.ppr = self.data[a:b].decode()
        elif tag == "p":
            self.open.pop()
            if p.inside_sdt:
                return
            a, b = self._slice(at)
            self.rows.append({"global_ordinal": p.ordinal, "container": p.container, "style_id": p.style, "w14_para_id": p.para_id, "table_context": p.context, "text": "".join(p.text), "marked_text": "".join(p.marked), "segments": p.segments, "protected": [x for x in _LABELS if x in p.seen], "ppr_xml": p.ppr, "rpr_xml": p.rpr or "", "xml": declared(self.data[a:b].decode(), p.scope), "span": {"start": a, "end": b}})

    def run(self) -> list[dict]:
        try:
            self.parser.Parse(self.data, True)
        except expat.ExpatError as e:
            raise Unreadable(f"invalid XML: {e}") from e
        self.rows.sort(key=lambda r: r["global_ordinal"])
        for k, r in enumerate(self.rows, 1):
            r |= {"record_pos": k, "id": f"p_{k:06d}"}
        return self.rows


def declared(xml: str, scope: dict[str, str]) -> str:
    """An element's source with the namespaces in scope declared on it."""
    head = _START_TAG.match(xml.encode())[0].decode()
    extra = "".join(f' {"xmlns:" + k if k else "xmlns"}="{v}"' for k, v in sorted(scope.items()) if k != "xml" and f'{"xmlns:" + k if k else "xmlns"}=' not in head)
    cut = len(head) - (2 if head.endswith("/>") else 1)
    return xml[:cut] + extra + xml[cut:]


def scan_xml(raw: bytes) -> list[dict]:
    """Paragraph rows of a main part."""
    return _Scan(utf8(raw)).run()


def check_xml(raw: bytes) -> None:
    """Refuses what a scan refuses, without making rows."""

    def refuse(*_) -> None:
        raise Unreadable("document type declarations are not allowed")

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    try:
        parser.Parse(utf8(raw), True)
    except expat.ExpatError as e:
        raise Unreadable(f"invalid XML: {e}") from e


def main_part(content: bytes) -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.read(MAIN_PART)
    except KeyError as e:
        raise Unreadable(f"missing {MAIN_PART}") from e
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
        raise Unreadable(f"not a valid ZIP package: {e}") from e


def read_packages(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Paragraph rows of all packages under a path or pattern.

    Unreadable ones: PERMISSIVE gives a row with an ``error``, DROPMALFORMED none, FAILFAST fails.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"no such mode: {mode}")
    return scan(binary_files(spark, path), mode)


#: Tasks for each core that files are dealt to at most.
_TASKS = 32


def binary_files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """All files of that name under a path or pattern. Spark counts opening a file as megabytes and makes a task of a few small ones; their partitions are put together."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    most = _TASKS * spark.sparkContext.defaultParallelism
    return files.coalesce(most) if files.rdd.getNumPartitions() > most else files


def folder_files(spark: SparkSession, folder: str, patterns: Sequence[str] = ("*.docx",)) -> DataFrame:
    """Rows as of binary files for the files of these names in one folder, which the driver and all executors reach as a path.

    Only names are listed, once; files are opened where they are read, without what Spark spends on each.
    """
    with os.scandir(folder) as found:
        names = [x.name for x in found if not x.name.startswith((".", "_")) and any(fnmatch(x.name, p) for p in patterns)]
    schema = StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(f"{folder}/{name}", "rb") as file:
                    content, at = file.read(), os.fstat(file.fileno()).st_mtime_ns
                rows.append((f"file:{folder}/{name}", datetime.fromtimestamp(at // 10**9, UTC).replace(microsecond=at % 10**9 // 1000), len(content), content))
                size += len(content)
                if len(rows) >= _ROWS or size >= _BYTES:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())}))
    tasks = max(1, min(_TASKS * spark.sparkContext.defaultParallelism, -(-len(names) // _ROWS), len(names)))
    tasks = max(tasks, min(spark.sparkContext.defaultParallelism, len(names)))
    return listed.repartition(tasks).mapInArrow(run, schema)


#: A batch of rows goes out when it holds so many, or so many bytes of XML.
_ROWS, _BYTES = 2000, 8 << 20


def scan(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Paragraph rows of packages given as binary files (path, modificationTime, length, content), batch or stream; each file is read once."""
    schema = StructType.fromDDL(SCHEMA)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(schema)

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], fields.field(n).type) for n in names], schema=fields)

        made, size = [], 0
        for batch in batches:
            for path, modified, length, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                try:
                    rows, error = scan_xml(main_part(content)), None
                except (Unreadable, UnicodeError, LookupError) as e:
                    if mode == "FAILFAST":
                        raise
                    rows, error = ([] if mode == "DROPMALFORMED" else [{}]), {"code": "invalid_document", "path": path, "reason": str(e)}
                if not rows:
                    continue
                source = {"sha256": hashlib.sha256(content).hexdigest(), "size": length, "modified": modified}
                for r in rows:
                    made.append(r | {"path": path, "source": source, "error": error})
                    size += len(r.get("xml", ""))
                    if len(made) >= _ROWS or size >= _BYTES:
                        yield out(made)
                        made, size = [], 0
        if made:
            yield out(made)

    return files.select("path", "modificationTime", "length", "content").mapInArrow(run, schema)
