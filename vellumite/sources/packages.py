"""Packages made from tables of plain text: one for each document, its lines as paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.sources.docx import MAIN_PART, W, W14

#: Content types and relations of a package, as the format has them.
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def package(text: str) -> bytes:
    """A package of a text's lines; the first is a heading of level 1, other short ones of level 2."""
    parts = []
    for k, line in enumerate(text.split("\n")):
        style = "Heading1" if not k else "Heading2" if len(line) < 60 else "Normal"
        parts.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>')
    return zipped("".join(parts))


def zipped(body: str, types: str = _TYPES, namespaces: str = f'xmlns:w="{W}"', head: str = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>') -> bytes:
    """A package with this body in its main part."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", types), ("_rels/.rels", _RELATIONS), (MAIN_PART, f"{head}<w:document {namespaces}><w:body>{body}</w:body></w:document>")):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _run(text: str, props: str = "") -> str:
    return f'<w:r>{props and f"<w:rPr>{props}</w:rPr>"}<w:t xml:space="preserve">{text}</w:t></w:r>'


def _cell(*content: str, props: str = "") -> str:
    return f'<w:tc>{props and f"<w:tcPr>{props}</w:tcPr>"}{"".join(content)}</w:tc>'


def rich_body(number: int, word: str) -> str:
    """One of each thing that a document may hold, with a number and a word of ASCII letters in it."""
    cell = lambda x: f"<w:p>{_run(x)}</w:p>"
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    inner = f"<w:tbl><w:tr>{_cell(cell('n1'))}</w:tr></w:tbl>"
    return "".join(
        (
            f'<w:p w14:paraId="1A2B3C4D"><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{_run(f"Title {number}", "<w:b/>")}</w:p>',
            f'<w:p>{_run("al")}{_run("pha", "<w:i/>")}{_run(" beta ")}{_run(word)}</w:p>',
            f'<w:p><w:hyperlink w:anchor="x">{_run("link")}</w:hyperlink>{_run(" tail")}</w:p>',
            f'<w:p><w:fldSimple w:instr="PAGE">{_run("7")}</w:fldSimple>{_run(" pages")}</w:p>',
            f'<w:p>{field("begin")}<w:r><w:instrText>DATE</w:instrText></w:r>{field("separate")}{_run("today")}{field("end")}</w:p>',
            f'<w:p>{_run("Base ")}<w:ins w:id="1">{_run("NEW")}</w:ins><w:del w:id="2"><w:r><w:delText>OLD</w:delText></w:r></w:del>{_run(" tail.")}</w:p>',
            '<w:p><w:r><w:t>L</w:t><w:tab/><w:t>M</w:t><w:br/><w:t>N</w:t><w:br w:type="page"/><w:t>P</w:t><w:br w:type="column"/><w:cr/></w:r></w:p>',
            f'<w:p>{_run("say [[DOCX:TAB]]")}</w:p>',
            f'<w:p><w:bookmarkStart w:id="3"/><w:commentRangeStart w:id="4"/><w:permStart w:id="5"/>{_run("kept")}<w:permEnd w:id="5"/><w:commentRangeEnd w:id="4"/><w:bookmarkEnd w:id="3"/></w:p>',
            f"<w:sdt><w:sdtContent>{cell('boxed')}</w:sdtContent></w:sdt>",
            f'<w:tbl><w:tr>{_cell(cell("a1"), cell("a2"))}{_cell(cell("b1"), props="""<w:gridSpan w:val="2"/><w:vMerge w:val="restart"/>""")}</w:tr>',
            f'<w:tr><w:trPr><w:gridBefore w:val="1"/></w:trPr>{_cell(cell("c1"), props="<w:vMerge/>")}{_cell(inner, cell("after"))}</w:tr></w:tbl>',
            f'<w:p>{_run(f"end {word}")}</w:p>',
        )
    )


def rich_package(number: int, word: str) -> bytes:
    return zipped(rich_body(number, word), namespaces=f'xmlns:w="{W}" xmlns:w14="{W14}"')


def first_word(text: str | None) -> str:
    """The ASCII letters that a text begins with."""
    return re.match("[A-Za-z]*", text or "")[0]


def from_documents(documents: DataFrame, rich: bool = False) -> DataFrame:
    """Rows as of binary files (path, modificationTime, length, content) from ``documents`` (doc_id, text); ``rich``: one of each thing that a document may hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [rich_package(k, first_word(x)) if rich else package(x or "") for k, x in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame({"path": [f"{x}.docx" for x in b["doc_id"]], "length": list(map(len, content)), "content": content})

    # a small table may be one partition; making packages is worth all cores
    documents, cores = documents.select("doc_id", "text"), documents.sparkSession.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < cores:
        documents = documents.repartition(cores)
    made = documents.mapInPandas(run, "path string, length long, content binary")
    return made.select("path", F.lit("1980-01-01").cast("timestamp").alias("modificationTime"), "length", "content")
