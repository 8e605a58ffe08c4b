"""Text edits inside one paragraph's XML.

A range of the marked text is isolated by cutting runs at its two ends, so that it covers
whole pieces; pieces are then removed or stepped around. Runs and wrappers that lose all
they held go; everything else stays as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from xml.dom import minidom
from xml.parsers.expat import ExpatError

from vellumite.errors import AmbiguousTextMatchError, InvalidContentError, TextNotFoundError, UnsupportedStructureError, preview
from vellumite.functions.match import checked, find
from vellumite.functions.text import ESCAPED_START, MARKER_END, MARKER_START, expand_visible_text, parse_markers
from vellumite.plans.batch import chosen
from vellumite.sources.docx import W14, W, scan_xml

_BREAKS = {"page": "PAGE_BREAK", "column": "COLUMN_BREAK"}
_REJECTED = {"w:hyperlink", "w:fldSimple", "w:fldChar", "w:instrText", "w:permStart", "w:permEnd", "w:del"}
_SURROUND = {"hyperlink", "ins", "fldSimple"}


@dataclass
class Piece:
    """A node that shows text: its run and its range of the marked text."""

    node: minidom.Element
    run: minidom.Element
    start: int
    end: int
    marker: str | None
    structures: tuple[str, ...]


def _is(node, *names: str) -> bool:
    return node.nodeType == node.ELEMENT_NODE and node.namespaceURI == W and node.localName in names


def _text(node: minidom.Element) -> str:
    return "".join(c.data for c in node.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE))


def _marked(node: minidom.Element) -> tuple[str, str | None]:
    if _is(node, "t"):
        return _text(node).replace(MARKER_START, ESCAPED_START), None
    kind = {"tab": "TAB", "cr": "CR"}.get(node.localName) or _BREAKS.get(node.getAttributeNS(W, "type"), "LINE_BREAK")
    return f"{MARKER_START}{kind}{MARKER_END}", kind


class Paragraph:
    """A parsed paragraph; ``xml`` must declare its namespaces."""

    def __init__(self, xml: str, target_id: str = "") -> None:
        self.target_id = target_id
        self.document = minidom.parseString(xml.encode())
        self.root = self.document.documentElement
        self.prefix = self.root.tagName.rpartition(":")[0]

    def xml(self) -> str:
        return self.root.toxml()

    def pieces(self) -> list[Piece]:
        out: list[Piece] = []

        def walk(node, run, around: tuple[str, ...]) -> None:
            for child in node.childNodes:
                if child.nodeType != child.ELEMENT_NODE or _is(child, "del", "instrText", "sdt", "pPr", "rPr"):
                    continue
                if _is(child, "t", "tab", "br", "cr") and run is not None:
                    text, marker = _marked(child)
                    if text:
                        at = out[-1].end if out else 0
                        out.append(Piece(child, run, at, at + len(text), marker, around))
                    continue
                more = (f"w:{child.localName}",) if _is(child, *_SURROUND) else ()
                walk(child, child if _is(child, "r") else run, around + more)

        walk(self.root, None, ())
        return out

    def marked_text(self) -> str:
        return "".join(_marked(p.node)[0] for p in self.pieces())

    def _new(self, name: str) -> minidom.Element:
        return self.document.createElementNS(W, f"{self.prefix}:{name}" if self.prefix else name)

    def _set_text(self, node: minidom.Element, text: str) -> None:
        while node.firstChild:
            node.removeChild(node.firstChild)
        node.appendChild(self.document.createTextNode(text))
        if text != text.strip():
            node.setAttribute("xml:space", "preserve")

    def _shell(self, run: minidom.Element) -> minidom.Element:
        """An empty run with the properties of another one."""
        out = run.cloneNode(False)
        for c in run.childNodes:
            if _is(c, "rPr"):
                out.appendChild(c.cloneNode(True))
        return out

    def _cut(self, at: int) -> None:
        """Makes runs begin or end at an offset of the marked text."""
        for p in self.pieces():
            if not p.start < at <= p.end or at == p.end and not any(q.run is p.run and q.start >= at for q in self.pieces()):
                continue
            first = p.node.nextSibling
            if at < p.end:
                # escaped markers are cut at their whole width only, which the range checks see to
                head, tail = (x.replace(ESCAPED_START, MARKER_START) for x in (_marked(p.node)[0][: at - p.start], _marked(p.node)[0][at - p.start :]))
                right = p.node.cloneNode(False)
                self._set_text(p.node, head)
                self._set_text(right, tail)
                p.run.insertBefore(right, first)
                first = right
            run = self._shell(p.run)
            while first is not None:
                after = first.nextSibling
                run.appendChild(first)
                first = after
            p.run.parentNode.insertBefore(run, p.run.nextSibling)
            return

    def _tidy(self, run: minidom.Element) -> None:
        """Removes a run that holds its properties alone, and an insertion that holds nothing."""
        if run.parentNode is None or any(not _is(c, "rPr") and c.nodeType == c.ELEMENT_NODE for c in run.childNodes):
            return
        parent = run.parentNode
        parent.removeChild(run)
        if _is(parent, "ins") and not any(c.nodeType == c.ELEMENT_NODE for c in parent.childNodes) and parent.parentNode is not None:
            parent.parentNode.removeChild(parent)

    def _run(self, content: str, like: minidom.Element) -> minidom.Element | None:
        """A run of text, breaks and markers with the properties of another one."""
        if not content:
            return None
        run = self._shell(like)
        for kind, x in parse_markers(content):
            if kind == "marker":
                node = self._new({"TAB": "tab", "CR": "cr"}.get(x, "br"))
                wide = {v: k for k, v in _BREAKS.items()}.get(x)
                if wide:
                    node.setAttributeNS(W, f"{self.prefix}:type" if self.prefix else "type", wide)
                run.appendChild(node)
                continue
            for k, line in enumerate(x.split("\n")):
                if k:
                    run.appendChild(self._new("br"))
                if line:
                    node = self._new("t")
                    self._set_text(node, line)
                    run.appendChild(node)
        return run

    def check(self, met: list[Piece], start: int, end: int) -> None:
        """Raises where a range meets what may not be edited or would cut a marker; ``met``: the pieces that it overlaps."""
        structures = {s for p in met for s in p.structures}
        if structures & _REJECTED:
            raise UnsupportedStructureError(target_id=self.target_id, structures=tuple(sorted(structures & _REJECTED)), matched_range=(start, end))
        fixed = [(p.start, p.end) for p in met if p.marker]
        fixed += [(p.start + m.start(), p.start + m.end()) for p in met if not p.marker for m in re.finditer(re.escape(ESCAPED_START), _marked(p.node)[0])]
        if any(a < x < b for a, b in fixed for x in (start, end)):
            raise UnsupportedStructureError(target_id=self.target_id, structures=("reserved_marker",), matched_range=(start, end))

    def _edit_within(self, p: Piece, op: str, start: int, end: int, content: str) -> None:
        """An edit inside one text node: its run is parted at most once."""
        marked = _marked(p.node)[0]
        a, b = (start - p.start if op != "insert_text_after" else end - p.start), (end - p.start if op != "insert_text_before" else start - p.start)
        head, tail = (x.replace(ESCAPED_START, MARKER_START) for x in (marked[:a], marked[b:]))
        run, place = p.run, p.run.nextSibling
        new = self._run(content, run)
        rest, following = self._shell(run), p.node.nextSibling
        if tail:
            right = p.node.cloneNode(False)
            self._set_text(right, tail)
            rest.appendChild(right)
        while following is not None:
            after = following.nextSibling
            rest.appendChild(following)
            following = after
        for x in (new, rest):
            if x is not None:
                run.parentNode.insertBefore(x, place)
        if head:
            self._set_text(p.node, head)
        else:
            run.removeChild(p.node)
        self._tidy(rest)
        self._tidy(run)
        p.end = p.start + a

    def edit(self, op: str, start: int, end: int, content: str, pieces: list[Piece] | None = None) -> None:
        """One range: replaced (or deleted), or content put before or after it.

        ``pieces``: the paragraph's, kept right for offsets below ``start`` for edits from right to left.
        """
        pieces = self.pieces() if pieces is None else pieces
        at = bisect_right(pieces, start, key=lambda p: p.start) - 1
        met = []
        while at < len(pieces) and pieces[at].start < end:
            met.append(pieces[at])
            at += 1
        self.check(met, start, end)
        if len(met) == 1 and not met[0].marker:
            return self._edit_within(met[0], op, start, end, content)
        self._cut(start)
        self._cut(end)
        touched = [p for p in self.pieces() if p.start < end and start < p.end]
        first, last = touched[0], touched[-1]
        like = first.run if op != "insert_text_after" else last.run
        new = self._run(content, like)
        if op == "insert_text_after":
            if new is not None:
                last.run.parentNode.insertBefore(new, last.run.nextSibling)
            pieces[:] = self.pieces()
            return
        if new is not None:
            place = first.run
            if op == "replace_text" and first.run.parentNode is not last.run.parentNode:
                while place.parentNode is not self.root:  # a run across wrappers belongs to none
                    place = place.parentNode
                self.root.insertBefore(new, place.nextSibling)
            else:
                place.parentNode.insertBefore(new, place)
        if op in ("replace_text", "delete_text"):
            for p in touched:
                p.run.removeChild(p.node)
            for run in {id(p.run): p.run for p in touched}.values():
                self._tidy(run)
        pieces[:] = self.pieces()


def apply_text_op(paragraph: Paragraph, op: str, pattern: str, regex: bool, content: str, occurrence: int | None, selector: object = None) -> tuple[str, str]:
    """Previews before and after one text operation; raises and may leave the paragraph half edited."""
    content = "\n".join(expand_visible_text(content)) if op != "delete_text" else ""
    parse_markers(content)
    checked(pattern, regex)
    before = paragraph.marked_text()
    found = find(re.compile(pattern if regex else re.escape(pattern), re.DOTALL), before, True)
    picked, error = chosen(found, occurrence)
    if error == "text_not_found":
        raise TextNotFoundError(target_id=paragraph.target_id, selector=selector or pattern, occurrence=occurrence, total_matches=len(found))
    if error:
        raise AmbiguousTextMatchError(target_id=paragraph.target_id, selector=selector or pattern, total_matches=len(found))
    pieces = paragraph.pieces()
    for start, end in picked:
        paragraph.edit(op, start, end, content, pieces)
    return preview(before), preview(paragraph.marked_text())


def new_paragraph(text: str, ppr: str, rpr: str, xmlns: str) -> str:
    """A paragraph's XML with a donor's properties; markers and newlines become their nodes."""
    owner = f'<w:p {xmlns}>{ppr}<w:r>{rpr}</w:r></w:p>'
    p = Paragraph(owner)
    shell = next(c for c in p.root.childNodes if _is(c, "r"))
    run = p._run(text, shell)
    if run is not None:
        p.root.insertBefore(run, shell)
    p.root.removeChild(shell)
    return p.xml()


def raw_paragraphs(fragment: str) -> list[str]:
    """The top-level paragraphs of a raw fragment; nothing else may stand beside them."""
    whole = f'<w:body xmlns:w="{W}" xmlns:w14="{W14}">{fragment}</w:body>'
    try:
        scan_xml(whole.encode())
        root = minidom.parseString(whole.encode()).documentElement
    except (ExpatError, Exception) as e:  # noqa: BLE001
        raise InvalidContentError(raw=True, reason=f"malformed fragment: {e}") from e
    nodes = [c for c in root.childNodes if c.nodeType == c.ELEMENT_NODE or c.nodeType == c.TEXT_NODE and c.data.strip()]
    if not nodes or any(not _is(c, "p") for c in nodes):
        raise InvalidContentError(raw=True, reason="a fragment must hold paragraphs and nothing else")
    for c in nodes:
        for prefix, uri in (("w", W), ("w14", W14)):
            c.setAttribute(f"xmlns:{prefix}", uri)
    return [c.toxml() for c in nodes]
