"""A batch on the paragraphs of one package: what corpus tasks (plans.package) and the single-document handle run.

The state is an immutable tuple of paragraphs, so that undoing is keeping the old one. An
operation's place in the new order follows from its anchor, a slot before, at or after it,
and input order; nothing is moved.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from vellumite.errors import BatchOperationError, ParagraphNotFoundError, ValidationError, VellumiteError, preview
from vellumite.functions import match
from vellumite.functions.match import checked
from vellumite.functions.text import expand_visible_text, normalized
from vellumite.models import EditOperation, Operation, Selector
from vellumite.operators.inline import Paragraph, apply_text_op, new_paragraph, raw_paragraphs
from vellumite.plans.batch import LOG_LIMIT, PARAGRAPH_OPS, TEXT_OPS
from vellumite.sources.docx import W14, W, scan_xml

XMLNS = f'xmlns:w="{W}" xmlns:w14="{W14}"'


@dataclass(frozen=True)
class Row:
    """A paragraph; ``span`` is null once its bytes are no longer those of the source.

    ``host`` and ``side``: before (-1), at (0) or after (1) which paragraph of the source it stands.
    """

    id: str
    xml: str
    text: str
    style_id: str | None
    ppr: str
    rpr: str
    container: int
    protected: tuple[str, ...]
    span: tuple[int, int] | None
    host: str = ""
    side: int = 0

    @classmethod
    def of(cls, r: dict) -> Row:
        return cls(r["id"], r["xml"], r["text"], r["style_id"], r["ppr_xml"], r["rpr_xml"], r["container"], tuple(r["protected"]), (r["span"]["start"], r["span"]["end"]), r["id"])

    @classmethod
    def made(cls, id_: str, xml: str, like: Row, side: int = 0) -> Row:
        """A new paragraph beside ``like``, or ``like`` itself with another content."""
        r = scan_xml(f"<w:body {XMLNS}>{xml}</w:body>".encode())[0]
        return replace(cls.of(r | {"id": id_}), xml=xml, container=like.container, span=None, host=like.host, side=side if like.host == like.id else like.side)


@dataclass(frozen=True)
class Result:
    op_id: str
    op: str
    seq: int
    target_id: str | None = None
    target_ids: tuple[str, ...] = ()
    new_ids: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    before_preview: str | None = None
    after_previews: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    rows: tuple[Row, ...]
    next_id: int

    @classmethod
    def of(cls, rows: Iterable[dict]) -> State:
        rows = tuple(Row.of(r) for r in rows)
        return cls(rows, len(rows) + 1)


def _fail(seq: int, op: Operation, reason: str, cause: Exception | None = None) -> BatchOperationError:
    return BatchOperationError(operation_index=seq, op_id=op.op_id, reason=f"{op.op}: {reason}", rolled_back=True, cause=cause)


def prevalidate(ops: list[Operation], ids: set[str]) -> None:
    """The first faulty operation by input order."""
    if not ops:
        raise ValidationError(stage="prevalidation", checks=("nonempty",), failed_check="nonempty")
    for seq, o in enumerate(ops):
        targets = o.target_ids if o.op == "delete_para" else (o.target_id,)
        if o.raw and o.op not in PARAGRAPH_OPS:
            raise _fail(seq, o, "takes no raw content")
        if o.op in PARAGRAPH_OPS:
            if not o.items:
                raise _fail(seq, o, "needs one item or more")
            if any((x.content_literal is None) == (x.content_ref is None) for x in o.items):
                raise _fail(seq, o, "each item has either literal content or a reference")
        elif o.op == "delete_para":
            if not targets:
                raise _fail(seq, o, "needs one target or more")
            if len({*targets}) < len(targets):
                raise _fail(seq, o, "names a target twice")
        elif o.op not in TEXT_OPS:
            raise _fail(seq, o, "no such operation")
        elif o.op != "delete_text" and (o.content is None or (o.content.content_literal is None) == (o.content.content_ref is None)):
            raise _fail(seq, o, "has either literal content or a reference")
        for t in targets:
            if t not in ids:
                raise _fail(seq, o, f"no paragraph {t!r}")
        if o.op in TEXT_OPS:
            if o.occurrence is not None and (isinstance(o.occurrence, bool) or not isinstance(o.occurrence, int)):
                raise _fail(seq, o, "occurrence is no whole number")
            if o.occurrence is not None and o.occurrence < -1:
                raise _fail(seq, o, "occurrence is below -1")
            try:
                checked(o.find.pattern, o.find.regex)
            except VellumiteError as e:
                raise _fail(seq, o, f"cannot search: {e.reason}", e) from e


def _order(ops: list[Operation]) -> dict[str, list[tuple[int, Operation]]]:
    """Operations by anchor, anchors by first use; raises where they exclude each other."""
    groups: dict[str, list[tuple[int, Operation]]] = {}
    for seq, o in enumerate(ops):
        for t in o.target_ids if o.op == "delete_para" else (o.target_id,):
            groups.setdefault(t, []).append((seq, o))
    for group in groups.values():
        by = {k: [(s, o) for s, o in group if o.op == k] for k in ("replace_para", "delete_para", "insert_para_after")}
        both = sorted(by["replace_para"][:1] + by["delete_para"][:1], key=lambda x: x[0])
        for found in (by["replace_para"][1:2], by["delete_para"][1:2], both[1:2], by["insert_para_after"][:1] if by["delete_para"] else []):
            if found:
                raise _fail(*found[0], "two operations exclude each other on one paragraph")
    return groups


_PHASE = {"insert_para_before": 0, "insert_para_after": 1, "replace_para": 3, "delete_para": 4}


def run_batch(state: State, ops: list[Operation], contents: list[list[str]], normalize_text: bool = False) -> tuple[State, list[Result]]:
    """The state after all operations, and their results in input order; raises with nothing changed.

    ``contents``: the resolved items, or the content, of each operation.
    """
    prevalidate(ops, {r.id for r in state.rows})
    groups = _order(ops)
    at = {r.id: k for k, r in enumerate(state.rows)}
    now = {r.id: r for r in state.rows}
    slots: dict[str, dict[int, list[Row]]] = {}
    results: dict[int, Result] = {}
    gone: set[str] = set()
    next_id, fired = state.next_id, set()
    shape = (lambda x: normalized(x)) if normalize_text else (lambda x: x)

    def donor(anchor: str, slot: int) -> Row:
        """Whose properties a new paragraph takes: before an anchor those of what stands before it among its siblings."""
        me = state.rows[at[anchor]]
        if slot == 0:
            before = slots.get(anchor, {}).get(0)
            if before:
                return before[-1]
            for r in reversed(state.rows[: at[anchor]]):
                if r.container == me.container:
                    after = slots.get(r.id, {})
                    stay = [] if r.id in gone else [now[r.id]]
                    rows = after.get(0, []) + after.get(1, stay) + after.get(2, [])
                    if rows:
                        return rows[-1]
        elif slot == 2 and slots.get(anchor, {}).get(2):
            return slots[anchor][2][-1]
        return now[anchor]

    def insert(seq: int, o: Operation, anchor: str, slot: int) -> list[Row]:
        nonlocal next_id
        like, made = donor(anchor, slot), []
        for content in contents[seq]:
            xmls = raw_paragraphs(content) if o.raw else [new_paragraph(shape(x), like.ppr, like.rpr, XMLNS) for x in expand_visible_text(content)]
            for xml in xmls:
                made.append(Row.made(f"p_{next_id:06d}", xml, state.rows[at[anchor]], slot - 1))
                next_id += 1
        return made

    for anchor, group in groups.items():
        for seq, o in sorted(group, key=lambda x: (_PHASE.get(x[1].op, 2), x[0])):
            if seq in fired:
                continue
            try:
                if anchor in gone:
                    raise ParagraphNotFoundError(target_id=anchor)
                before = preview(now[anchor].text)
                if o.op in PARAGRAPH_OPS:
                    slot = {"insert_para_before": 0, "replace_para": 1, "insert_para_after": 2}[o.op]
                    made = insert(seq, o, anchor, slot)
                    warnings = now[anchor].protected if o.op == "replace_para" else ()
                    slots.setdefault(anchor, {}).setdefault(slot, []).extend(made)
                    if o.op == "replace_para":
                        gone.add(anchor)
                    results[seq] = Result(o.op_id, o.op, seq, anchor, new_ids=tuple(r.id for r in made), warnings=warnings, before_preview=before, after_previews=tuple(preview(r.text) for r in made))
                elif o.op == "delete_para":
                    fired.add(seq)
                    missing = [t for t in o.target_ids if t in gone]
                    if missing:
                        raise ParagraphNotFoundError(target_id=missing[0])
                    first = preview(now[o.target_ids[0]].text)
                    gone |= {*o.target_ids}
                    results[seq] = Result(o.op_id, o.op, seq, target_ids=o.target_ids, before_preview=first)
                else:
                    p = Paragraph(now[anchor].xml, anchor)
                    was, becomes = apply_text_op(p, o.op, o.find.pattern, o.find.regex, shape(contents[seq][0]) if contents[seq] else "", o.occurrence, o.find)
                    now[anchor] = Row.made(anchor, p.xml(), now[anchor])
                    results[seq] = Result(o.op_id, o.op, seq, anchor, before_preview=was, after_previews=(becomes,))
            except VellumiteError as e:
                raise _fail(seq, o, str(e), e) from e
    rows: list[Row] = []
    for r in state.rows:
        own = slots.get(r.id, {})
        rows += own.get(0, []) + own.get(1, []) + ([] if r.id in gone else [now[r.id]]) + own.get(2, [])
    after = State(tuple(rows), next_id)
    precommit(state, after, {*groups}, gone, list(results.values()))
    return after, [results[k] for k in sorted(results)]


def precommit(before: State, after: State, touched: set[str], gone: set[str], results: list[Result]) -> None:
    """Raises ValidationError (stage ``commit``) unless the new state is what the operations say."""
    sha = lambda r: hashlib.sha256(r.xml.encode()).digest()
    new = {r.id: r for r in after.rows}
    expected = len(before.rows) - len(gone) + sum(len(r.new_ids) for r in results)
    checks = {
        "paragraph_count": len(after.rows) == expected == len(new),
        "removed_ids": not gone & {*new},
        "untouched_paragraphs": all(r.id in new and sha(new[r.id]) == sha(r) for r in before.rows if r.id not in touched),
    }
    failed = [k for k, ok in checks.items() if not ok]
    if failed:
        raise ValidationError(stage="commit", checks=tuple(checks), failed_check=failed[0])


def log_entries(results: list[Result]) -> list[dict]:
    """Log entries of a committed batch, by the shape that each kind of operation has; a log keeps its first LOG_LIMIT entries."""
    out = []
    for r in results:
        entry = {"op_id": r.op_id, "op": r.op, "status": "success", "warnings": list(r.warnings)}
        if r.op == "delete_para":
            entry |= {"target_ids": list(r.target_ids), "before": {"preview": r.before_preview}, "after": {"deleted_count": len(r.target_ids)}}
        elif r.new_ids:
            entry |= {"target_id": r.target_id, "before": {"preview": r.before_preview}, "after": {"inserted_count": len(r.new_ids), "previews": list(r.after_previews), "new_ids": list(r.new_ids)}}
        else:
            entry |= {"target_id": r.target_id, "before": {"preview": r.before_preview}, "after": {"preview": (r.after_previews or ("",))[0]}}
        out.append(entry)
    return out[:LOG_LIMIT]


def failure_entry(e: BatchOperationError, count: int) -> dict:
    return {"op": "batch", "status": "failed", "error_type": type(e.__cause__ or e).__name__, "operation_index": e.operation_index, "op_id": e.op_id, "reason": preview(e.reason), "rolled_back": True, "expected_paragraph_count": count, "actual_paragraph_count": count}


def replacements(state: State, find: Selector, content: str) -> tuple[list[Operation], int]:
    """A batch that replaces every match of the marked texts, and the number of matches."""
    checked(find.pattern, find.regex)
    compiled = re.compile(find.pattern if find.regex else re.escape(find.pattern), re.DOTALL)
    counts = {r.id: len(match.find(compiled, Paragraph(r.xml).marked_text(), True)) for r in state.rows}
    ops = [EditOperation.replace_text(k, find, content, occurrence=-1, op_id=f"replace_all_{k}") for k, n in counts.items() if n]
    return ops, sum(counts.values())


def splice(main: bytes, before: State, after: State) -> bytes:
    """The main part with edited paragraphs in it; all bytes outside of them, and untouched paragraphs, are the source's.

    ``before``: the state as scanned from ``main``.
    """
    beside: dict[tuple[str, int], list[Row]] = {}
    for r in after.rows:
        beside.setdefault((r.host, r.side), []).append(r)
    out: list[bytes] = []
    at = 0
    for r in before.rows:
        start, end = r.span
        if start < at:  # within one that is written already
            continue
        out.append(main[at:start])
        for side in (-1, 0, 1):
            out += [main[start:end] if x.span is not None else x.xml.encode() for x in beside.get((r.id, side), [])]
        at = end
    out.append(main[at:])
    return b"".join(out)
