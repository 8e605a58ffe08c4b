"""Batches of edits, atomic for each document.

Operations are gathered to one row for each document and joined to its paragraphs, so that a
batch costs one move of the edited documents, and none of the others. Each document's first
fault by input order refuses its whole batch, all other documents get their edits. A new
paragraph's place follows from its anchor, a slot before, at or after it, and input order;
text edits on one paragraph see each other's results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from vellumite.errors import InvalidContentError, preview
from vellumite.functions import text as T
from vellumite.functions.match import find

OPERATIONS = "doc_id long, seq int, op_id string, op string, target_id string, target_ids array<string>, items array<string>, find string, regex boolean, content string, occurrence int"
PARAGRAPH_OPS = ("insert_para_before", "insert_para_after", "replace_para")
TEXT_OPS = ("replace_text", "delete_text", "insert_text_before", "insert_text_after")
LOG_LIMIT = 4096


@dataclass(frozen=True)
class Outcome:
    """paragraphs: of all documents afterwards. results: one row for each operation of a committed document. errors: one for each refused one."""

    paragraphs: DataFrame
    results: DataFrame
    errors: DataFrame

    def change_log(self) -> DataFrame:
        """Successful operations in input order, at most LOG_LIMIT a document, and one entry for each refused batch."""
        order = Window.partitionBy("doc_id").orderBy("seq")
        done = self.results.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LOG_LIMIT)
        done = done.select("doc_id", "seq", "op_id", "op", F.lit("success").alias("status"), F.lit(None).cast("string").alias("reason"))
        failed = self.errors.select("doc_id", F.col("operation_index").alias("seq"), "op_id", F.lit("batch").alias("op"), F.lit("failed").alias("status"), T.preview(F.col("reason")).alias("reason"))
        return done.unionByName(failed)


def edited(text: str, op: str, start: int, end: int, content: str) -> str:
    """One range of a text edited."""
    keep = text[start:end] if op.startswith("insert") else ""
    before, after = (content, "") if op == "insert_text_before" else ("", content)
    return text[:start] + before + keep + after + text[end:]


def plain(content: str | None) -> str:
    """What markers in content stand for; blank lines are one newline, as text edits make no paragraphs."""
    joined = "\n".join(T.expand_visible_text(content or ""))
    return "".join(T.MARKERS[x] if kind == "marker" else x for kind, x in T.parse_markers(joined))


def chosen(found: list[tuple[int, int]], occurrence: int | None) -> tuple[list[tuple[int, int]], str | None]:
    """The matches meant, rightmost first; an error code where there are none or too many."""
    if not found:
        return [], "text_not_found"
    if occurrence is None:
        return (found, None) if len(found) == 1 else ([], "ambiguous_text_match")
    if occurrence == -1:
        return found[::-1], None
    return ([found[occurrence]], None) if occurrence < len(found) else ([], "text_not_found")


def _shape_fault(o: dict, known: set[str]) -> str | None:
    """What is wrong with one operation by itself."""
    op, targets = o["op"], _targets(o)
    text = op in TEXT_OPS
    if op not in (*PARAGRAPH_OPS, *TEXT_OPS, "delete_para"):
        return "no such operation"
    if op in PARAGRAPH_OPS and not o["items"]:
        return "needs one item or more"
    if op == "delete_para" and not targets:
        return "needs one target or more"
    if len({*targets}) < len(targets):
        return "names a target twice"
    if text and op != "delete_text" and o["content"] is None:
        return "has either literal content or a reference"
    if any(t not in known for t in targets):
        return "no such paragraph"
    if text and o["occurrence"] is not None and o["occurrence"] < -1:
        return "occurrence is below -1"
    if text and not o["regex"] and not o["find"]:
        return "cannot search: an empty literal"
    if o["regex"]:
        try:
            re.compile(o["find"] or "")
        except re.error as e:
            return f"cannot search: {e}"
    return None


def _targets(o: dict) -> list[str]:
    return list(o["target_ids"] or ()) if o["op"] == "delete_para" else [o["target_id"]]


def _clashes(group: list[dict]) -> list[int]:
    """The operations to blame where operations on one paragraph exclude each other."""
    by = {k: [o["seq"] for o in group if o["op"] == k] for k in ("replace_para", "delete_para", "insert_para_after")}
    replaces, deletes, afters = by.values()
    both = [max(replaces[0], deletes[0])] if replaces and deletes else []
    return [*replaces[1:2], *deletes[1:2], *both, *(afters[:1] if deletes else [])]


def edit_document(rows: list[dict], ops: list[dict]) -> tuple[list[dict], list[dict], dict | None]:
    """One document's paragraphs (id, record_pos, style_id, text, in order) after its operations, their results, and the fault that refuses them all."""
    ops = sorted(ops, key=lambda o: o["seq"])
    by_id = {r["id"]: r for r in rows}
    faults: list[tuple[int, int, str]] = []

    def refused() -> tuple[list[dict], list[dict], dict]:
        _, seq, reason = min(faults)
        return rows, [], {"operation_index": seq, "op_id": next(o["op_id"] for o in ops if o["seq"] == seq), "reason": reason}

    for o in ops:
        if fault := _shape_fault(o, {*by_id}):
            faults.append((0, o["seq"], f"{o['op']}: {fault}"))
    if faults:
        return refused()
    # operations by the paragraph that they meet at, in the order of first use
    groups: dict[str, list[dict]] = {}
    for o in ops:
        for t in _targets(o):
            groups.setdefault(t, []).append(o)
    rank = {t: k for k, t in enumerate(groups)}
    faults += [(1, seq, "two operations exclude each other on one paragraph") for group in groups.values() for seq in _clashes(group)]
    if faults:
        return refused()
    # a delete of several targets fires at the first one visited; what comes later to another of them finds it gone
    for o in ops:
        if o["op"] == "delete_para":
            fires = min(rank[t] for t in _targets(o))
            late = [[x["seq"] for x in groups[t] if x["op"] != "delete_para"] for t in _targets(o) if rank[t] > fires]
            faults += [(2, x[0], "its paragraph is deleted before") for x in late if x]
    # text edits see each other's results
    texts: dict[str, str] = {}
    steps: dict[int, tuple[str, str]] = {}
    for t, group in groups.items():
        now = by_id[t]["text"]
        for o in group:
            if o["op"] not in TEXT_OPS:
                continue
            before = now
            pattern = re.compile(o["find"] if o["regex"] else re.escape(o["find"]), re.DOTALL)
            try:
                content = "" if o["op"] == "delete_text" else plain(o["content"])
                picked, fault = chosen(find(pattern, now, True), o["occurrence"])
            except InvalidContentError as e:
                picked, fault = [], f"{e.code}: {e.reason}"
            if fault:
                faults.append((2, o["seq"], fault))
                break
            for a, b in picked:
                now = edited(now, o["op"], a, b, content)
            steps[o["seq"]] = preview(before), preview(now)
        texts[t] = now
    if faults:
        return refused()
    gone = {t for o in ops if o["op"] in ("delete_para", "replace_para") for t in _targets(o)}
    place = {r["id"]: k for k, r in enumerate(rows)}
    last = max((int(r["id"][2:]) for r in rows if r["id"][2:].isdigit()), default=0)
    made: dict[int, list[dict]] = {}
    slots: dict[tuple[str, int], list[dict]] = {}
    for t, group in groups.items():
        for o in sorted((o for o in group if o["op"] in PARAGRAPH_OPS), key=lambda o: (_PHASE[o["op"]], o["seq"])):
            style = by_id[t]["style_id"]
            if o["op"] == "insert_para_before" and place[t]:
                above = rows[place[t] - 1]["style_id"]
                style = style if above is None else above
            for item in o["items"]:
                for text in T.expand_visible_text(item):
                    last += 1
                    row = {"id": f"p_{last:06d}", "style_id": style, "text": text}
                    made.setdefault(o["seq"], []).append(row)
                    slots.setdefault((t, _SLOT[o["op"]]), []).append(row)
    after: list[dict] = []
    for r in rows:
        mine = [{"id": r["id"], "style_id": r["style_id"], "text": texts.get(r["id"], r["text"])}] if r["id"] not in gone else []
        before, instead, behind = (slots.get((r["id"], k), []) for k in range(3))
        after += [*before, *instead, *mine, *behind]
    results = []
    for o in ops:
        new, (was, becomes) = made.get(o["seq"], []), steps.get(o["seq"], (None, None))
        first = by_id[_targets(o)[0]]
        results.append({"seq": o["seq"], "op_id": o["op_id"], "op": o["op"], "target_id": o["target_id"], "target_ids": _targets(o) if o["op"] == "delete_para" else [], "new_ids": [x["id"] for x in new], "before_preview": preview(first["text"]) if was is None else was, "after_previews": [preview(x["text"]) for x in new] or ([] if becomes is None else [becomes])})
    return after, results, None


_PHASE = {"insert_para_before": 0, "insert_para_after": 1, "replace_para": 2}
_SLOT = {"insert_para_before": 0, "replace_para": 1, "insert_para_after": 2}
_RESULT = "seq int, op_id string, op string, target_id string, target_ids array<string>, new_ids array<string>, before_preview string, after_previews array<string>"
_KERNEL = f"rows array<struct<id:string,style_id:string,text:string>>, results array<struct<{_RESULT.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>, error struct<operation_index:int,op_id:string,reason:string>"


def apply(paragraphs: DataFrame, operations: DataFrame) -> Outcome:
    """Edits ``paragraphs`` (see sources.corpus) by ``operations`` (OPERATIONS); ``seq`` orders a document's operations.

    Paragraphs of documents without operations pass through and are not moved; of the others each document is gathered once and edited in one task.
    """
    rows = paragraphs.select("doc_id", "id", "record_pos", "style_id", "text")
    names = [x.split()[0] for x in OPERATIONS.split(", ")[1:]]
    ops = operations.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("ops"))
    own = rows.join(ops.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("record_pos", "id", "style_id", "text"))).alias("rows"))
    both = ops.join(own, "doc_id", "left").select("doc_id", "rows", "ops")
    key = both.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", key), *StructType.fromDDL(_KERNEL).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(schema)
        for batch in batches:
            for k in range(0, len(batch), 500):
                some = batch.slice(k, 500)
                done = [edit_document(r or [], o) for r, o in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([x[j] for x in done], fields.field(j + 1).type) for j in range(3))], schema=fields)

    done = both.mapInArrow(run, schema)
    place = (F.col("pos") + 1).cast("int")
    after = done.select("doc_id", F.posexplode("rows").alias("pos", "r")).select("doc_id", "r.id", place.alias("record_pos"), place.alias("global_ordinal"), "r.style_id", "r.text")
    rest = rows.join(ops.select("doc_id"), "doc_id", "left_anti").select("doc_id", "id", F.col("record_pos").cast("int").alias("record_pos"), F.col("record_pos").cast("int").alias("global_ordinal"), "style_id", "text")
    results = done.select("doc_id", F.explode("results").alias("r")).select("doc_id", "r.*")
    errors = done.where("error is not null").select("doc_id", "error.operation_index", "error.op_id", "error.reason", F.lit(True).alias("rolled_back"))
    return Outcome(after.unionByName(rest), results, errors)


def precommit(before: DataFrame, outcome: Outcome, operations: DataFrame) -> DataFrame:
    """Checks of each document that hold after a sound commit: untouched paragraphs by hash, deleted and replaced ones gone, the count as expected."""
    is_delete = F.col("op") == "delete_para"
    touched = operations.select("doc_id", F.explode(F.when(is_delete, F.col("target_ids")).otherwise(F.array("target_id"))).alias("id"), "op")
    good = touched.join(outcome.errors.select("doc_id"), "doc_id", "left_anti")
    sha = F.sha2("text", 256)
    old = before.select("doc_id", "id", sha.alias("was")).join(good.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")
    new = outcome.paragraphs.select("doc_id", "id", sha.alias("is"))
    same = old.join(new, ["doc_id", "id"], "left").groupBy("doc_id").agg(F.count("*").alias("untouched"), F.count_if(F.col("was") == F.col("is")).alias("unchanged"))
    gone = good.where(is_delete | (F.col("op") == "replace_para")).select("doc_id", "id").distinct().join(new, ["doc_id", "id"]).groupBy("doc_id").agg(F.count("*").alias("left_over"))
    made = outcome.results.groupBy("doc_id").agg(F.sum(F.size("new_ids") - F.size("target_ids") - (F.col("op") == "replace_para").cast("int")).alias("delta"))
    counts = before.groupBy("doc_id").agg(F.count("*").alias("n_before")).join(outcome.paragraphs.groupBy("doc_id").agg(F.count("*").alias("n_after")), "doc_id", "left")
    out = counts.join(same, "doc_id", "left").join(gone, "doc_id", "left").join(made, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", (zero("untouched") == zero("unchanged")).alias("hashes_ok"), (zero("left_over") == 0).alias("removed_ok"), (zero("n_after") == zero("n_before") + zero("delta")).alias("count_ok"), zero("untouched").alias("untouched"))


def replace_all(paragraphs: DataFrame, pattern: str, content: str, regex: bool = False) -> DataFrame:
    """All matches replaced by literal content, with the number of them, in built-in functions where the pattern allows."""
    from vellumite.functions import match

    content = plain(content)
    counts = match.count(F.col("text"), pattern, regex)
    if regex and match.built_in(pattern):
        text = F.regexp_replace("text", match.EDIT_FLAGS + match.java(pattern), match.replacement(content))
        counts = F.regexp_count("text", F.lit(match.EDIT_FLAGS + match.java(pattern))).cast("long")
    elif regex:
        ranges = match.ranges(F.col("text"), pattern, True, edit=True)
        text, counts = match.spliced(F.col("text"), ranges, instead=content), F.size(ranges).cast("long")
    else:
        text = F.replace(F.col("text"), F.lit(pattern), F.lit(content))
    return paragraphs.withColumns({"replacements": counts, "text": text})
