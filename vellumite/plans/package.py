"""Batches over a corpus of packages: each is scanned, edited, rebuilt and checked in one task, and read once.

Only operations move: those of a package are gathered to one row and joined to its file, by a
broadcast where they are few; batches for all packages are joined to none. A refused batch leaves its package as it was and has an
``error``; content references are resolved on the driver, before anything is planned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumite.errors import BatchOperationError, SourceChangedError, VellumiteError
from vellumite.models import ContentItem, Operation, Selector
from vellumite.plans import batch
from vellumite.plans.document import Result, State, failure_entry, log_entries, replacements, run_batch, splice
from vellumite.sinks.docx import rebuilt
from vellumite.sources.content import ContentResolverConfig, resolve
from vellumite.sources.docx import Unreadable, main_part, scan_xml, utf8

_FIELDS = batch.OPERATIONS.split(", ", 1)[1] + ", raw boolean"
#: Operations of packages; ``seq`` orders those of one package.
OPERATIONS = "path string, " + _FIELDS
#: Operations in more rows than this are joined by a shuffle.
MOST_BROADCAST = 200_000

_RESULT = "struct<seq:int,op_id:string,op:string,target_id:string,target_ids:array<string>,new_ids:array<string>,warnings:array<string>,before_preview:string,after_previews:array<string>>"
_ENTRY = "struct<op_id:string,op:string,target_id:string,target_ids:array<string>,status:string,warnings:array<string>,before:string,after:array<string>,inserted_count:int,deleted_count:int,error_type:string,operation_index:int,reason:string,rolled_back:boolean,expected_paragraph_count:int,actual_paragraph_count:int>"
_ERROR = "struct<code:string,reason:string,error_type:string,operation_index:int,op_id:string>"
EDITED = f"path string, content binary, paragraphs int, replacements long, results array<{_RESULT}>, change_log array<{_ENTRY}>, warnings array<string>, error {_ERROR}"


def literal(spark: SparkSession, operations: Sequence[Operation], config: ContentResolverConfig) -> DataFrame:
    """Rows of OPERATIONS but ``path`` for one batch, its content references resolved here and now."""
    rows = []
    for seq, o in enumerate(operations):
        find = o.find or Selector(None, None)
        content = resolve([o.content], config)[0] if o.content else None
        rows.append((seq, o.op_id, o.op, o.target_id, list(o.target_ids), resolve(o.items, config), find.pattern, find.regex, content, o.occurrence, o.raw))
    return spark.createDataFrame(rows, _FIELDS)


def operation(o: dict) -> Operation:
    """Of a row of OPERATIONS; what is not in it is null."""
    o = dict.fromkeys((x.split()[0] for x in _FIELDS.split(", "))) | o
    some = lambda x: () if x is None else tuple(x)
    find = None if o["find"] is None else Selector(o["find"], bool(o["regex"]))
    content = None if o["content"] is None else ContentItem(o["content"])
    return Operation(o["op"], o["op_id"], o["target_id"], some(o["target_ids"]), tuple(map(ContentItem, some(o["items"]))), find, content, o["occurrence"], bool(o["raw"]))


def _entry(x: dict) -> dict:
    """A log entry in the columns of the log."""
    before, after = x.get("before", {}), x.get("after", {})
    return x | {"before": before.get("preview"), "after": after.get("previews", [after["preview"]] if "preview" in after else []), "inserted_count": after.get("inserted_count"), "deleted_count": after.get("deleted_count")}


def _result(r: Result) -> dict:
    return {k: list(x) if isinstance(x, tuple) else x for k, x in vars(r).items()}


class _File:
    """A package: what a scan finds in it, for all batches that are tried on it."""

    def __init__(self, path: str, content: bytes, was: dict | None) -> None:
        self.content, self.error = content, None
        try:
            if was is not None and (was["sha256"], was["size"]) != (hashlib.sha256(content).hexdigest(), len(content)):
                raise SourceChangedError(source_path=path)
            self.main = utf8(main_part(content))
            self.state = State.of(scan_xml(self.main))
        except (Unreadable, UnicodeError, LookupError) as e:
            self.error = {"code": "invalid_document", "reason": str(e), "error_type": "InvalidDocumentError"}
        except VellumiteError as e:
            self.error = {"code": e.code, "reason": str(e), "error_type": type(e).__name__}


def _contents(todo: Sequence[Operation]) -> list[list[str]]:
    return [[x.content_literal for x in (o.items or ((o.content,) if o.content else ()))] for o in todo]


def _edited(path: str, file: _File, todo: list[Operation], find: tuple[Selector, str] | None, normalize_text: bool) -> dict:
    """One row of EDITED."""
    out = {"path": path, "content": file.content, "paragraphs": None, "replacements": 0, "results": [], "change_log": [], "warnings": []}
    if file.error:
        return out | {"error": file.error}
    state = file.state
    out["paragraphs"] = count = len(state.rows)
    try:
        if find:
            todo, out["replacements"] = replacements(state, *find)
        if not todo:
            return out
        after, results = run_batch(state, todo, _contents(todo), normalize_text)
        package = rebuilt(file.content, splice(file.main, state, after))
        return out | {"content": package, "paragraphs": len(after.rows), "results": list(map(_result, results)), "change_log": list(map(_entry, log_entries(results))), "warnings": [w for r in results for w in r.warnings]}
    except Unreadable as e:
        return out | {"error": {"code": "invalid_document", "reason": str(e), "error_type": "InvalidDocumentError"}}
    except (UnicodeError, LookupError) as e:
        return out | {"error": {"code": "invalid_document", "reason": str(e), "error_type": "InvalidDocumentError"}}
    except BatchOperationError as e:
        entry = failure_entry(e, count)
        cause = e.__cause__
        error = {"code": cause.code if isinstance(cause, VellumiteError) else e.code, "reason": e.reason, "error_type": entry["error_type"], "operation_index": e.operation_index, "op_id": e.op_id}
        return out | {"replacements": 0, "change_log": [_entry(entry)], "error": error}
    except VellumiteError as e:
        return out | {"replacements": 0, "error": {"code": e.code, "reason": str(e), "error_type": type(e).__name__}}


def _run(files: DataFrame, find: tuple[Selector, str] | None, normalize_text: bool) -> DataFrame:
    """``files``: path, content, ops, was."""
    schema = StructType.fromDDL(EDITED)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(schema)
        for b in batches:
            for k in range(0, len(b), 64):  # some packages at a time are held twice
                rows = [_edited(path, _File(path, content, was), [operation(o) for o in ops or []], find, normalize_text) for path, content, ops, was in zip(*(x.to_pylist() for x in b.slice(k, 64).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], fields.field(n).type) for n in names], schema=fields)

    return files.select("path", "content", "ops", "was").mapInArrow(run, schema)


def _known(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Adds what a scan knew of the files (path, source), to be held against them."""
    if known is None:
        return files.withColumn("was", F.lit(None).cast("struct<sha256:string,size:long>"))
    was = known.groupBy("path").agg(F.first("source").alias("s")).select("path", F.struct(F.col("s.sha256").alias("sha256"), F.col("s.size").alias("size")).alias("was"))
    return files.join(was, "path", "left")


def edit_packages(files: DataFrame, operations: DataFrame, *, normalize_text: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Rows of EDITED for binary ``files``: every package with its operations done, or with an ``error`` and its old content.

    ``operations``: OPERATIONS (``raw`` may be missing). ``known``: of sources.docx.scan; a package that changed since is refused.
    """
    if "raw" not in operations.columns:
        operations = operations.withColumn("raw", F.lit(False))
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    by = operations.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("ops"))
    if operations.count() <= MOST_BROADCAST:
        by = F.broadcast(by)
    return _run(_known(files.select("path", "content").join(by, "path", "left"), known), None, normalize_text)


def edit_all_packages(files: DataFrame, batches: dict[str, Sequence[Operation]], *, normalize_text: bool = False, known: DataFrame | None = None, returned: Sequence[str] | None = None) -> DataFrame:
    """For every package and each of ``batches`` (by a name) a row of ``batch`` and EDITED, or of ``returned`` columns of it: the package as it is with that batch done.

    A package is read and scanned once; nothing is joined, as operations without a path are few and go with the task. Content references must be resolved.
    """
    fields = [f for f in StructType.fromDDL("batch string, " + EDITED).fields if returned is None or f.name in ("batch", *returned)]
    schema = StructType(fields)
    names = schema.fieldNames()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        step = max(1, 64 // max(1, len(batches)))  # some packages at a time are held for all their batches
        for b in rows:
            for k in range(0, len(b), step):
                made = []
                for path, content, was in zip(*(x.to_pylist() for x in b.slice(k, step).columns), strict=True):
                    file = _File(path, content, was)
                    made += [{"batch": name} | _edited(path, file, list(todo), None, normalize_text) for name, todo in batches.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in made], kinds.field(n).type) for n in names], schema=kinds)

    return _known(files.select("path", "content"), known).select("path", "content", "was").mapInArrow(run, schema)


def replace_all_packages(files: DataFrame, pattern: str, content: str, *, regex: bool = False, normalize_text: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Rows of EDITED with every match of the marked texts replaced, as one logged batch for each package."""
    rows = files.select("path", "content").withColumn("ops", F.lit(None).cast(f"array<struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>>"))
    return _run(_known(rows, known), (Selector(pattern, regex), content), normalize_text)


def as_files(edited: DataFrame) -> DataFrame:
    """Edited packages as binary files, for another scan."""
    return edited.where("error is null").select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.length("content").cast("long").alias("length"), "content")
