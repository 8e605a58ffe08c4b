"""Operations, selectors and content as values; batches as JSON."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from vellumite.errors import ValidationError


@dataclass(frozen=True)
class Selector:
    """What to look for; a plain string means itself."""

    pattern: str
    regex: bool = False

    @classmethod
    def coerce(cls, x: Selector | str | Mapping[str, Any]) -> Selector:
        if isinstance(x, Selector):
            return x
        if isinstance(x, str):
            return cls(x)
        if isinstance(x, Mapping) and isinstance(x.get("pattern"), str) and set(x) <= {"pattern", "regex"} and isinstance(x.get("regex", False), bool):
            return cls(x["pattern"], x.get("regex", False))
        raise TypeError("a selector is a string, or has a pattern and maybe regex")


@dataclass(frozen=True)
class ContentSourceJsonPath:
    source: str
    path: str


@dataclass(frozen=True)
class ContentSourceFile:
    path: str
    encoding: str = "utf-8"


@dataclass(frozen=True)
class ContentSourceCommand:
    argv: tuple[str, ...]
    timeout_seconds: float = 30.0
    env: Mapping[str, str] = field(default_factory=dict)
    cwd: str | None = None


ContentRef = ContentSourceJsonPath | ContentSourceFile | ContentSourceCommand
_SOURCES = {"jsonpath": ContentSourceJsonPath, "file": ContentSourceFile, "command": ContentSourceCommand}


def content_ref(x: Any) -> ContentRef:
    """From a mapping with a ``type``."""
    if isinstance(x, ContentRef):
        return x
    if not isinstance(x, Mapping) or x.get("type") not in _SOURCES:
        raise TypeError("a content reference has a type: jsonpath, file or command")
    values = {k: v for k, v in x.items() if k != "type"}
    kind = _SOURCES[x["type"]]
    if set(values) - {f.name for f in dataclasses.fields(kind)}:
        raise TypeError(f"unknown fields of a {x['type']} reference")
    if kind is ContentSourceCommand:
        argv, timeout = values.get("argv"), values.get("timeout_seconds", 30.0)
        if not isinstance(argv, Sequence) or isinstance(argv, str) or not argv or not all(isinstance(a, str) for a in argv):
            raise TypeError("argv is a list of one string or more")
        if isinstance(timeout, bool) or not isinstance(timeout, (int, float)):
            raise TypeError("timeout_seconds is a number")
        values["argv"] = tuple(argv)
    elif not all(isinstance(v, str) for v in values.values()):
        raise TypeError(f"fields of a {x['type']} reference are strings")
    return kind(**values)


@dataclass(frozen=True)
class ContentItem:
    """Literal content, or a reference to it: just one of them."""

    content_literal: str | None = None
    content_ref: ContentRef | None = None

    @classmethod
    def of(cls, x: Any) -> ContentItem:
        if isinstance(x, ContentItem):
            return x
        if isinstance(x, str):
            return cls(x)
        if isinstance(x, Mapping) and set(x) <= {"content_literal", "content_ref"}:
            ref = x.get("content_ref")
            return cls(x.get("content_literal"), None if ref is None else content_ref(ref))
        return cls(content_ref=content_ref(x))


@dataclass(frozen=True)
class Operation:
    """One write; the fields that its kind does not use are empty."""

    op: str
    op_id: str = ""
    target_id: str | None = None
    target_ids: tuple[str, ...] = ()
    items: tuple[ContentItem, ...] = ()
    find: Selector | None = None
    content: ContentItem | None = None
    occurrence: int | None = None
    raw: bool = False


class EditOperation:
    """Makes operations."""

    @staticmethod
    def _paragraph(kind: str):
        def make(target_id: str, items: Any, *, op_id: str = "", raw: bool = False) -> Operation:
            items = [items] if isinstance(items, (str, ContentItem, Mapping)) else items
            return Operation(kind, op_id, target_id, items=tuple(map(ContentItem.of, items)), raw=raw)

        return staticmethod(make)

    @staticmethod
    def delete_para(target_ids: str | Sequence[str], *, op_id: str = "") -> Operation:
        return Operation("delete_para", op_id, target_ids=(target_ids,) if isinstance(target_ids, str) else tuple(target_ids))

    @staticmethod
    def delete_text(target_id: str, find: Any, *, occurrence: int | None = None, op_id: str = "") -> Operation:
        return Operation("delete_text", op_id, target_id, find=Selector.coerce(find), occurrence=occurrence)

    @staticmethod
    def _textual(kind: str):
        def make(target_id: str, find: Any, content: Any, *, occurrence: int | None = None, op_id: str = "") -> Operation:
            return Operation(kind, op_id, target_id, find=Selector.coerce(find), content=ContentItem.of(content), occurrence=occurrence)

        return staticmethod(make)


for _kind in ("insert_para_before", "insert_para_after", "replace_para"):
    setattr(EditOperation, _kind, EditOperation._paragraph(_kind))
for _kind in ("replace_text", "insert_text_before", "insert_text_after"):
    setattr(EditOperation, _kind, EditOperation._textual(_kind))

_STRING = {"type": "string", "minLength": 1}
_REFERENCE = {"type": "object", "required": ["type"], "properties": {"type": {"enum": sorted(_SOURCES)}}}
_ONE = {"type": "object", "additionalProperties": False, "properties": {"content_literal": {"type": "string"}, "content_ref": _REFERENCE}, "minProperties": 1, "maxProperties": 1}
_SELECTOR = {"type": "object", "additionalProperties": False, "required": ["pattern"], "properties": {"pattern": {"type": "string"}, "regex": {"type": "boolean"}}}


def _shape(op: str) -> dict[str, Any]:
    fields: dict[str, Any] = {"op_id": _STRING, "op": {"const": op}}
    if op == "delete_para":
        fields["target_ids"] = {"type": "array", "minItems": 1, "uniqueItems": True, "items": _STRING}
    else:
        fields["target_id"] = _STRING
    if op in ("insert_para_before", "insert_para_after", "replace_para"):
        fields["items"] = {"type": "array", "minItems": 1, "items": _ONE}
    required = list(fields)
    if op.endswith("_text") or op.startswith("insert_text"):
        fields["find"] = _SELECTOR
        required.append("find")
        fields["occurrence"] = {"type": "integer", "minimum": -1}
        if op != "delete_text":
            fields |= {"content_literal": {"type": "string"}, "content_ref": _REFERENCE}
    return {"type": "object", "additionalProperties": False, "required": required, "properties": fields}


OPERATION_SHAPES = {op: _shape(op) for op in ("insert_para_before", "insert_para_after", "replace_para", "delete_para", "replace_text", "delete_text", "insert_text_before", "insert_text_after")}
#: JSON Schema of a batch; content_literal and content_ref exclude each other.
BATCH_SCHEMA = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "batch", "type": "object", "additionalProperties": False, "required": ["operations"], "properties": {"operations": {"type": "array", "minItems": 1, "items": {"oneOf": list(OPERATION_SHAPES.values())}}}}


def _faults(x: Any, shape: Mapping[str, Any], at: str) -> list[str]:
    """What a value has against the part of JSON Schema that is used here."""
    kinds = {"object": Mapping, "array": list, "string": str, "boolean": bool, "integer": int}
    kind = shape.get("type")
    if kind and (not isinstance(x, kinds[kind]) or kind == "integer" and isinstance(x, bool)):
        return [f"{at}: not of type {kind}"]
    out = []
    if "const" in shape and x != shape["const"] or "enum" in shape and x not in shape["enum"]:
        out.append(f"{at}: not an allowed value")
    if kind == "object":
        known = shape.get("properties", {})
        out += [f"{at}: {k!r} is a required property" for k in shape.get("required", ()) if k not in x]
        out += [f"{at}: unexpected property {k!r}" for k in x if k not in known and shape.get("additionalProperties") is False]
        out += [f"{at}: just one property is allowed"] if not shape.get("minProperties", 0) <= len(x) <= shape.get("maxProperties", len(x)) else []
        for k, v in x.items():
            out += _faults(v, known[k], f"{at}/{k}") if k in known else []
    elif kind == "array":
        out += [f"{at}: too few items"] if len(x) < shape.get("minItems", 0) else []
        out += [f"{at}: items are not unique"] if shape.get("uniqueItems") and len({repr(y) for y in x}) < len(x) else []
        for k, v in enumerate(x):
            out += _faults(v, shape.get("items", {}), f"{at}/{k}")
    elif kind == "string" and len(x) < shape.get("minLength", 0) or kind == "integer" and x < shape.get("minimum", x):
        out.append(f"{at}: too small")
    return out


def validate_batch(payload: Any) -> None:
    """Raises ValidationError (stage ``batch_schema``) with all faults, the first one named."""
    shape = BATCH_SCHEMA | {"properties": {"operations": {"type": "array", "minItems": 1}}}
    faults = _faults(payload, shape, "<root>")
    for k, x in enumerate(payload["operations"] if not faults else ()):
        at = f"operations/{k}"
        op = x.get("op") if isinstance(x, Mapping) else None
        if op not in OPERATION_SHAPES:
            faults.append(f"{at}: no such operation: {op!r}")
            continue
        faults += _faults(x, OPERATION_SHAPES[op], at)
        if "content_literal" in OPERATION_SHAPES[op]["properties"] and ("content_literal" in x) == ("content_ref" in x):
            faults.append(f"{at}: exactly one of content_literal and content_ref is required")
    if faults:
        raise ValidationError(stage="batch_schema", checks=tuple(faults), failed_check=faults[0])


def operations_from_json(payload: Mapping[str, Any]) -> list[Operation]:
    """A valid batch as operations, in its order."""
    validate_batch(payload)
    out = []
    for x in payload["operations"]:
        content = ContentItem.of({k: x[k] for k in ("content_literal", "content_ref") if k in x}) if "content_literal" in x or "content_ref" in x else None
        out.append(Operation(x["op"], x["op_id"], x.get("target_id"), tuple(x.get("target_ids", ())), tuple(map(ContentItem.of, x.get("items", ()))), Selector.coerce(x["find"]) if "find" in x else None, content, x.get("occurrence")))
    return out
