"""Structured errors, one code each."""

from __future__ import annotations

from typing import Any, ClassVar


def preview(text: str, limit: int = 80) -> str:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return text if len(text) <= limit else text[: limit - 1] + "…"


class VellumiteError(Exception):
    """Base of all errors; the fields are attributes and keyword arguments."""

    code: ClassVar[str] = "vellumite_error"
    fields: ClassVar[tuple[str, ...]] = ()

    def __init__(self, **values: Any) -> None:
        for name in self.fields:
            setattr(self, name, values.pop(name, None))
        self.__cause__ = values.pop("cause", None)
        if values:
            raise TypeError(f"{type(self).__name__} has no {', '.join(values)}")
        super().__init__(f"{self.code}: " + ", ".join(f"{f}={getattr(self, f)!r}" for f in self.fields))

    def __reduce__(self):
        return _rebuild, (type(self), {f: getattr(self, f) for f in self.fields})

    def to_dict(self) -> dict[str, Any]:
        """The code and the fields, as JSON can hold them."""
        return {"code": self.code} | {f: _plain(getattr(self, f)) for f in self.fields}


def _rebuild(kind: type[VellumiteError], values: dict) -> VellumiteError:
    return kind(**values)


def _plain(x: Any) -> Any:
    if hasattr(x, "pattern") and hasattr(x, "regex"):
        return {"pattern": preview(x.pattern), "regex": x.regex}
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x if x is None or isinstance(x, (bool, int, float, str, dict)) else str(x)


def _error(name: str, code: str, *fields: str, doc: str) -> type[VellumiteError]:
    return type(name, (VellumiteError,), {"code": code, "fields": fields, "__doc__": doc, "__module__": __name__})


DocumentNotFoundError = _error("DocumentNotFoundError", "document_not_found", "path", doc="No such file.")
InvalidDocumentError = _error("InvalidDocumentError", "invalid_document", "path", "reason", doc="Not a readable package.")
SourceChangedError = _error("SourceChangedError", "source_changed", "source_path", doc="The source is no longer what was opened.")
ParagraphNotFoundError = _error("ParagraphNotFoundError", "paragraph_not_found", "target_id", doc="No paragraph has this id.")
TextNotFoundError = _error("TextNotFoundError", "text_not_found", "target_id", "selector", "occurrence", "total_matches", doc="Nothing, or too little, matches.")
AmbiguousTextMatchError = _error("AmbiguousTextMatchError", "ambiguous_text_match", "target_id", "selector", "total_matches", doc="Several matches where one is meant.")
InvalidPatternError = _error("InvalidPatternError", "invalid_pattern", "pattern", "reason", doc="A pattern that cannot be searched for.")
InvalidContentError = _error("InvalidContentError", "invalid_content", "raw", "reason", doc="Content that cannot be put in.")
UnsupportedStructureError = _error("UnsupportedStructureError", "unsupported_structure", "target_id", "structures", "matched_range", doc="The range meets a structure that may not be edited.")
BatchOperationError = _error("BatchOperationError", "batch_operation_error", "operation_index", "op_id", "reason", "rolled_back", doc="A batch was refused or rolled back.")
ValidationError = _error("ValidationError", "validation_error", "stage", "checks", "failed_check", doc="A check failed.")
