"""Match ranges of literals and regular expressions as columns.

A range is ``struct<start:int,end:int>`` of code-point offsets. Literals, and patterns that
can be put so that Java finds what Python does and that cannot match nothing, are matched by
built-in functions; all others go through an Arrow UDF with Python's ``re``.
"""

from __future__ import annotations

import re
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumite.errors import InvalidPatternError

RANGES = "array<struct<start:int,end:int>>"
#: Unix lines: Python's rule; edits let "." match newlines as well.
READ_FLAGS, EDIT_FLAGS = "(?d)", "(?ds)"
_PYTHON_ONLY = re.compile(r"\(\?P|\(\?\(|\(\?[a-zA-Z-]+[:)]|\{,")
_NESTED_CLASS = re.compile(r"\[[^\]\\]*(?:\\.[^\]\\]*)*\[|&&")
#: What Python's classes hold, for Java.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}
_EDGES = {"b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))", "B": f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"}
_SAME = {**dict.fromkeys("nrtfa", None), "v": r"\x0B"}


def java(pattern: str) -> str | None:
    """A Java pattern that finds the same ranges as Python's, none of them empty; null where it is not known to."""
    if _PYTHON_ONLY.search(pattern) or _NESTED_CLASS.search(pattern) or _parser.parse(pattern).getwidth()[0] == 0:
        return None
    out, at, within = [], 0, 0  # within: a class that began there
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            x = pattern[at + 1]
            at += 2
            if x in _CLASSES:
                out.append(_CLASSES[x] if within else f"[{_CLASSES[x]}]")
            elif x.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[x.lower()]}]")
            elif x in _EDGES and not within:
                out.append(_EDGES[x])
            elif x in _SAME:
                out.append(_SAME[x] or "\\" + x)
            elif x.isascii() and x.isalnum():  # numbers, groups, names: Python's alone
                return None
            else:
                out.append("\\" + x)
            continue
        at += 1
        if c == "[" and not within:
            within = at
            head = re.compile(r"\^?\]?").match(pattern, at)[0]  # a bracket that stands first is a character
            out.append("[" + head.replace("]", "\\]"))
            at += len(head)
        elif c == "]" and within:
            within = 0
            out.append(c)
        else:
            out.append(c)
    return "".join(out)


def checked(pattern: str, regex: bool) -> None:
    """Raises InvalidPatternError for what cannot be searched for."""
    if not regex and not pattern:
        raise InvalidPatternError(pattern=pattern, reason="an empty literal")
    if regex:
        try:
            re.compile(pattern)
        except re.error as e:
            raise InvalidPatternError(pattern=pattern, reason=str(e)) from e


def built_in(pattern: str) -> bool:
    """Whether Java can find the same ranges as Python, none of them empty."""
    return java(pattern) is not None


def quoted(literal: str) -> str:
    """A Java pattern that matches just the literal."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replacement(text: str) -> str:
    """For ``regexp_replace``: no group references."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _folded(gaps: Column, lengths: Column) -> Column:
    """Ranges from the lengths of what stands before each match and of the matches."""
    start = lambda acc, x: acc["at"] + x["gap"]
    both = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    first = F.struct(F.lit(0).alias("at"), F.lit([]).cast(RANGES).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = start(acc, x)
        one = F.array(F.struct(s.alias("start"), (s + x["n"]).alias("end")))
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.aggregate(both, first, add, lambda acc: acc["out"])


def _udf(pattern: str, edit: bool):
    compiled = re.compile(pattern, re.DOTALL if edit else 0)

    @F.pandas_udf(RANGES)
    def ranges_by_python(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in find(compiled, t, edit)])

    return ranges_by_python


def find(compiled: re.Pattern, text: str, edit: bool) -> list[tuple[int, int]]:
    """Reads keep empty matches, edits pass over them."""
    if not edit:
        return [m.span() for m in compiled.finditer(text)]
    out, at = [], 0
    while at <= len(text) and (m := compiled.search(text, at)):
        if m.end() > m.start():
            out.append(m.span())
        at = m.end() if m.end() > m.start() else m.start() + 1
    return out


def ranges(text: Column, pattern: str, regex: bool = False, edit: bool = False) -> Column:
    """All non-overlapping matches from left to right."""
    checked(pattern, regex)
    if not regex:
        pieces = F.split(text, quoted(pattern), -1)
        gaps = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
        return _folded(gaps, F.transform(gaps, lambda _: F.lit(len(pattern))))
    if not built_in(pattern):
        return _udf(pattern, edit)(text)
    same = (EDIT_FLAGS if edit else READ_FLAGS) + java(pattern)
    pieces, found = F.split(text, same, -1), F.regexp_extract_all(text, F.lit(same), F.lit(0))
    return _folded(F.transform(F.slice(pieces, 1, F.size(found)), F.length), F.transform(found, F.length))


def holds(text: Column, pattern: str, regex: bool = False) -> Column:
    """Whether there is any match: a cheap filter below the ranges."""
    checked(pattern, regex)
    if not regex:
        return F.contains(text, F.lit(pattern))
    return F.rlike(text, F.lit(READ_FLAGS + java(pattern))) if built_in(pattern) else F.size(ranges(text, pattern, True)) > 0


def count(text: Column, pattern: str, regex: bool = False) -> Column:
    """The number of matches."""
    checked(pattern, regex)
    if not regex:
        gone = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
        return (gone / len(pattern)).cast("long")
    if built_in(pattern):
        return F.regexp_count(text, F.lit(READ_FLAGS + java(pattern))).cast("long")
    return F.size(ranges(text, pattern, True)).cast("long")


def selected(found: Column, occurrence: int | None) -> Column:
    """Of an array of ranges the one that is meant: the only one, the k-th, or with -1 all. Nothing where there is none."""
    if occurrence == -1:
        return found
    if occurrence is None:
        return F.when(F.size(found) == 1, found).otherwise(F.lit([]).cast(RANGES))
    return F.slice(found, occurrence + 1, 1)


def spliced(text: Column, found: Column, before: str = "", after: str = "", instead: str | None = None) -> Column:
    """The text with something before and after each range, or instead of it."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, r: Column) -> Column:
        kept = F.substring(text, r["start"] + 1, r["end"] - r["start"]) if instead is None else F.lit(instead)
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, r["start"] - acc["at"]), F.lit(before), kept, F.lit(after))
        return F.struct(r["end"].alias("at"), out.alias("out"))

    return F.aggregate(found, first, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
