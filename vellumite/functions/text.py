"""Scalar text functions: newline expansion, markers, previews, CJK normalisation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumite.errors import InvalidContentError

#: The reserved markers and what they stand for.
MARKERS = {"TAB": "\t", "LINE_BREAK": "\n", "PAGE_BREAK": "\n", "COLUMN_BREAK": "\n", "CR": "\r"}
MARKER_START, MARKER_END, ESCAPED_START = "[[DOCX:", "]]", "\\[[DOCX:"
#: Half-width punctuation and its full-width form.
FULL_WIDTH = {",": "，", "?": "？", "!": "！", ":": "：", ";": "；", "(": "（", ")": "）"}
_CJK = "一-鿿"
_PROTECTED = (re.compile(r"https?://\S+"), re.compile(r"\S+@\S+\.\S+"), re.compile(r"`[^`\n]*`"))


def expand_visible(text: Column) -> Column:
    """One paragraph for each stretch between blank lines; single newlines stay."""
    return F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n{2,}", -1)


def expand_visible_text(text: str) -> list[str]:
    """The same on the driver."""
    return re.split(r"\n{2,}", text.replace("\r\n", "\n").replace("\r", "\n"))


def escape_markers(text: Column) -> Column:
    """Text that looks like a marker is told apart from one."""
    return F.replace(text, F.lit(MARKER_START), F.lit(ESCAPED_START))


def parse_markers(text: str) -> list[tuple[str, str]]:
    """``("text", literal)`` and ``("marker", name)`` in order."""
    out: list[tuple[str, str]] = []
    literal = ""
    for m in re.finditer(r"(\\\[\[DOCX:)|\[\[DOCX:(.*?)(\]\]|\Z)|(.)", text, re.S):
        if m[1] or m[4]:
            literal += MARKER_START if m[1] else m[4]
            continue
        if not m[3]:
            raise InvalidContentError(raw=False, reason=f"a marker begins at {m.start()} and does not end")
        if m[2] not in MARKERS:
            raise InvalidContentError(raw=False, reason=f"no such marker: {m[0]}")
        if literal:
            out.append(("text", literal))
            literal = ""
        out.append(("marker", m[2]))
    return [*out, ("text", literal)] if literal else out


def truncated(text: Column, limit: int) -> Column:
    """The first ``limit`` characters; all of them where it is not positive."""
    return F.substring(text, 1, limit) if limit > 0 else text


def preview(text: Column, limit: int = 80) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def punctuate(text: Column) -> Column:
    """Full-width punctuation beside CJK characters, in text that holds no protected span."""
    for half, full in FULL_WIDTH.items():
        one = f"\\Q{half}\\E"
        text = F.regexp_replace(text, f"(?<=[{_CJK}]){one}|{one}(?=[{_CJK}])", full)
    return F.regexp_replace(text, f"(?<=[{_CJK}])\\.(?=[{_CJK}]|\\z)", "。")


def space(text: Column) -> Column:
    """One space between CJK characters and ASCII letters or digits, in text that holds no protected span."""
    return F.regexp_replace(text, f"(?<=[{_CJK}]) *(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]) *(?=[{_CJK}])", " ")


def _spans(text: str) -> list[tuple[int, int]]:
    """URLs, mail addresses and code spans, united where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for p in _PROTECTED for m in p.finditer(text)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HALF = re.compile("|".join(f"(?<=[{_CJK}]){re.escape(x)}|{re.escape(x)}(?=[{_CJK}])" for x in FULL_WIDTH))
_STOP = re.compile(rf"(?<=[{_CJK}])\.(?=[{_CJK}]|\Z)")
_GAP = re.compile(rf"(?<=[{_CJK}])( *)(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])( *)(?=[{_CJK}])")


def normalized(text: str) -> str:
    """Full-width punctuation, then spacing, protected spans left alone; neither looks into them for spacing."""

    def outside(spans: list[tuple[int, int]], a: int, b: int) -> bool:
        return all(b <= s or a >= e for s, e in spans)

    def apply(pattern: re.Pattern, by, around: bool) -> None:
        nonlocal text
        spans = _spans(text)

        def one(m: re.Match) -> str:
            free = outside(spans, m.start() - 1, m.end() + 1) if around else outside(spans, m.start(), m.end())
            return by(m[0]) if free else m[0]

        text = pattern.sub(one, text)

    whole = text
    spans = _spans(whole)
    half = lambda m: m[0] if not outside(spans, m.start(), m.end()) else FULL_WIDTH.get(m[0], "。")
    # both kinds look at the original neighbours
    text = re.sub(f"{_HALF.pattern}|{_STOP.pattern}", half, whole)
    apply(_GAP, lambda _: " ", True)
    return text


def _normalized_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalized(t))


def normalize(text: Column) -> Column:
    """CJK normalisation of any text, protected spans left alone."""
    return F.pandas_udf(_normalized_all, "string")(text)
