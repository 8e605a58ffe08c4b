"""Content from literals, JSON files, text files and commands. On the driver only: no reference is resolved on executors."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from vellumite.errors import InvalidContentError
from vellumite.models import ContentItem, ContentSourceCommand, ContentSourceFile, ContentSourceJsonPath

#: Variables that a command inherits, and the most that it may print.
INHERITED = ("PATH", "LANG", "LC_ALL")
MOST_OUTPUT = 1 << 20
_QUOTED = r"'[^']*'|\"[^\"]*\""
_NAME = r"[A-Za-z_][\w-]*"
_STEP = re.compile(rf"(?P<deep>\.\.)?(?:\.?(?P<name>{_NAME}(?:,{_NAME})*)|\.?(?P<every>\*)|\.?`(?P<word>parent|len)`|\[(?P<inner>(?:{_QUOTED}|[^\]'\"])*)\])")
_SLICE = re.compile(r"(-?\d*):(-?\d*)(?::(-?\d+))?")
_TEST = re.compile(rf"@((?:\.{_NAME}|\[\d+\])*)\s*(?:(==|!=|<=|>=|=~|<|>)\s*({_QUOTED}|-?\d+(?:\.\d+)?|true|false|null))?")


@dataclass(frozen=True)
class ContentResolverConfig:
    """Where files may be read and commands run; commands need ``allow_commands``."""

    workspace: Path = field(default_factory=Path.cwd)
    input_roots: tuple[Path, ...] = ()
    allow_commands: bool = False


def _bad(reason: str, cause: Exception | None = None) -> InvalidContentError:
    return InvalidContentError(raw=False, reason=reason, cause=cause)


def contained(path: str, config: ContentResolverConfig) -> Path:
    """The real place of a path, links followed; it must lie within an input root."""
    found = Path(config.workspace, path).resolve()
    if not any(found.is_relative_to(Path(r).resolve()) for r in config.input_roots):
        raise _bad(f"{path} lies outside the input roots")
    if not found.is_file():
        raise _bad(f"{path} is not a file")
    return found


def json_path(document: Any, path: str) -> list[Any]:
    """Values that a path selects.

    Names, indexes, slices, unions of these, wildcards, descent, parents, lengths, and filters by comparisons or regular expressions.
    """
    if not path.startswith("$"):
        raise _bad(f"not a JSONPath: {path}")
    at, nodes = 1, [(document,)]  # a value, and those it lies in
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or not m[0]:
            raise _bad(f"not a JSONPath: {path}")
        at = m.end()
        if m["deep"]:
            nodes = [y for x in nodes for y in _below(x)]
        nodes = [y for x in nodes for y in _step(x, m, path)]
    return [x[0] for x in nodes]


def _inner(node: tuple) -> list[tuple]:
    x = node[0]
    return [(y, *node) for y in (x.values() if isinstance(x, Mapping) else x if isinstance(x, list) else ())]


def _below(node: tuple) -> list[tuple]:
    """A node and all within it, outer ones first."""
    return [node, *(y for x in _inner(node) for y in _below(x))]


def _key(node: tuple, key: str | int) -> list[tuple]:
    x = node[0]
    held = isinstance(x, Mapping) and key in x if isinstance(key, str) else isinstance(x, list) and -len(x) <= key < len(x)
    return [(x[key], *node)] if held else []


def _step(node: tuple, m: re.Match, path: str) -> list[tuple]:
    if m["every"]:
        return _inner(node)
    if m["name"]:
        return [y for k in m["name"].split(",") for y in _key(node, k)]
    if m["word"] == "parent":
        return [node[1:]] if len(node) > 1 else []
    if m["word"] == "len":
        return [(len(node[0]), *node)] if isinstance(node[0], (str, list, Mapping)) else []
    inner = m["inner"].strip()
    if inner == "*":
        return _inner(node)
    if inner.startswith("?"):
        tests = [x.strip() for x in re.split(r"&&?(?=\s*@)", inner[1:].strip().removeprefix("(").removesuffix(")"))]
        return [y for y in _inner(node) if all(_holds(y[0], x, path) for x in tests)]
    if sliced := _SLICE.fullmatch(inner):
        low, high, step = (int(x) if x else None for x in sliced.groups())
        return _inner(node)[low:high:step] if isinstance(node[0], list) else []
    out = []
    for part in re.findall(rf"{_QUOTED}|[^,]+", inner):
        part = part.strip()
        if part[:1] in ("'", '"'):
            out += _key(node, part[1:-1])
        elif re.fullmatch(r"-?\d+", part):
            out += _key(node, int(part))
        else:
            raise _bad(f"not a JSONPath: {path}")
    return out


def _holds(x: Any, test: str, path: str) -> bool:
    m = _TEST.fullmatch(test)
    if not m:
        raise _bad(f"not a JSONPath: {path}")
    found = [(x,)]
    for k in re.findall(rf"\.({_NAME})|\[(\d+)\]", m[1]):
        found = [y for n in found for y in _key(n, k[0] or int(k[1]))]
    if not m[2] or not found:
        return bool(found)
    value, other = found[0][0], m[3][1:-1] if m[3][0] in "'\"" else json.loads(m[3])
    if m[2] == "=~":
        return isinstance(value, str) and re.search(other, value) is not None
    if m[2] in ("==", "!="):
        return (value == other) == (m[2] == "==")
    alike = isinstance(value, str) == isinstance(other, str) and isinstance(value, (str, int, float)) and other is not None
    return alike and {"<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[m[2]] if alike else False


def scalar(x: Any) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if x is None or isinstance(x, (Mapping, list)):
        raise _bad("the value is not a scalar")
    return str(x)


def _run(ref: ContentSourceCommand, config: ContentResolverConfig) -> str:
    if not config.allow_commands:
        raise _bad("commands are not allowed")
    cwd = Path(config.workspace, ref.cwd or ".").resolve()
    if not cwd.is_relative_to(Path(config.workspace).resolve()):
        raise _bad("the working directory lies outside the workspace")
    env = {k: os.environ[k] for k in INHERITED if k in os.environ} | dict(ref.env)
    shown = " ".join(ref.argv)[:60]
    try:
        done = subprocess.run(list(ref.argv), capture_output=True, cwd=cwd, env=env, timeout=ref.timeout_seconds, check=False)
    except subprocess.TimeoutExpired as e:
        raise _bad(f"{shown}: timed out", e) from e
    except OSError as e:
        raise _bad(f"{shown}: {e}", e) from e
    if done.returncode:
        raise _bad(f"{shown}: exit status {done.returncode}")
    if len(done.stdout) > MOST_OUTPUT:
        raise _bad(f"{shown}: output is too large")
    try:
        return done.stdout.decode().removesuffix("\n")
    except UnicodeDecodeError as e:
        raise _bad(f"{shown}: output is not UTF-8", e) from e


def resolve(items: Sequence[ContentItem], config: ContentResolverConfig) -> list[str]:
    """Texts of all items, which are checked before any source is touched; a JSON file is read once."""
    if any((x.content_literal is None) == (x.content_ref is None) for x in items):
        raise _bad("exactly one of content_literal and content_ref is required")
    files: dict[Path, Any] = {}
    out = []
    for x in items:
        ref = x.content_ref
        if ref is None:
            out.append(x.content_literal)
        elif isinstance(ref, ContentSourceCommand):
            out.append(_run(ref, config))
        elif isinstance(ref, ContentSourceFile):
            try:
                out.append(contained(ref.path, config).read_bytes().decode(ref.encoding))
            except (UnicodeError, LookupError) as e:
                raise _bad(f"{ref.path}: {e}", e) from e
        elif isinstance(ref, ContentSourceJsonPath):
            path = contained(ref.source, config)
            try:
                files[path] = files[path] if path in files else json.loads(path.read_bytes())
            except ValueError as e:
                raise _bad(f"{ref.source}: {e}", e) from e
            values = json_path(files[path], ref.path)
            if len(values) != 1:
                raise _bad(f"{ref.path} selects {len(values)} values")
            out.append(scalar(values[0]))
    return out
