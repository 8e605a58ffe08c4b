"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block of the page. Lines of navigation, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by
their tags, roles or the words of their class and id, are taken out first; they part nothing.
So are, if a page marks its article (``article`` or ``main``), the lines outside. What
characters the others hold, those of lines that are mostly links not counted, is summed over
sliding windows. The text dives where a window's sum is zero.

In a marked article only what dives is dropped: runs of lines of links, at least a window
long; its short lines are as often text. Elsewhere the text surges where a window's sum
reaches the threshold and goes on until it dives. The main container is the smallest
element around all lines of stretches between surge and dive that are long enough to bear
a surge; all its lines but those of links are kept, and if there is no such element,
all stretches.

Character references are decoded; white space within a block becomes one space; blocks are
trimmed and joined by two newlines. Nothing else is dropped or cut.

Defined cases: null or empty html, or a page with no text, gives the empty string. Unclosed
and stray tags and quotes are allowed. Ties cannot arise but in the main container, where the
innermost wins. Repeated rows are extracted each, and very long pages whole. An empty table
gives an empty one. Columns to keep may have any names but ``text`` and ``n_chars``.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vellumite.llm.store import small_batches

#: A quote counts only where a value begins, and if what follows its end may follow a value; else it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s>/]*)((?>=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z][a-z]*")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What stands in these is no text of the page: code, forms, graphics, other pages.
_RAW = frozenset("script style template svg textarea title iframe".split())
_SIDE_TAGS = frozenset("nav footer aside form head menu dialog select button".split())
_SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply replies respond search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that say no more than where or how an element stands: beside a word of the list above they leave it one of a side element.
_LAYOUT_WORDS = frozenset("area article articles bar block bottom box button buttons col column container content entry group heading inline inner item items label left link links list main mobile module outer page panel post posts right row section signup site slot small story title top unit wide wrap wrapper".split())
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_CONTAINERS = frozenset("blockquote center details div dl fieldset figure ol section table td ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(frozen=True)
class Parameters:
    """window: lines summed at a time. surge: characters in a window, where no article is marked. links: share of link text that makes a line one of links."""

    window: int = 3
    surge: int = 86
    links: float = 0.6


def _beside(token: str, inside: bool) -> bool:
    """Whether a class or id names a side element: by words of the list, and none beside them but those of layout; outside of a marked article by any word of the list."""
    words = [x.lower() for x in _NAME.findall(token)]
    side = [x in _SIDE_WORDS or x == "header" and not inside for x in words]
    return any(side) and (not inside or all(y or x in _LAYOUT_WORDS for x, y in zip(words, side, strict=True)))


def _aside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is not part of the text; ``inside``: it is in the marked article.

    There an element of running text is beside the text only if all its class names say so, any other if one does.
    """
    if tag in _SIDE_TAGS or tag == "header" and not inside:
        return True
    if not attributes.strip() or tag in ("body", "html", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if name in ("class", "id"):
            found = [_beside(x, inside) for x in value.split()]
            if found and (all(found) if inside and tag not in _CONTAINERS else any(found)):
                return True
        if name == "role" and value.lower() in _SIDE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, bool]], bool, list[tuple[int, int]]]:
    """Lines as text, characters of it in links, and whether the marked article holds them; whether an article is marked; the lines that each container holds (from, to), in the order of their beginnings."""
    out: list[tuple[str, int, bool]] = []
    spans: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = link = 0
    article = 0
    marked = False
    skip, depth = "", 0
    at, size = 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, article > 0))
        parts.clear()
        linked = 0

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not skip:
            text = references.unescape(text)
            parts.append(text)
            linked += len(text.strip()) if link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        alone = tag in _VOID or m[3].rstrip().endswith("/")
        if tag in _RAW and not closing and not alone:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s>/])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            parts.append(" ")
            continue
        if skip:
            if tag in ("article", "main") and not closing and skip not in ("article", "main"):
                skip = ""  # an unclosed element does not hold the article
            elif tag == skip:
                depth += (-1 if closing else not alone)
                if depth <= 0:
                    skip = ""
                continue
            elif skip == "p" and tag in _BLOCKS or skip == "li" and closing and tag in ("ul", "ol"):
                skip = ""
            elif closing and tag in ("article", "main", "body", "html"):
                skip = ""
            else:
                continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCKS:
            close()
        if tag == "a":
            link = 0 if closing else 1
        if closing and tag in _CONTAINERS and any(x == tag for x, _ in opened):
            while True:
                x, k = opened.pop()
                spans[k] = spans[k][0], len(out)
                if x == tag:
                    break
        if tag in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
            marked = marked or not closing
        elif not closing and not alone and _aside(tag, m[3], article > 0):
            close()
            skip, depth = tag, 1
        elif tag in _CONTAINERS and not closing and not alone:
            opened.append((tag, len(spans)))
            spans.append((len(out), size))
    close()
    return out, marked, [(a, min(b, len(out))) for a, b in spans]


def extract(page: str | None, p: Parameters = Parameters()) -> str:
    """The main text of a page."""
    if not page:
        return ""
    rows, marked, spans = lines(page)
    inside = [x for x in rows if x[2]]
    if marked and inside:
        rows = inside
    else:
        marked = False
    if not rows:
        return ""
    linked = np.array([n > p.links * len(text) for text, n, _ in rows])
    lengths = np.where(linked, 0, [len(text) for text, *_ in rows])
    sums = np.convolve(np.append(lengths, np.zeros(p.window - 1, np.int64)), np.ones(p.window, np.int64))[p.window - 1 :][: len(rows)]  # of each line and the following ones
    dive = np.zeros(len(rows), bool)
    for k in np.flatnonzero(sums[: max(0, len(rows) - p.window + 1)] == 0):
        dive[k : k + p.window] = True
    keep = ~dive
    if not marked:
        keep[:] = False
        surged = False
        for k in range(len(rows)):
            surged = not dive[k] and (surged or lengths[k] > 0 and sums[k] >= p.surge)
            keep[k] = surged
        bearing = np.flatnonzero(keep & (lengths * p.window >= p.surge))
        around = [(a, b) for a, b in spans if len(bearing) and a <= bearing[0] and bearing[-1] < b]
        if around:
            a, b = around[-1]  # containers begin in order, so the last of those around is the innermost
            keep[:] = False
            keep[a:b] = True
        keep &= ~linked
    if not keep.any():
        keep = ~keep if marked else ~linked
    return "\n\n".join(x[0] for x, k in zip(rows, keep.tolist(), strict=True) if k)


def main_text(pages: DataFrame, keep: list[str], p: Parameters = Parameters()) -> DataFrame:
    """The columns ``keep`` of ``pages``, ``text`` and ``n_chars``, from the column ``html``."""
    small_batches(pages.sparkSession)
    kept = pages.select(*keep, F.col("html").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), p) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]))
