"""Read operators over a paragraph relation, in built-in expressions but for patterns that only Python can match (see functions.match).

Windows of rows are filters on ``record_pos``, which reach the scan, not LIMIT and OFFSET.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumite.functions import match
from vellumite.functions.text import truncated


def _window(paragraphs: DataFrame, start: int, limit: int | None) -> DataFrame:
    if start < 1 or limit is not None and limit < 0:
        raise ValueError("start must be 1 or more, limit 0 or more")
    paragraphs = paragraphs.where(F.col("record_pos") >= start) if start > 1 else paragraphs
    return paragraphs if limit is None else paragraphs.where(F.col("record_pos") < start + limit)


def _scope(paragraphs: DataFrame, paragraph_id: str | None) -> DataFrame:
    return paragraphs if paragraph_id is None else paragraphs.where(F.col("id") == paragraph_id)


def _content(raw: bool) -> Column:
    return F.col("xml" if raw else "text")


def paragraph_count(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


def list_paragraphs(paragraphs: DataFrame, start: int = 1, limit: int | None = None, max_chars: int = 80, raw: bool = False) -> DataFrame:
    extra = [c for c in ("table_context",) if c in paragraphs.columns]
    return _window(paragraphs, start, limit).select("doc_id", "id", "global_ordinal", "style_id", *extra, truncated(_content(raw), max_chars).alias("xml" if raw else "text"))


def pagination(paragraphs: DataFrame, start: int = 1, limit: int | None = None) -> DataFrame:
    """For each document how many rows a window returns, and of how many."""
    _window(paragraphs, start, limit)
    within = F.col("record_pos") >= start
    within = within if limit is None else within & (F.col("record_pos") < start + limit)
    return paragraphs.groupBy("doc_id").agg(F.count_if(within).alias("returned"), F.count("*").alias("total"))


def get_paragraph(paragraphs: DataFrame, paragraph_id: str, raw: bool = False) -> DataFrame:
    return _scope(paragraphs, paragraph_id).select("doc_id", "id", _content(raw).alias("content"))


def paragraph_not_found(paragraphs: DataFrame, paragraph_id: str) -> DataFrame:
    """Documents that have no such paragraph."""
    held = paragraphs.groupBy("doc_id").agg(F.bool_or(F.col("id") == paragraph_id).alias("held"))
    return held.where("not held").select("doc_id", F.lit(paragraph_id).alias("target_id"), F.lit("paragraph_not_found").alias("error"))


def visible_text(paragraphs: DataFrame, raw: bool = False) -> DataFrame:
    """Whole documents: texts joined by newlines, or raw paragraphs one after the other."""
    rows = F.array_sort(F.collect_list(F.struct("global_ordinal", _content(raw).alias("x"))))
    return paragraphs.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "" if raw else "\n").alias("text"))


def grep(paragraphs: DataFrame, pattern: str, regex: bool = False, start: int = 1, limit: int | None = None, max_chars: int = 0, raw: bool = False) -> DataFrame:
    """Matching paragraphs of a window with their ranges; the preview is cut after the search."""
    hits = _window(paragraphs, start, limit).where(match.holds(_content(raw), pattern, regex))
    hits = hits.withColumn("ranges", match.ranges(_content(raw), pattern, regex)).where(F.size("ranges") > 0)
    return hits.select("doc_id", "id", "global_ordinal", "style_id", truncated(_content(raw), max_chars).alias("preview"), "ranges", F.size("ranges").alias("match_count"))


def count_matches(paragraphs: DataFrame, pattern: str, regex: bool = False, paragraph_id: str | None = None, raw: bool = False) -> DataFrame:
    return _scope(paragraphs, paragraph_id).groupBy("doc_id").agg(F.sum(match.count(_content(raw), pattern, regex)).alias("matches"))


def find_text(paragraphs: DataFrame, pattern: str, regex: bool = False, occurrence: int | None = None, paragraph_id: str | None = None, raw: bool = False) -> DataFrame:
    """Matches of each document by occurrence: -1 all, k the k-th of the document, None the only one.

    Documents where None meets several matches, or k too few, have one row with an ``error``.
    """
    if occurrence is not None and occurrence < -1:
        raise ValueError("occurrence must be -1 or more")
    rows = _scope(paragraphs, paragraph_id).where(match.holds(_content(raw), pattern, regex))
    keep = [c for c in ("segments",) if c in paragraphs.columns and not raw]
    rows = rows.select("doc_id", "id", "global_ordinal", *keep, F.posexplode(match.ranges(_content(raw), pattern, regex)).alias("nth", "r"))
    order = Window.partitionBy("doc_id").orderBy("global_ordinal", "nth")
    rows = rows.withColumns({"occurrence": F.row_number().over(order) - 1, "total_matches": F.count("*").over(Window.partitionBy("doc_id"))})
    start, end = F.col("r.start"), F.col("r.end")
    found = {"start": start, "end": end, "first_node": start, "last_node": end, "crosses_nodes": F.lit(False), "intersected_structures": F.lit([]).cast("array<string>")}
    if keep:
        node = lambda at: F.filter("segments", lambda s: (s["vstart"] <= at) & (at < s["vend"]))[0]["node"]
        meets = F.filter("segments", lambda s: (s["vstart"] < end) & (start < s["vend"]))
        found |= {"first_node": node(start), "last_node": node(F.greatest(start, end - 1)), "intersected_structures": F.array_sort(F.array_distinct(F.flatten(F.transform(meets, lambda s: s["structures"]))))}
        found["crosses_nodes"] = found["first_node"] != found["last_node"]
    rows = rows.select("doc_id", "id", "global_ordinal", "occurrence", "total_matches", *(x.alias(k) for k, x in found.items()))
    if occurrence == -1:
        return rows.withColumn("error", F.lit(None).cast("string"))
    rows = rows.where(F.col("occurrence") == (occurrence or 0))
    error = F.when(F.col("total_matches") > 1, "ambiguous_text_match") if occurrence is None else F.lit(None).cast("string")
    return rows.withColumn("error", error)


def text_not_found(paragraphs: DataFrame, pattern: str, regex: bool = False, occurrence: int = 0, raw: bool = False) -> DataFrame:
    """Documents that have no such occurrence, with their numbers of matches."""
    counts = count_matches(paragraphs, pattern, regex, raw=raw)
    return counts.where(F.col("matches") <= occurrence).select("doc_id", F.col("matches").alias("total_matches"), F.lit("text_not_found").alias("error"))


def heading_level(style: Column, prefix: str = "Heading") -> Column:
    """The number after the prefix, in any case of letters; null where no digits alone follow."""
    rest = F.substring(style, len(prefix) + 1, F.length(style))
    return F.when(F.startswith(F.lower(style), F.lit(prefix.lower())) & F.rlike(rest, F.lit("^[0-9]+$")), rest.try_cast("int"))


def _ends(heads: Column, last: Column) -> Column:
    """The places past each heading's stretch, for headings from the last to the first: one pass with a stack of those that may end others."""
    one = "struct<level:int,pos:int>"
    first = F.struct(F.lit([]).cast(f"array<{one}>").alias("open"), F.lit([]).cast("array<int>").alias("ends"))

    def add(acc: Column, h: Column) -> Column:
        # what is open has rising levels from the latest on, and is only shut out by headings of its level or a higher one
        still = F.filter(acc["open"], lambda x: x["level"] <= h["level"])
        end = F.coalesce(F.get(still, F.lit(0))["pos"], last)
        mine = F.array(F.struct(h["level"].alias("level"), h["pos"].alias("pos")).cast(one))
        rest = F.filter(acc["open"], lambda x: x["level"] < h["level"])
        return F.struct(F.concat(mine, rest).alias("open"), F.concat(acc["ends"], F.array(end)).alias("ends"))

    return F.aggregate(heads, first, add, lambda acc: acc["ends"])


def list_sections(paragraphs: DataFrame, level: int | None = None, style_prefix: str = "Heading") -> DataFrame:
    """Headings with the stretch they own: up to the next heading of their level or a higher one, lower ones included."""
    level_of = heading_level(F.col("style_id"), style_prefix)
    row = F.struct(F.col("record_pos").cast("int").alias("pos"), level_of.alias("level"), F.col("id").alias("id"), F.col("text").alias("text"))
    docs = paragraphs.groupBy("doc_id").agg((F.max("record_pos") + 1).cast("int").alias("last"), F.reverse(F.array_sort(F.collect_list(F.when(level_of.isNotNull(), row)))).alias("heads"))
    both = F.arrays_zip(F.col("heads").alias("h"), _ends(F.col("heads"), F.col("last")).alias("end_pos"))
    heads = docs.where(F.size("heads") > 0).select("doc_id", F.explode(both).alias("x"))
    out = heads.select("doc_id", F.col("x.h.id").alias("heading_id"), F.col("x.h.text").alias("heading_text"), F.col("x.h.level").alias("level"), F.col("x.h.pos").alias("start_pos"), "x.end_pos")
    out = out.withColumn("body_count", (F.col("end_pos") - F.col("start_pos") - 1).cast("long"))
    return out if level is None else out.where(F.col("level") == level)


def section_bodies(paragraphs: DataFrame, level: int | None = None, style_prefix: str = "Heading") -> DataFrame:
    """One row for each paragraph that a section owns besides its heading."""
    heads = list_sections(paragraphs, level, style_prefix).where("body_count > 0")
    places = heads.select("doc_id", "heading_id", F.explode(F.sequence(F.col("start_pos") + 1, F.col("end_pos") - 1)).alias("record_pos"))
    rows = paragraphs.select("doc_id", F.col("id").alias("body_id"), F.col("record_pos").cast("int").alias("record_pos"))
    return places.join(rows, ["doc_id", "record_pos"]).select("doc_id", "heading_id", "body_id", "record_pos")


def get_section(paragraphs: DataFrame, heading_id: str, style_prefix: str = "Heading") -> DataFrame:
    """The section of one heading; a paragraph that is none gives a row with an ``error``."""
    level = heading_level(F.col("style_id"), style_prefix)
    wrong = paragraphs.where((F.col("id") == heading_id) & level.isNull()).select("doc_id", F.lit(heading_id).alias("heading_id"), F.lit("not_a_heading").alias("error"))
    return list_sections(paragraphs, style_prefix=style_prefix).where(F.col("heading_id") == heading_id).withColumn("error", F.lit(None).cast("string")).unionByName(wrong, allowMissingColumns=True)


def copy_range(paragraphs: DataFrame, start_id: str, end_id: str, raw: bool = False) -> DataFrame:
    """The paragraphs of each document from one id to another, both included; ``error`` where an end is missing or they are reversed."""
    ends = paragraphs.where(F.col("id").isin(start_id, end_id)).groupBy("doc_id").agg(F.max(F.when(F.col("id") == start_id, F.col("global_ordinal"))).alias("low"), F.max(F.when(F.col("id") == end_id, F.col("global_ordinal"))).alias("high"))
    docs = paragraphs.select("doc_id", "id", "global_ordinal", _content(raw).alias("content")).join(ends, "doc_id")
    return docs.where(F.col("global_ordinal").between(F.col("low"), F.col("high"))).select("doc_id", "id", "global_ordinal", "content")


def copy_range_errors(paragraphs: DataFrame, start_id: str, end_id: str) -> DataFrame:
    """Documents in which a range cannot be copied, and why."""
    at = lambda i: F.max(F.when(F.col("id") == i, F.col("global_ordinal")))
    ends = paragraphs.groupBy("doc_id").agg(at(start_id).alias("low"), at(end_id).alias("high"))
    error = F.when(F.col("low").isNull() | F.col("high").isNull(), "paragraph_not_found").when(F.col("low") > F.col("high"), "reversed_range")
    return ends.select("doc_id", error.alias("error")).where("error is not null")
