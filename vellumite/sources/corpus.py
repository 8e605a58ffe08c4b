"""Paragraph relations over tables of plain text.

Columns: doc_id, record_pos and global_ordinal (from 1), id, style_id, text. A document's
lines are its paragraphs, the exact inverse of its visible text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "id", "record_pos", "global_ordinal", "style_id", "text"]


def paragraph_id(position: Column) -> Column:
    return F.format_string("p_%06d", position)


def line_style(position: Column, text: Column) -> Column:
    """Plain text has no styles: its first line is a heading of level 1, other short lines of level 2."""
    return F.when(position == 1, "Heading1").when(F.length(text) < 60, "Heading2").otherwise("Normal")


def from_documents(documents: DataFrame) -> DataFrame:
    """One row for each line of ``documents`` (doc_id, text)."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    at = F.col("n") + 1
    return lines.select("doc_id", paragraph_id(at).alias("id"), at.alias("record_pos"), at.alias("global_ordinal"), line_style(at, F.col("text")).alias("style_id"), "text")


def from_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each turn of ``conversations`` (conv_id, turn, text); the conversation is the document."""
    at = (F.col("turn") + 1).cast("int")
    return conversations.select(F.col("conv_id").alias("doc_id"), paragraph_id(at).alias("id"), at.alias("record_pos"), at.alias("global_ordinal"), F.lit("Normal").alias("style_id"), "text")
