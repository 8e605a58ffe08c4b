"""A corpus pipeline over ``documents``: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
table, written as Parquet and read again as the next one's ``docs``. All stages but the last
return the columns of ``docs``. Columns other than doc_id and text pass through untouched;
``lang`` is read only to learn from, null languages are not.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm import jaccard, language, packing, toxicity
from vellumite.llm.store import Scratch

#: Five words and 0.8, as near-duplicate stages take them.
NEAR = jaccard.Parameters(width=5, percent=80)
TOKENIZER = "word_bpe_49k.json"


def _rows(docs: DataFrame) -> DataFrame:
    """The text, and the row as one column, so that no column's name can clash with those that an operator adds."""
    return docs.select("text", F.struct("*").alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts whose language is told by a sufficient margin; null and letterless texts, and ties, go. Repeated rows go or stay alike; an empty table stays one."""
    return language.predict(_rows(docs), language.learn(docs), ["_row"]).where("accepted").select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that score below the threshold, null and empty ones too (a score at it goes). Repeated rows go or stay alike; with no toxic label, and of an empty table, all stay."""
    p = toxicity.Parameters()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(_rows(docs), toxicity.train(docs, labels, p), ["_row"], p).where(F.col("score") < p.threshold).select("_row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id, and all that are linked with nothing, such as null and empty texts. Of rows that repeat an id one stays; an empty table stays one."""
    scratch = Scratch(spark, "pipeline")
    found = scratch.write(jaccard.join(docs.select("doc_id", "text"), NEAR).select("doc_id", "component_id"), "found")
    gone = scratch.write(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    if again.head(1):  # rows that repeat an id: one of them stays
        again = scratch.write(again, "again")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that all remaining documents are packed into; a null or empty text is its end token alone, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_near_copies),
    ("packing", pack),
]

#: The stages cannot be expressed in SQL; the tests hold them against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
