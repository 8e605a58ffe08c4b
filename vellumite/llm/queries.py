"""The ``opN_<name>`` queries: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm import bpe, hnsw, html, jaccard, language, lattice, neardup, packing, sql, toxicity, urls
from vellumite.llm.store import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files of public tokenizers; the operators take any path.
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))
    return lattice.score(docs, docs.where("not held_out"), public_tokenizers.path(PIECES), ["doc_id", "held_out"], "lang")


def line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def int8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    found = language.learn(docs.where("not held_out"))
    return language.predict(docs, found, ["doc_id", "held_out"])


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    docs = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
    p = toxicity.Parameters()
    model = toxicity.train(docs.where("not held_out"), labels.where(crc_mod("doc_id", 4) != 2), p)
    return toxicity.score(docs, model, ["doc_id", "held_out"], p).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(WORD_BPE))


def bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw_search": hnsw_search,
    "op2_jaccard_join": jaccard_join,
    "op3_language_id": language_id,
    "op4_concatenate_and_cut": concatenate_and_cut,
    "op5_bpe_automaton": bpe_automaton,
    "op6_subword_lattice": subword_lattice,
    "op7_line_block_text": line_block_text,
    "op8_int8_neardup": int8_neardup,
    "op9_url_filter": url_filter,
    "op10_toxicity_pu": toxicity_pu,
}

#: The others cannot be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": sql.JACCARD_JOIN,
    "op8_int8_neardup": sql.INT8_NEARDUP,
    "op9_url_filter": sql.URL_FILTER,
}
