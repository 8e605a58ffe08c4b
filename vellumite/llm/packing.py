"""Concatenate and cut: token sequences of a fixed length from whole documents.

The first pass encodes every document once, writes its ids with their place in the task's
own stream, and so gives the tasks' totals; their prefix sums (one number for each input
partition) are the global offsets of the streams. The second pass cuts the global stream
into windows of the fixed length: a document's pieces are the windows that it overlaps, and
a piece at a window's boundary is a record of its own. Each id lies in one piece; only the
last sequence can fall short of the length.

Defined cases: a null text counts as empty; with an end id an empty text has that id as its
only token; without one it has no piece. An empty table gives no piece. Repeated rows are
packed each; a very long text is encoded whole and cut over many sequences. Other columns play no part. ``padded_length`` is the sequence's length with padding: none where its tokens
are a power of two, else the fixed length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vellumite.llm.bpe import encode
from vellumite.llm.store import Scratch


#: Offsets of more input partitions are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number, the first id's place in the task's stream and the number of ids."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: len(batch) + 1]).astype(np.int64) // 4
        starts = at + np.cumsum(lengths) - lengths
        at += int(lengths.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(starts), pa.array(lengths)], names=["doc_id", "ids", "part", "place", "n"])


def pack(docs: DataFrame, tokenizer_path: str, end: int | None = 2, window: int = 4096) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    spark = docs.sparkSession
    encoded = encode(docs, tokenizer_path, ["doc_id"], end)
    schema = StructType([*encoded.schema.fields, StructField("part", IntegerType()), StructField("place", LongType()), StructField("n", LongType())])
    encoded = Scratch(spark, "packing").write(encoded.mapInArrow(_placed, schema), "ids")
    totals = {r["part"]: r["total"] for r in encoded.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    parts = sorted(totals)
    bases = [0, *accumulate(totals[k] for k in parts)]
    everything = bases.pop()
    offsets = spark.createDataFrame([*zip(parts, bases, strict=True)], "part int, base long")
    at = F.col("place") + F.col("base")
    # one row of 12 bytes for each input partition
    few = len(parts) <= MOST_BROADCAST
    pieces = encoded.where("n > 0").join(F.broadcast(offsets) if few else offsets, "part").withColumn("at", at)
    pieces = pieces.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window))))
    start = F.greatest(F.lit(0), F.col("sequence_id") * window - F.col("at"))
    length = F.least(F.col("n"), (F.col("sequence_id") + 1) * window - F.col("at")) - start
    used = F.least(F.lit(window), F.lit(everything) - F.col("sequence_id") * window)
    return pieces.select(
        "doc_id",
        start.alias("start"),
        length.alias("length"),
        F.crc32(F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + start - F.col("sequence_id") * window).alias("offset"),
        F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(window).cast("long").alias("padded_length"),
    )
