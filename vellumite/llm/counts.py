"""Distributed sums of fixed-size counter tables.

A task counts into an array and sends it as compressed blocks. Blocks are summed in
two levels, first within GROUPS groups of tasks, so that no task reads a block of every
other one. The result has a fixed size, set by a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
GROUPS = 64
SCHEMA = "block int, part int, counts binary"


def to_blocks(counts: np.ndarray, part: int) -> Iterator[dict]:
    """Rows for the blocks of ``counts`` that are not all zero."""
    pack = zstandard.ZstdCompressor(level=1)
    for k in range(0, len(counts), BLOCK):
        x = counts[k : k + BLOCK]
        if x.any():
            yield {"block": k // BLOCK, "part": part, "counts": pack.compress(x.astype("<u4").tobytes())}


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    unpack = zstandard.ZstdDecompressor()
    total = np.zeros(BLOCK, np.uint64)
    for x in rows["counts"]:
        y = np.frombuffer(unpack.decompress(x), "<u4")
        total[: len(y)] += y
    out = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes())
    return pd.DataFrame({"block": rows["block"].iloc[:1], "part": rows["part"].iloc[:1], "counts": [out]})


def total(blocks: DataFrame, size: int) -> np.ndarray:
    """The summed counters, on the driver: 4 bytes for each of ``size``, saturating."""
    once = blocks.withColumn("part", F.col("part") % GROUPS).groupBy("block", "part").applyInPandas(_sum, SCHEMA)
    unpack = zstandard.ZstdDecompressor()
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.uint32)
    for r in once.groupBy("block").applyInPandas(_sum, SCHEMA).toLocalIterator():
        x = np.frombuffer(unpack.decompress(r["counts"]), "<u4")
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out[:size]
