"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors of one label (and dimension) are dealt by hash into tiles of a fixed size, and each
pair of tiles is one task's work. Unit vectors ``x = X + e`` are quantised once to int8 codes
times a scale (``X``); the product of two codes' tiles is exact, and
``|x.y - X.Y| <= |e_x| |Y| + |e_y|``. Codes, a byte for each component, go to the tasks, which
return the vectors that have a partner whose upper bound reaches the threshold. Only these are
fetched as they were, for the same pairs of tiles, and their possible pairs recomputed
in double precision. A task returns for each vector its number of links, and a spanning
forest of the links, never the pairs themselves.

Each vector's codes go to as many tasks as its label has tiles, so a label of N vectors costs
N * N / tile rows moved and N * N products; larger tiles move less and use more memory.

Defined cases: vectors that are null, zero or hold null or non-finite components, and those
without a label, link with nothing. Equal vectors link. Rows that repeat a vec_id are one
vector (where they differ, the least one) and get the same result each. A null vec_id
gives null component and kept. An empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm.components import components
from vellumite.llm.store import Scratch
from vellumite.llm.vectors import cosines, matrix, usable


@dataclass(frozen=True)
class Parameters:
    threshold: float = 0.98
    tile: int = 2048
    strip: int = 256


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scales, norms of the errors and of the quantised unit vectors."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / largest
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    near = codes * scale
    return codes, scale[:, 0], np.sqrt(((unit - near) ** 2).sum(axis=1)), np.sqrt((near * near).sum(axis=1))


def possible(left: tuple, right: tuple, p: Parameters):
    """Of quantised vectors the pairs (row of left, row of right) whose upper bound reaches the threshold, in strips of rows of left."""
    codes_l, scale_l, error_l, _ = left
    codes_r, scale_r, error_r, norm_r = right
    # products of codes are whole numbers, exact in single precision up to 2**24
    kind = np.float32 if codes_l.shape[1] * 127 * 127 < 2**24 else np.float64
    turned = codes_r.astype(kind).T
    for k in range(0, len(codes_l), p.strip):
        rows = slice(k, k + p.strip)
        product = codes_l[rows].astype(kind) @ turned
        upper = product * scale_l[rows, None] * scale_r + error_l[rows, None] * norm_r + error_r + 1e-6
        a, b = np.nonzero(upper >= p.threshold)
        yield a + k, b


def linked(left: np.ndarray, right: np.ndarray, p: Parameters):
    """Strips of linked pairs (row of left, row of right)."""
    for a, b in possible(quantise(left), quantise(right), p):
        for j in range(0, len(a), 1 << 18):
            i, o = a[j : j + (1 << 18)], b[j : j + (1 << 18)]
            sure = cosines(left[i], right[o]) >= p.threshold
            yield i[sure], o[sure]


def _quantised(used: DataFrame) -> DataFrame:
    """vec_id, label, dim, codes, scale, error, norm."""
    names = ["vec_id", "label", "dim", "codes", "scale", "error", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                codes, scale, error, norm = quantise(matrix(some.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([x.tobytes() for x in codes], pa.binary()), *map(pa.array, (scale, error, norm))], names=names)

    kind = used.schema["label"].dataType.simpleString()
    return used.select("vec_id", "label", "dim", "embedding").mapInArrow(run, f"vec_id long, label {kind}, dim int, codes binary, scale double, error double, norm double")


def _partners(rows: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """Of one pair of tiles the vectors that may have a partner."""
    rows = rows.sort_values(["side", "vec_id"])
    codes = np.frombuffer(b"".join(rows["codes"]), np.int8).reshape(len(rows), -1)
    every = (codes, *(rows[c].to_numpy() for c in ("scale", "error", "norm")))
    n_left = int((rows["side"] == 0).sum())
    same = rows["low"].iloc[0] == rows["high"].iloc[0]
    left, right, shift = tuple(x[:n_left] for x in every), tuple(x[0 if same else n_left :] for x in every), 0 if same else n_left
    held = np.zeros(len(rows), bool)
    for a, b in possible(left, right, p) if n_left and len(right[0]) else ():
        b = b + shift
        held[a[a != b]] = held[b[a != b]] = True
    return rows.loc[held, ["label", "dim", "low", "high", "side", "vec_id"]]


def _tiles(rows: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """Of one pair of tiles: vec_id, links, root (the end of a forest's edge)."""
    rows = rows.sort_values(["side", "vec_id"])
    ids, vectors, side = rows["vec_id"].to_numpy(), matrix(rows["embedding"]), rows["side"].to_numpy()
    n_left = int((side == 0).sum())
    same = rows["low"].iloc[0] == rows["high"].iloc[0]
    left, right, shift = vectors[:n_left], (vectors if same else vectors[n_left:]), (0 if same else n_left)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, b in linked(left, right, p) if len(right) and n_left else ():
        b = b + shift
        a, b = a[a != b], b[a != b]
        links += np.bincount(a, minlength=len(ids))
        if not same:
            links += np.bincount(b, minlength=len(ids))
        cut = np.flatnonzero(np.diff(a)) + 1
        for one, others in zip(a[np.r_[0, cut]] if len(a) else (), np.split(b, cut), strict=len(a) > 0):
            found = np.unique(np.append(root[others], root[one]))
            if len(found) > 1:
                root[np.isin(root, found)] = found[0]
    held = np.flatnonzero(links > 0)
    return pd.DataFrame({"vec_id": ids[held], "links": links[held], "root": ids[root[held]]})


def near_duplicates(vectors: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors`` (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession, "neardup")
    used = scratch.write(usable(vectors.where("label is not null"), "label"), "used")
    codes = scratch.write(_quantised(used), "codes")
    # one row for each label and dimension
    tiles = codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(p.tile)).cast("int").alias("tiles"))
    dealt = codes.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pair = ["label", "dim", "low", "high"]
    dealt = dealt.select("label", "dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "vec_id", "codes", "scale", "error", "norm")
    kind = codes.schema["label"].dataType.simpleString()
    near = dealt.groupBy(*pair).applyInPandas(lambda rows: _partners(rows, p), f"label {kind}, dim int, low int, high int, side int, vec_id long")
    near = scratch.write(near, "near")
    whole = near.join(used.select("vec_id", "embedding"), "vec_id")
    found = whole.groupBy(*pair).applyInPandas(lambda rows: _tiles(rows, p), "vec_id long, links long, root long")
    found = scratch.write(found, "found")
    scratch.drop("codes", "near", "used")
    joined = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch)
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    counts = scratch.write(counts.join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left"), "counts")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
