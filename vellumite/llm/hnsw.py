"""Approximate nearest neighbours by a navigable small-world graph per shard.

Vectors are dealt by hash into shards of a fixed expected size. Each shard holds a
hierarchical navigable small-world graph (Malkov and Yashunin, 2018) as flat neighbour
arrays, one for each layer, padded with -1. Its nodes are the shard's distinct vectors, each
with all its ids. Nodes are inserted, some hundred at a time: each searches the graph so far
from the top layer down, and on the layers that hold it links to what it finds there, or
among those inserted with it, of which the usual heuristic keeps nodes nearer to it than to one already kept;
links go both ways, and a node with too many keeps those that the heuristic does. The index
is written, one row for a shard. Every query goes to every shard: it descends the layers and
keeps a beam of the best nodes on the lowest one, and each shard's nearest, scored in double
precision on the original vectors, are merged over the shards.

Defined cases: vectors that are null, zero or hold null or non-finite components take no
part, neither as queries nor as candidates; vectors of different dimension are not compared.
Rows that repeat a vec_id are one vector (where they differ, the least one). With fewer
candidates than asked for all are returned; ties go to the smaller vec_id. An empty table of vectors or
queries gives an empty one; other columns play no part.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumite.llm.store import Scratch, release, released, small_batches
from vellumite.llm.vectors import cosines, matrix, usable


@dataclass(frozen=True)
class Parameters:
    """shard: expected vectors of one. links: kept from a node's candidates; a node has up to twice as many on the lowest layer.

    beam: nodes kept in a search, wide: in one for insertion. step: nodes of it whose neighbours are looked at together. together: nodes
    inserted at a time. block: queries searched together.
    """

    shard: int = 8192
    links: int = 16
    wide: int = 64
    beam: int = 128
    step: int = 4
    together: int = 256
    block: int = 512
    neighbours: int = 5
    seed: int = 11


def _kept(unit: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates ``near`` (nearest first, -1 for none) up to ``most``, padded: those nearer to it than to one already kept, then the nearest of the rest."""
    out = np.full((len(nodes), most), -1, np.int32)
    for k in range(0, len(nodes), 256):
        ids = near[k : k + 256]
        v = unit[ids]
        to_node = np.einsum("ijd,id->ij", v, unit[nodes[k : k + 256]])
        between = v @ v.transpose(0, 2, 1)
        chosen, real = np.zeros(ids.shape, bool), ids >= 0
        for c in range(ids.shape[1]):
            closer = (between[:, c] > to_node[:, c, None]) & chosen
            chosen[:, c] = real[:, c] & ~closer.any(1) & (chosen.sum(1) < most)
        room = most - chosen.sum(1)
        rest = ~chosen & real
        chosen |= rest & (np.cumsum(rest, 1) <= room[:, None])
        row, column = np.nonzero(chosen)
        place = np.cumsum(chosen, 1)[row, column] - 1
        out[k + row, place] = ids[row, column]
    return out


def _sorted(unit: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Candidates nearest first, without repeats and the node itself; -1 last."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == nodes[:, None]] = -1
    score = np.where(near < 0, -9, np.einsum("ijd,id->ij", unit[near], unit[nodes]))
    return np.take_along_axis(near, np.argsort(-score, axis=1, kind="stable"), 1)


def _link(unit: np.ndarray, links: np.ndarray, nodes: np.ndarray, found: np.ndarray, few: int) -> None:
    """Links new ``nodes`` of a layer with what they found."""
    peers = unit[nodes] @ unit[nodes].T
    peers[np.arange(len(nodes)), np.arange(len(nodes))] = -9
    peers = nodes[np.argsort(-peers, axis=1, kind="stable")[:, : min(few, len(nodes) - 1)]].astype(np.int32).reshape(len(nodes), -1)
    kept = _kept(unit, nodes, _sorted(unit, nodes, np.hstack([found.astype(np.int32), peers])), few)
    links[nodes, :few] = kept
    a, b = np.repeat(nodes, few), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    targets, first, count = np.unique(b, return_index=True, return_counts=True)
    if not len(targets):
        return
    new = np.full((len(targets), count.max()), -1, np.int32)
    new[np.repeat(np.arange(len(targets)), count), np.arange(len(b)) - np.repeat(first, count)] = a
    both = _sorted(unit, targets, np.hstack([links[targets], new]))
    room = links.shape[1]
    over = np.flatnonzero((both >= 0).sum(1) > room)
    links[targets] = both[:, :room]
    if len(over):
        links[targets[over]] = _kept(unit, targets[over], both[over], room)


def build(ids: np.ndarray, vectors: np.ndarray, p: Parameters) -> bytes:
    """A shard's index: distinct vectors, their ids in a row with where each one's begin, and from the lowest layer up its nodes and their neighbour array."""
    rng = np.random.default_rng(p.seed)
    vectors, of = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    begin = np.searchsorted(of.ravel()[order], np.arange(len(vectors) + 1))
    n = len(vectors)
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(np.float32)
    height = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(p.links)).astype(int), 8)
    layers = [np.full((n, p.links * (2 if k == 0 else 1)), -1, np.int32) for k in range(height.max() + 1)]
    todo = rng.permutation(n)
    todo = np.append(todo[height[todo] == height.max()][:1], todo[todo != todo[height[todo] == height.max()][0]])  # the entry: a node of the top layer
    entry, at = todo[0], 1
    while at < n:
        nodes = todo[at : at + min(p.together, at)]  # never more than are in the graph
        now = np.full((len(nodes), 1), entry)
        for k in range(len(layers) - 1, -1, -1):
            mine = height[nodes] >= k
            found = np.full((len(nodes), p.wide), -1)
            for some, beam in ((mine, p.wide), (~mine, 4)):
                if some.any():
                    best = _beam(unit, layers[k], unit[nodes[some]], now[some], beam, p.step if beam > 4 else 1)
                    found[some, : best.shape[1]] = best[:, : p.wide]
            if mine.any():
                _link(unit, layers[k], nodes[mine], found[mine], p.links)
            now = found[:, :1]
        at += len(nodes)
    arrays = {"ids": ids[order], "begin": begin, "vectors": vectors, "unit": unit, "entry": np.array([entry])}
    for k, links in enumerate(layers):
        held = np.flatnonzero(height >= k)
        place = np.full(n + 1, -1, np.int32)
        place[held] = np.arange(len(held))
        arrays[f"nodes{k}"], arrays[f"links{k}"] = held.astype(np.int32), place[links[held]]
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _beam(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, step: int) -> np.ndarray:
    """Of one layer, for each query the best nodes found from its entry nodes (one or more each), best first; -1 where there are fewer."""
    q, n = len(queries), len(unit)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    seen[rows, entry] = True
    score = np.einsum("ijd,id->ij", unit[entry], queries)
    wide = beam + step * links.shape[1]
    nodes, scores, done = np.full((q, wide), n), np.full((q, wide), -9, np.float32), np.ones((q, wide), bool)
    nodes[:, : entry.shape[1]], scores[:, : entry.shape[1]], done[:, : entry.shape[1]] = entry, score, False
    padded = np.vstack([np.where(links < 0, n, links), np.full((1, links.shape[1]), n)])
    extended = np.vstack([unit, np.zeros((1, unit.shape[1]), np.float32)])
    while True:
        order = np.argsort(-scores, axis=1, kind="stable")
        nodes, scores, done = (np.take_along_axis(x, order, 1) for x in (nodes, scores, done))
        done[:, beam:] = True
        nodes[:, beam:], scores[:, beam:] = n, -9
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            return np.where(nodes[:, :beam] == n, -1, nodes[:, :beam])
        first = np.argsort(done[active], axis=1, kind="stable")[:, :step]
        open_ = ~np.take_along_axis(done[active], first, 1)
        expand = np.where(open_, np.take_along_axis(nodes[active], first, 1), n)
        done[active[:, None], first] = True
        new = np.sort(padded[expand].reshape(len(active), -1), axis=1)
        again = np.zeros(new.shape, bool)
        again[:, 1:] = new[:, 1:] == new[:, :-1]
        new[again | seen[active[:, None], new]] = n
        seen[active[:, None], new] = True
        found = np.einsum("ijd,id->ij", extended[new], queries[active])
        found[new == n] = -9
        nodes[active, beam:], scores[active, beam:], done[active, beam:] = new, found, new == n


class Index:
    """A shard's index, read."""

    def __init__(self, raw: bytes) -> None:
        with np.load(io.BytesIO(raw)) as x:
            self.ids, self.begin, self.vectors, self.unit, self.entry = (x[k] for k in ("ids", "begin", "vectors", "unit", "entry"))
            self.layers = [(x[f"nodes{k}"], x[f"links{k}"]) for k in range(sum(f.startswith("nodes") for f in x.files))]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, p: Parameters) -> pd.DataFrame:
        """query_id, vec_id, score: each query's nearest but itself."""
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        scaled = (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)
        best = np.full((len(queries), 1), self.entry[0])
        for k in range(len(self.layers) - 1, 0, -1):
            nodes, links = self.layers[k]
            entry = np.searchsorted(nodes, best)
            best = nodes[_beam(self.unit[nodes], links, scaled, entry, 8, 1)[:, :1]]
        found = _beam(self.unit, self.layers[0][1], scaled, best, min(p.beam, len(self.vectors)), p.step)
        a, b = np.nonzero(found >= 0)
        b = found[a, b]
        score = cosines(queries[a], self.vectors[b])
        # of equal vectors the smallest ids, and one more as the query's own may be among them
        size = np.minimum(np.diff(self.begin)[b], p.neighbours + 1)
        row = np.repeat(np.arange(len(b)), size)
        ids = self.ids[self.begin[b][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
        out = pd.DataFrame({"query_id": query_ids[a][row], "vec_id": ids, "score": score[row]})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return out.groupby("query_id").head(p.neighbours)


def nearest(vectors: DataFrame, queries: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its nearest of ``vectors`` (both vec_id, embedding) by cosine, but for its own vec_id."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "hnsw")
    used = scratch.write(usable(vectors), "used")
    # one row for each dimension
    shards = scratch.write(used.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(p.shard)).cast("int").alias("shards")), "shards")
    dealt = used.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        out = pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "index": [build(rows["vec_id"].to_numpy(), matrix(rows["embedding"]), p)]})
        release()
        return out

    index = scratch.write(dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, index binary"), "index")
    scratch.drop("used")
    # the stated queries go to every shard, one copy of each; an index is read once, before its queries
    asked = usable(queries).join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "vec_id", "embedding")
    rows = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(asked.schema["embedding"].dataType).alias("embedding"), "index")
    rows = rows.unionByName(asked.select("dim", "shard", F.lit(1).alias("kind"), "vec_id", "embedding", F.lit(None).cast("binary").alias("index")))
    rows = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, waiting = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if ids and index is not None:
                found = index.search(np.array(ids), np.array(waiting), p)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)
            ids.clear()
            waiting.clear()

        for batch in batches:
            kinds, keys, embeddings, raw = batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5)
            for k, kind in enumerate(kinds):
                if kind == 0:
                    yield from out()
                    index = Index(raw[k].as_py())
                    continue
                ids.append(keys[k].as_py())
                waiting.append(np.asarray(embeddings[k].values, np.float64))
                if len(ids) == p.block:
                    yield from out()
        yield from out()

    found = rows.mapInArrow(released(look), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.neighbours).select("query_id", "rank", "vec_id", "score")
