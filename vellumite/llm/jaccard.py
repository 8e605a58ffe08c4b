"""Exact Jaccard join on word n-grams by grouped prefixes.

A document's set holds the distinct word n-grams of its whole text. All sets together are about
twice the input, so they are never written: each pass that needs them splits the texts anew.
Sets are ordered from rare n-grams to frequent ones, by a counter table over all documents;
the order only steers the cost, as any one order gives the same links. Two sets within the
threshold share an n-gram of their prefixes, the first ``n - ceil(t * n) + 1`` of them.

Equal sets are collapsed; then sets of the same size and prefix form one group, and only
groups post their prefixes. A posted n-gram that few groups share gives pairs of groups; those
whose sizes allow a link and that share enough posted n-grams for one stay. So do n-grams that
more groups share, as long as few of these are alike in size. A posted n-gram
that many documents hold gives no pairs: its groups are tied to nodes of that n-gram, one for
each band of sizes, so that groups whose sizes allow a link are tied together. What is tied,
directly or through others, makes a block. No link leaves a block: a linked pair shares a
posted n-gram of the second kind, or all that its prefixes share are of the first. Where so
many documents share the counters that rare n-grams look frequent, the sets of large blocks are
ordered and tied once more among themselves, as long as that parts them.

Groups then expand to their members, and a block's whole sets are compared with each other,
exactly: a small block in one task, a large one by pairs of tiles of bounded size. A task
returns for each set its number of links and a spanning forest of them, never pairs. Each set
moves once for each tile of its block; what moves at once is bounded, beyond that the tiles are
compared in parts.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with
nothing and is its own component; a text with fewer words than n has its whole word
sequence as one n-gram. Equal texts link. Repeated rows (one doc_id more than once) each
count as rows; texts that differ under one id link as one document. A row without doc_id joins
nothing, but has the component of an equal text. Ties of the order go by hash. An empty
table gives an empty one; other columns play no part. A very long text is a set like others;
batches are bounded in bytes. n-grams are told apart by 64-bit hashes, sets by 128 bits and
size.
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
from vellumite.llm.counts import SCHEMA, to_blocks, total
from vellumite.llm.store import Scratch, kept, release, released, small_batches
from vellumite.llm.words import mix, shingles, slices, split


@dataclass(frozen=True)
class Parameters:
    """percent: least Jaccard similarity of a link. counters: size of the frequency table, broadcast with a byte each.

    few: the most groups that share an n-gram and are paired whatever their sizes; more are paired while their sizes leave each ``partners`` others in the mean. With more n-grams than ``few`` to a counter, large blocks are tied anew, at
    most ``rounds`` times. posts: of a task that pairs them. tile_sets, tile_grams: of a tile, in expectation. most_broadcast: rows of ids that may be broadcast (four times as many of them alone); members are compared in parts of so many.
    moved: bytes of sets that may be on disk for a comparison in any case; half of all sets may be.
    """

    width: int = 4
    percent: int = 85
    counters: int = 1 << 23
    few: int = 32
    posts: int = 100_000
    tile_sets: int = 1024
    tile_grams: int = 1 << 20
    most_broadcast: int = 1_000_000
    rounds: int = 4
    partners: int = 64
    moved: int = 1 << 28


SAME = ["n", "one", "two"]


def _sets(batches: Iterator[pa.RecordBatch], p: Parameters) -> Iterator[pa.RecordBatch]:
    """For each row of doc_id and text the size and 128 bits of its set, and the set's hashes."""
    kept("jaccard")
    for batch in batches:
        for a, b in slices(batch.column(1)):
            sets = list(shingles(split(batch.column(1).slice(a, b - a)), p.width))
            one = [mix(x).sum(dtype=np.uint64) for x in sets]
            two = [mix(x ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) for x in sets]
            arrays = [
                batch.column(0).slice(a, b - a),
                pa.array([len(x) for x in sets], pa.int64()),
                *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)),
                pa.array([x.tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *SAME, "grams"])


def _whole(docs: DataFrame, p: Parameters) -> DataFrame:
    """The sets of all rows of ``docs``."""
    return docs.mapInArrow(released(lambda batches: _sets(batches, p)), "doc_id long, n long, one long, two long, grams binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows of a binary column in a row, and where each row's begin (one longer)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.uint64), (at - at[0]) // 8


def _slot(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes % np.uint64(counters)).astype(np.int64)


def _classes(docs: DataFrame, p: Parameters) -> tuple[np.ndarray, float]:
    """For each slot 0, or how far the number of documents that hold its n-grams lies above what it may be for rare ones, in powers of two.

    A slot holds several rare n-grams; what lies above their usual sum is due to a frequent one. An n-gram of class 0 is thus held by a bounded number of documents.
    Then the mean of the counters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(p.counters, np.uint32)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for grams in shingles(split(batch.column(0).slice(a, b - a)), p.width):
                    for k in range(0, len(grams), 1 << 20):
                        np.add.at(counts, _slot(grams[k : k + (1 << 20)], p.counters), np.uint32(1))
        rows = list(to_blocks(counts, TaskContext.get().partitionId()))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]))

    counts = total(docs.select("text").mapInArrow(released(run), SCHEMA), p.counters).astype(np.float64)
    mean = counts.mean()
    above = np.maximum(counts - max(p.few, mean + 4 * np.sqrt(mean)), 0)
    return np.ceil(np.log2(1 + above)).astype(np.uint8), float(mean)


def _heads(docs: DataFrame, shared, p: Parameters) -> DataFrame:
    """For each row its group, a hash of size and prefix, and the prefix in the order of the classes, ``rare`` n-grams first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in _sets(batches, p):
            flat, at = _flat(batch.column(4))
            ranks = classes[_slot(flat, p.counters)]
            groups, rare, prefixes = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                head, rank, size = flat[a:b], ranks[a:b], b - a
                keep = size - (p.percent * size + 99) // 100 + 1 if size else 0
                if rank.any():
                    order = np.argsort(rank, kind="stable")[:keep]
                    head, rank = head[order], rank[order]
                else:
                    head, rank = head[:keep], rank[:keep]
                groups.append(int(mix(head).sum(dtype=np.uint64)) ^ size)
                rare.append(int((rank == 0).sum()))
                prefixes.append(head.tobytes())
            arrays = [*batch.columns[:4], pa.array(mix(np.array(groups, np.uint64)).view(np.int64)), pa.array(rare, pa.int64()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *SAME, "gid", "rare", "prefix"])

    return docs.mapInArrow(released(run), "doc_id long, n long, one long, two long, gid long, rare long, prefix binary")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of batches of gid, n, rare, prefix the rows whose group the task has not seen: gids, sizes, rare ones, n-grams, their rows. Copies thus post once for each task."""
    seen: set[int] = set()
    for batch in batches:
        gids = batch.column(0).to_pylist()
        new = []
        for k, g in enumerate(gids):
            if g not in seen:
                seen.add(g)
                new.append(k)
        if len(seen) > 200_000:
            seen.clear()
        if new:
            batch = batch.take(pa.array(new))
            flat, at = _flat(batch.column(3))
            yield *(x.to_numpy() for x in batch.columns[:3]), flat, np.repeat(np.arange(len(batch)), np.diff(at))


_POST = np.dtype([("gram", "<u8"), ("gid", "<i8"), ("n", "<i8")])


def _chosen(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``; texts are not moved for it while these are at most ``most``. What other texts have such an id come too."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_semi")


def _pairs(heads: DataFrame, p: Parameters) -> DataFrame:
    """``u``, ``v``: groups that share rare n-grams of their prefixes and may be similar by their sizes and by how many they share."""
    prefixes = heads.agg(F.coalesce(F.sum("rare"), F.lit(0))).first()[0]
    ranges = max(1, -(-prefixes // p.posts))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts)
            rows = rows[np.argsort(rows["gram"])]
            ends = np.searchsorted((rows["gram"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            held = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([rows[ends[k] : ends[k + 1]].tobytes() for k in held], pa.binary())], names=["range", "posts"])

        parts: list[np.ndarray] = []
        for gids, sizes, rare, grams, rows in _fresh(batches):
            first = np.searchsorted(rows, np.arange(len(gids)))
            held = np.arange(len(grams)) - first[rows] < rare[rows]
            posts = np.empty(int(held.sum()), _POST)
            posts["gram"], posts["gid"], posts["n"] = grams[held], gids[rows[held]], sizes[rows[held]]
            parts.append(posts)
            if sum(map(len, parts)) > 200_000:
                yield from out(parts)
                parts = []
        if parts:
            yield from out(parts)

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        posts = np.frombuffer(b"".join(rows["posts"]), _POST)
        names, first, of = np.unique(posts["gid"], return_index=True, return_inverse=True)
        sizes = posts["n"][first]
        # copies have posted in several tasks
        order = np.lexsort((of, posts["gram"]))
        gram, of = posts["gram"][order], of[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
        gram, of = gram[new], of[new]
        at = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        runs = np.diff(np.r_[at, len(gram)])
        codes = [np.zeros(0, np.int64)]
        for k in range(2, p.few + 1):
            start = at[runs == k]
            if len(start):
                i, j = np.triu_indices(k, 1)
                a, b = of[(start[:, None] + i).ravel()], of[(start[:, None] + j).ravel()]
                small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                may = large * p.percent <= small * 100
                codes.append(a[may] * len(names) + b[may])
        # longer runs, of a bounded length: in the order of their sizes, with those within reach; where these are too many, neighbours are tied, and so all whose sizes allow a link
        tied = [np.zeros((2, 0), np.int64)]
        for s, k in zip(at[runs > p.few].tolist(), runs[runs > p.few].tolist(), strict=True):
            x = of[s : s + k]
            x = x[np.argsort(sizes[x], kind="stable")]
            reach = np.searchsorted(sizes[x] * p.percent, sizes[x] * 100, side="right") - np.arange(1, k + 1)
            if reach.sum() <= p.partners * k:
                a = np.repeat(np.arange(k), reach)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach)
                codes.append(np.minimum(x[a], x[b]) * len(names) + np.maximum(x[a], x[b]))
            else:
                near = reach[:-1] > 0
                tied.append(np.stack([x[:-1][near], x[1:][near]]))
        codes, shared = np.unique(np.concatenate(codes), return_counts=True)
        a, b = codes // len(names), codes % len(names)
        tied = np.concatenate(tied, axis=1)
        a, b, c = np.r_[a, tied[0]], np.r_[b, tied[1]], np.r_[shared, np.full(tied.shape[1], 1 << 40)]
        release()
        return pd.DataFrame({"u": np.minimum(names[a], names[b]), "v": np.maximum(names[a], names[b]), "small": np.minimum(sizes[a], sizes[b]), "large": np.maximum(sizes[a], sizes[b]), "c": c})

    posts = heads.where("n > 0 and doc_id is not null").select("gid", "n", "rare", "prefix").mapInArrow(released(post), "range int, posts binary")
    found = posts.groupBy("range").applyInPandas(pair, "u long, v long, small long, large long, c long")
    # what two similar sets share beyond their prefixes is in the rest of one of them
    rest = F.ceil(F.col("large") * p.percent / F.lit(100)) - 1
    enough = (F.col("c") + rest) * (100 + p.percent) >= (F.col("small") + F.col("large")) * p.percent
    return found.groupBy("u", "v", "small", "large").agg(F.sum("c").alias("c")).where(enough).select("u", "v")


def _ties(heads: DataFrame, p: Parameters) -> DataFrame:
    """``u``, ``v``: groups, and nodes that stand for a frequent n-gram and a band of sizes; sizes that allow a link have a band in common."""
    width = np.log(100 / p.percent) * 1.0001 if p.percent < 100 else 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gids, sizes, rare, grams, rows in _fresh(batches):
            first = np.searchsorted(rows, np.arange(len(gids)))
            held = np.flatnonzero(np.arange(len(grams)) - first[rows] >= rare[rows])
            if len(held):
                bands = np.floor(np.log(sizes[rows[held]]) / width).astype(np.int64).view(np.uint64)
                nodes = [mix(grams[held] ^ mix(bands + np.uint64(k))).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(gids[rows[held]], 2)), pa.array(np.concatenate(nodes))], names=["u", "v"])

    return heads.where("n > rare and n > 0 and doc_id is not null").select("gid", "n", "rare", "prefix").mapInArrow(released(run), "u long, v long")


def shared_counts(sets: list[np.ndarray], few: int = 16) -> np.ndarray:
    """How many elements each two of the sorted distinct ``sets`` share; right for row < column."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    runs = np.diff(np.r_[at, len(flat)])
    # elements of few sets by their pairs, the others by products of matrices, in bounded steps
    for k in range(2, few + 1):
        start = at[runs == k]
        i, j = np.triu_indices(k, 1)
        for s in range(0, len(start), max(1, (1 << 21) // len(i))):
            here = start[s : s + max(1, (1 << 21) // len(i))]
            np.add.at(out.reshape(-1), (owner[here[:, None] + i] * m + owner[here[:, None] + j]).ravel(), 1)
    start, count = at[runs > few], runs[runs > few]
    step = max(1, (1 << 22) // m)
    for s in range(0, len(start), step):
        c = count[s : s + step]
        table = np.zeros((m, len(c)), np.float32)
        places = np.repeat(start[s : s + step], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        table[owner[places], np.repeat(np.arange(len(c)), c)] = 1
        out += (table @ table.T).astype(np.int32)
    return out


def _compare(rows: list[tuple], same: bool, p: Parameters) -> list[tuple]:
    """Of one tile (``same``) or a pair of tiles, rows of side, sid, n, one, two, copies, grams: sid, n, one, two, links, root for those that have links."""
    rows = sorted({(x[1], x[2], x[3], x[4], x[0]): x for x in rows}.values(), key=lambda x: x[1:5])
    side = np.array([x[0] for x in rows])
    sizes, copies = np.array([x[2] for x in rows]), np.array([x[5] for x in rows])
    common = shared_counts([np.frombuffer(x[6], np.uint64) for x in rows])
    linked = 100 * common.astype(np.int64) >= p.percent * (sizes[:, None] + sizes - common)
    linked = np.triu(linked, 1)
    if not same:  # the tiles' own pairs are compared elsewhere
        linked &= side[:, None] != side
    linked |= linked.T
    links = linked @ copies
    root = np.arange(len(rows))
    while True:
        least = np.minimum(root, np.where(linked, root, len(rows)).min(1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return [(*rows[k][1:5], int(links[k]), rows[root[k]][1]) for k in np.flatnonzero(links).tolist()]


def _compared(blocks: DataFrame, p: Parameters) -> DataFrame:
    names = ["sid", *SAME, "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = _compare(rows, now[1] == now[2], p) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)

        now, rows = None, []
        for batch in batches:
            for block, low, high, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (block, low, high) != now:
                    yield from out(rows)
                    now, rows = (block, low, high), []
                rows.append(tuple(row))
        yield from out(rows)

    key = ["block", "low", "high"]
    dealt = blocks.select(*key, "side", "sid", *SAME, "copies", "grams").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(released(run), ", ".join(f"{x} long" for x in names))


def join(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id reachable by links), ``n_links`` (other rows linked directly), for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def tied(docs: DataFrame, tag: str) -> tuple[DataFrame, float]:
        """The rows of ``docs`` with their groups' blocks, and the load of the counters."""
        classes, load = _classes(docs, p)
        heads = scratch.write(_heads(docs, spark.sparkContext.broadcast(classes), p), f"heads{tag}")
        ties = scratch.write(_pairs(heads, p).unionByName(_ties(heads, p)), f"ties{tag}")
        rows = scratch.write(heads.drop("rare", "prefix"), f"rows{tag}")
        scratch.drop(f"heads{tag}")
        blocks = components(ties, scratch, f"blocks{tag}").withColumnRenamed("node", "gid")
        scratch.drop(f"ties{tag}")
        return rows.join(blocks, "gid", "left").select("doc_id", *SAME, F.coalesce("component", "gid").alias("block")), load

    rows, load = tied(docs, "")
    rows = scratch.write(rows, "blocked")
    scratch.drop("rows")
    # equal sets: one representative, the smallest doc_id
    unique = rows.where("n > 0 and doc_id is not null").groupBy(*SAME).agg(F.min("doc_id").alias("sid"), F.count("*").alias("copies"), F.first("block").alias("block"))
    unique = scratch.write(unique, "unique")
    before = None
    for k in range(p.rounds if load > p.few else 0):
        large = unique.groupBy("block").agg(F.count("*").alias("c")).where(F.col("c") > p.tile_sets)
        size = large.agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).first()[0]
        if not size or before is not None and size > 0.9 * before:
            break
        before = size
        some = scratch.write(unique.join(large.select("block"), "block", "left_semi").select(F.col("sid").alias("doc_id"), *SAME), f"large-{k}")
        again, _ = tied(_chosen(docs, some.select("doc_id").distinct(), 4 * p.most_broadcast), f"-{k}")
        again = again.join(some.select(*SAME), SAME, "left_semi").groupBy(*SAME).agg(F.min("block").alias("new"))
        unique = unique.join(again, SAME, "left").select(*SAME, "sid", "copies", F.coalesce("new", "block").alias("block"))
        unique = scratch.write(unique, f"unique-{k}")
    tiles = F.ceil(F.greatest(F.count("*") / F.lit(p.tile_sets), F.sum("n") / F.lit(p.tile_grams))).cast("int")
    several = unique.groupBy("block").agg(F.count("*").alias("c"), tiles.alias("tiles"), (F.sum("n") * 8 * tiles).alias("moved")).where("c > 1")
    several = scratch.write(several, "several")
    # in parts, so that neither their rows are too many to broadcast nor all that is compared is on disk at once; a block is in one part, or by pairs of its tiles in several
    count, moved = several.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("moved"), F.lit(0))).first()
    limit = max(p.moved, unique.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 4)
    parts, names = max(1, -(-moved // limit), -(-count // p.most_broadcast) if p.most_broadcast else 1), []
    several = several.select("block", "tiles", F.least(F.lit(parts), F.ceil(F.col("moved") / limit)).alias("spread"))
    members = scratch.write(unique.join(F.broadcast(several) if several.count() <= p.most_broadcast else several, "block"), "members")
    first = F.xxhash64("block")
    for k in range(parts):
        some = members.where(F.pmod(F.lit(k) - F.pmod(first, F.lit(parts)), F.lit(parts)) < F.col("spread"))
        few = some.count() <= 2 * p.most_broadcast
        whole = _whole(_chosen(docs, some.select(F.col("sid").alias("doc_id")).distinct(), 4 * p.most_broadcast), p)
        whole = whole.withColumnRenamed("doc_id", "sid").join(F.broadcast(some) if few else some, ["sid", *SAME])
        tile = F.pmod(F.xxhash64("one", "two"), F.col("tiles"))
        whole = whole.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        whole = whole.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other"), "side": (F.col("tile") > F.col("other")).cast("int")})
        whole = whole.where(F.pmod(F.pmod(first, F.lit(parts)) + F.pmod(F.xxhash64("low", "high"), F.col("spread")), F.lit(parts)) == k)
        names.append(f"found-{k}")
        part = scratch.write(_compared(whole, p), names[-1])
        found = part if not k else found.unionByName(part)
    edges = found.select(F.col("sid").alias("u"), F.col("root").alias("v"))
    again = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    again = scratch.write(again, "again")
    if again.head(1):  # rows that repeat an id
        edges = edges.unionByName(rows.join(again, "doc_id").join(unique, SAME).select(F.col("doc_id").alias("u"), F.col("sid").alias("v")))
    label = components(edges, scratch).withColumnRenamed("node", "sid")
    links = found.groupBy(*SAME).agg(F.sum("links").alias("links"))
    final = unique.join(label, "sid", "left").join(links, SAME, "left")
    final = final.select(*SAME, F.coalesce("component", "sid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    final = scratch.write(final, "final")
    scratch.drop("unique", "several", "members", *names, "again")
    out = rows.select("doc_id", *SAME).join(final, SAME, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
