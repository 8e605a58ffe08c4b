"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier is trained in numpy from confirmed toxic texts and unlabelled ones.
With class prior ``pi`` and a loss ``l`` its risk is ``pi * Rp(+) + max(0, Ru(-) - pi * Rp(-))``:
what the positives among the unlabelled texts add to the negative risk is taken off, and
where the estimate falls below zero, its gradient is reversed.

Features of a text are hashes of its distinct words (letters and digits, A-Z lower-cased)
and of their first 4, 5 and 6 bytes, each as three features: it occurs once, twice, four
times or more often. Only features that are several times as frequent in
the toxic texts as in the unlabelled ones get a weight, so that a text's length alone
doesn't move its score.

Defined cases: a null or empty text has no feature and gets the score of the intercept,
which is low. Repeated rows are scored alike. Of near copies in the sample (word 3-grams
alike by ``copies``, estimated from their 128 smallest hashes; exact up to these) one counts on each
side. With no toxic example every score is 0. Null labels count as no label. A score at the threshold is one
above it. Very long texts are scored whole; an empty table gives an empty one. Columns to keep
may have any names but ``score`` and ``_text``. Which rows are trained on depends on their ids alone, not on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vellumite.llm.counts import SCHEMA, to_blocks, total
from vellumite.llm.store import Scratch, released, small_batches
from vellumite.llm.words import PUNCTUATION, shingles, slices, split


@dataclass(frozen=True)
class Parameters:
    """most_positive, most_unlabelled: bounds (the second an expectation) on the texts trained on.

    copies: least Jaccard similarity of texts of which one is trained on. slots: hash slots for features. least_ratio: a feature's frequency in toxic over that in unlabelled texts, and
    least_surprise: minus the log of the chance of that frequency, below which the feature has no weight. prior: the class prior; None: the
    share of toxic rows among the labelled ones, within 0.01 to 0.5. epochs, batches: steps are their product.
    """

    most_positive: int = 20_000
    most_unlabelled: int = 40_000
    copies: float = 0.8
    slots: int = 1 << 20
    prefixes: tuple[int, ...] = (4, 5, 6)
    least_ratio: float = 3.0
    least_surprise: float = 14.0
    prior: float | None = None
    epochs: int = 60
    batches: int = 20
    least_in_batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7


#: A hash gives a feature for each of these numbers of occurrences that it reaches.
LEVELS = (1, 2, 4)


@dataclass(frozen=True)
class Model:
    """Sorted ``hashes`` that have weights, one for each level; ``held``: whether a slot has one."""

    hashes: np.ndarray
    weights: np.ndarray
    held: np.ndarray
    bias: float


def features(column: pa.Array, p: Parameters) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For slices of a string column: text numbers and hashes, with repeats, and the slice's number of texts."""
    for a, b in slices(column):
        words = split(column.slice(a, b - a), PUNCTUATION)
        which, hashes = [np.arange(len(words.hashes))], [words.hashes]
        for length in p.prefixes:
            k, h = words.prefixes(length)
            which.append(k)
            hashes.append(h)
        yield words.text(np.concatenate(which)), np.concatenate(hashes), b - a


def _slot(hashes: np.ndarray, p: Parameters) -> np.ndarray:
    return (hashes % np.uint64(p.slots)).astype(np.int64)


def _surprising(here: np.ndarray, there: np.ndarray, n_positive: int, n_other: int, p: Parameters) -> np.ndarray:
    """The features that ``here`` toxic and ``there`` other texts hold and that get a weight."""
    expected = n_positive * (there + 0.5) / n_other
    # Chernoff's bound on the chance of so many toxic texts, if toxic ones held the feature as often as others
    surprise = np.where(here > expected, here * np.log(np.maximum(here, 1) / expected) - here + expected, 0)
    return np.flatnonzero((surprise >= p.least_surprise) & (here >= p.least_ratio * expected))


def _counted(texts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of text and key, by text, and how often each occurs."""
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return texts[at], keys[at], np.diff(np.append(at, len(texts)))


def train(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic, of the rows that may be learned from."""
    small_batches(docs.sparkSession)
    nothing = Model(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)), np.float32), np.zeros(p.slots, bool), -30.0)
    labels = labels.where("toxic is not null and doc_id is not null")
    n, toxic = labels.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not toxic:
        return nothing
    prior = p.prior or min(0.5, max(0.01, toxic / n))
    positive = labels.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(p.most_positive)
    positive = docs.sparkSession.createDataFrame(positive.toPandas(), labels.select("doc_id").schema).withColumn("_positive", F.lit(True))
    share = min(1.0, p.most_unlabelled / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(share * 1_000_003)
    # the positive ids are at most most_positive, hence the broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(positive), "doc_id", "left").where(F.col("_positive") | chosen)
    sample = sample.select("text", F.coalesce("_positive", F.lit(False)).alias("positive"))
    # of the sample's near copies one stays on each side, lest their common words pass for toxic ones
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(sample.mapInArrow(released(_sketches), "text string, positive boolean, keys binary, sketch binary").withColumn("row", F.monotonically_increasing_id()), "all")
    # a fixed number of bytes for each text of the bounded sample
    gone = _copies(sample.select("row", "positive", "keys", "sketch").toArrow(), p)
    sample = sample.select("row", "text", "positive")
    if gone:
        sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"row": pa.array(gone, pa.int64())}))), "row", "left_anti")
    sample = sample.select("text", "positive")
    size, levels = p.slots, len(LEVELS)
    counted = total(sample.mapInArrow(released(_counter(p)), SCHEMA), 2 * levels * size + 2)
    both, (n_positive, n_other) = counted[:-2].astype(np.float64).reshape(2, levels, size), counted[-2:].tolist()
    if not n_positive or not n_other:
        return nothing
    held = np.zeros(size, bool)
    for k in range(levels):
        held[_surprising(both[0, k], both[1, k], n_positive, n_other, p)] = True
    # hashes that share a slot are told apart in the same sample
    rows = sample.mapInArrow(released(_sparse(held, p)), "positive boolean, hashes array<long>, counts array<int>").toArrow()
    positive = np.array(rows["positive"].to_pylist(), bool)
    lengths = np.array([len(x) for x in rows["hashes"].to_pylist()], np.int64)
    flat = np.array(rows["hashes"].combine_chunks().flatten(), np.int64)
    times = np.array(rows["counts"].combine_chunks().flatten(), np.int64)
    scratch.drop("all")
    known, of = np.unique(flat, return_inverse=True)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.full((levels, len(known)), -1, np.int64)
    n_used = 0
    for k, least in enumerate(LEVELS):
        here, there = (np.bincount(of[(times >= least) & (positive[text] == side)], minlength=len(known)).astype(float) for side in (True, False))
        used = _surprising(here, there, n_positive, n_other, p)
        place[k, used] = n_used + np.arange(len(used))
        n_used += len(used)
    found = np.concatenate([place[k, of] * (times >= least) - (times < least) for k, least in enumerate(LEVELS)])
    texts = np.tile(text, levels)[found >= 0]
    found = found[found >= 0][np.argsort(texts, kind="stable")]
    weights, bias = fit(np.split(found, np.searchsorted(np.sort(texts), np.arange(1, len(lengths)))), positive, n_used, prior, p)
    table = np.where(place >= 0, np.append(weights, 0)[place], 0).T
    kept = np.flatnonzero(np.abs(table).sum(1))
    hashes, table = known[kept].view(np.uint64), table[kept]
    order = np.argsort(hashes)
    held[:] = False
    held[_slot(hashes, p)] = True
    return Model(hashes[order], table[order].astype(np.float32), held, float(bias))


#: Hashes in a sketch; keys of two smallest hashes each, one of which texts alike by 0.8 share but for a chance of 1e-7.
SKETCH, KEYS, GRAM = 128, 16, 3
_FACTORS = [int(x) | 1 for x in np.random.default_rng(11).integers(1, 2**63, size=2 * KEYS, dtype=np.uint64)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds keys that near copies share, and the upper halves of the smallest hashes of a text's word n-grams."""
    for batch in batches:
        keys: list[bytes] = []
        sketches: list[bytes] = []
        for a, b in slices(batch.column(0)):
            sets = list(shingles(split(batch.column(0).slice(a, b - a), PUNCTUATION), GRAM))
            sketches += [(x[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for x in sets]
            full = [x for x in sets if len(x)]
            if full:
                flat, at = np.concatenate(full), np.cumsum([0, *map(len, full[:-1])])
                least = [np.minimum.reduceat(flat * np.uint64(x), at) for x in _FACTORS]
                found = iter(np.stack([least[k] * np.uint64(3) + least[k + 1] for k in range(0, 2 * KEYS, 2)], 1).astype("<u8"))
            keys += [next(found).tobytes() if len(x) else b"" for x in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["text", "positive", "keys", "sketch"])


def _copies(rows: pa.Table, p: Parameters) -> list[int]:
    """The rows that are near copies of one that stays, of the same side."""
    by = ("positive", "sketch", "keys", "row")
    order = sorted(zip(*(rows[c].to_pylist() for c in by), strict=True))
    smallest, last = np.full((len(order), SKETCH), _NONE, np.int64), np.full(len(order), _NONE - 1, np.int64)
    stay: dict[tuple, list[int]] = {}
    gone = []
    before = None
    for k, (positive, sketch, keys, row) in enumerate(order):
        if (positive, sketch, keys) == before:  # equal sets
            gone.append(row)
            continue
        before = positive, sketch, keys
        mine = np.frombuffer(sketch, "<u4").astype(np.int64)
        smallest[k, : len(mine)] = mine
        if len(mine) == SKETCH:
            last[k] = mine[-1]
        places = [(positive, j, key) for j, key in enumerate(np.frombuffer(keys, "<u8").tolist())]
        near = np.array(sorted({x for place in places for x in stay.get(place, ())}), np.int64)
        for at in range(0, len(near), 2000):
            if (_alike(mine, last[k], smallest[near[at : at + 2000]], last[near[at : at + 2000]]) >= p.copies).any():
                gone.append(row)
                break
        else:
            for place in places:
                stay.setdefault(place, []).append(k)
    return gone


#: Fills sketches; above all halves of hashes.
_NONE = 1 << 40


def _alike(mine: np.ndarray, end: int, others: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Jaccard similarities to ``others`` by the hashes up to the place that both sketches reach."""
    until = np.minimum(end, ends)
    held = others <= until[:, None]
    at = np.minimum(np.searchsorted(mine, others), max(0, len(mine) - 1))
    shared = ((mine[at] == others) & held).sum(1)
    return shared / np.maximum(1, held.sum(1) + np.searchsorted(mine, until, side="right") - shared)


def _counter(p: Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(2 * len(LEVELS) * p.slots + 2, np.uint32)
        table, sides = counts[:-2].reshape(2, len(LEVELS), p.slots), counts[-2:]
        for batch in batches:
            at, positive = 0, np.array(batch.column(1).to_pylist(), bool)
            for texts, hashes, n in features(batch.column(0), p):
                flags = positive[at : at + n]
                texts, slots, times = _counted(texts, _slot(hashes, p))
                for side, of in ((0, True), (1, False)):
                    for k, least in enumerate(LEVELS):
                        table[side, k] += np.bincount(slots[(flags[texts] == of) & (times >= least)], minlength=p.slots).astype(np.uint32)
                    sides[side] += np.uint32((flags == of).sum())
                at += n
        rows = list(to_blocks(counts, TaskContext.get().partitionId()))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())]))

    return run


def _sparse(held: np.ndarray, p: Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: tuple[list[np.ndarray], list[np.ndarray]] = [], []
            for texts, hashes, n in features(batch.column(0), p):
                keep = held[_slot(hashes, p)]
                texts, hashes, times = _counted(texts[keep], hashes[keep])
                cuts = np.searchsorted(texts, np.arange(1, n))
                lists[0].extend(np.split(hashes.view(np.int64), cuts))
                lists[1].extend(np.split(np.minimum(times, LEVELS[-1]).astype(np.int32), cuts))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int32()))], names=["positive", "hashes", "counts"])

    return run


def fit(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, p: Parameters) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative risk with the logistic loss; ``rows`` hold feature numbers."""
    rng = np.random.default_rng(p.seed)
    theta, m, v, step = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
    theta[-1] = np.log(prior / (1 - prior))
    groups = [np.flatnonzero(positive), np.flatnonzero(~positive)]

    def gathered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(rows[i]) for i in ids], np.int64)
        flat = np.concatenate([rows[i] for i in ids]) if lengths.sum() else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(ids)), lengths), flat.astype(np.int64), lengths

    def margins(of: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of, weights=theta[flat], minlength=n) + theta[-1]

    def back(of: np.ndarray, flat: np.ndarray, each: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, weights=each[of], minlength=size + 1)
        out[-1] += each.sum()
        return out

    # a batch with few toxic texts estimates their part of the risk too loosely, so fewer of them make larger batches
    batches = max(1, min(p.batches, len(groups[0]) // p.least_in_batch))
    for _ in range(p.epochs * p.batches // batches):
        orders = [rng.permutation(g) for g in groups]
        for k in range(batches):
            ids = [o[k::batches] for o in orders]
            if not len(ids[0]) or not len(ids[1]):
                continue
            (of_p, flat_p, n_p), (of_u, flat_u, n_u) = map(gathered, ids)
            g_p, g_u = margins(of_p, flat_p, len(n_p)), margins(of_u, flat_u, len(n_u))
            s_p, s_u = 1 / (1 + np.exp(-np.clip(g_p, -30, 30))), 1 / (1 + np.exp(-np.clip(g_u, -30, 30)))
            negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
            d_negative = back(of_u, flat_u, s_u / len(s_u)) - prior * back(of_p, flat_p, s_p / len(s_p))
            grad = prior * back(of_p, flat_p, (s_p - 1) / len(s_p)) + d_negative if negative >= 0 else -d_negative
            grad[:-1] += p.decay * theta[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            # a text without any feature is no likelier toxic than the prior; reversed steps would else lift it without end
            theta = np.clip(theta, -15, 15)
            theta[-1] = min(theta[-1], np.log(prior / (1 - prior)))
    return theta[:-1], theta[-1]


def score(docs: DataFrame, model: Model, keep: list[str], p: Parameters = Parameters()) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``; only ``text`` is an input of it. The model's size is set by ``slots``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    fields = [*kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [np.zeros(0)]
            for texts, hashes, n in features(batch.column(len(fields)), p):
                keep = model.held[_slot(hashes, p)]
                texts, hashes, times = _counted(texts[keep], hashes[keep])
                at = np.searchsorted(model.hashes, hashes)
                at[at == len(model.hashes)] = 0
                same = model.hashes[at] == hashes if len(model.hashes) else np.zeros(0, bool)
                each = sum(model.weights[at[same], k] * (times[same] >= least) for k, least in enumerate(LEVELS))
                g = np.bincount(texts[same], weights=each, minlength=n) + model.bias
                found.append(1 / (1 + np.exp(-np.clip(g, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(np.concatenate(found), pa.float64())], names=[*[f.name for f in fields], "score"])

    return kept.mapInArrow(released(run), StructType([*fields, StructField("score", DoubleType())]))
