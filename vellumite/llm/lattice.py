"""Language-model scores from a lattice of subword pieces.

A word's probability is the sum over all its segmentations into the pieces of an existing
unigram vocabulary, by a forward recursion in log space; a text's is the product over its
tokens, so that the marginal runs over all segmentations of the whole text. The vocabulary's
scores weigh the pieces; expectation maximisation over all training words fits the weights to
the corpus, with the scores as their prior. One more arc spans each word that the corpus
knows, with its discounted share of the tokens; what the discounts take is the pieces' part.
Likewise one more arc spans each line that the corpus holds more than once, with its share of
the lines, less one: the rest is the words' part. So what repeats over documents is scored apart.

Training rows may have a kind (a language, say; null is one too). Each kind has weights and
counts of its own, backed off to those of all rows, and a text's probability is the sum over
kinds, each weighed by its share of training rows: the kind of a scored text is never an
input. Every word has its whole lattice, whatever its length, for every kind; the cost grows
with the number of kinds.

Tokens are words (A-Z lower-cased) and one end for each text. What is gathered from the
corpus, the counts of all its words and of its repeated lines, grows with it and is never in one place: words are kept in
ranges of the words' hashes, each of the words of a bounded number of bytes of text. Only the most frequent words, up
to a fixed number, are looked up in place; the other words of the texts are sent, counted by
text, to the range that knows them.

Defined cases: null texts count as empty; an empty text has one token, its end. With no
training text all counts are 0, and the base scores follow their formula. Repeated rows
count in training each and are scored each. Scores are finite for any text. An empty table
gives an empty one. Words are told apart by 64-bit hashes where they are looked up in place. Names of ``keep`` may be any but those of the result's other columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from vellumite.llm.store import Scratch, kept, release, released, small_batches
from vellumite.llm.words import Lookup, buffers, lines, mix, powers, sequences, slices, split

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Natural log-probability that the pieces' part gives to a text's end, which no piece spells.
_END = -20.0
#: Words whose lattices are held at a time.
_WORDS = 8_000


@dataclass(frozen=True)
class Parameters:
    """frequent: the number of words looked up in place, which bounds the table that is broadcast. discount: what each known word's count loses.

    prior: weight of the vocabulary's own scores, in counts. rounds: of expectation maximisation; 0 keeps the vocabulary's scores.
    range_bytes: text whose words make a range.
    """

    frequent: int = 100_000
    discount: float = 0.6
    prior: float = 20.0
    rounds: int = 3
    range_bytes: int = 16 << 20


class Pieces:
    """A unigram vocabulary as a lattice; a word begins with the mark. A character that is no piece has an arc for its bytes."""

    def __init__(self, pieces: list[str], mark: str) -> None:
        self.pieces, self.mark = pieces, mark
        self.longest = max(map(len, pieces))
        self.table = Lookup(np.array([self._hash(x) for x in pieces], np.uint64), np.arange(len(pieces)))
        # how long pieces can be that begin with two characters, by a hash of these
        self.reach = np.ones(1 << 16, np.int64)
        for x in pieces:
            if len(x) > 1:
                k = int(self._pair(np.array([ord(x[0])]), np.array([ord(x[1])]))[0])
                self.reach[k] = max(self.reach[k], len(x))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 0x9E37 + b.astype(np.int64) * 0x85EB) & 0xFFFF

    @staticmethod
    def _hash(piece: str) -> int:
        up, _ = powers(64)
        codes = np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        return int(mix((codes * up[: len(codes)]).sum(dtype=np.uint64) + np.array([len(codes)], np.uint64))[0])

    @classmethod
    def load(cls, path: str) -> tuple[Pieces, np.ndarray]:
        """Of a sentencepiece model, with normalised natural log weights; scores that are ranks (0, -1, -2, ...) are read as Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
                piece = model.id_to_piece(k)
                if piece == piece.lower():
                    scores[piece] = model.get_score(k)
        weights = np.array(list(scores.values()))
        return cls(list(scores), "▁"), normalised(-np.log(2 - weights) if weights.min() < -1000 else weights)

    def lattice(self, words: list[str]) -> Lattice:
        """All arcs of all words."""
        flat = np.frombuffer("".join([f"{self.mark}{w}" for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + len(self.mark)
        n, first = len(flat), np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(n) - first[word]
        room = lengths[word] - place
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat + 1).astype(np.uint64) * up[:n], out=sums[1:])
        reach = np.ones(n, np.int64)
        if n > 1:
            reach[:-1] = self.reach[self._pair(flat[:-1], flat[1:])]
        reach = np.minimum(reach, room)
        at, ids, size = [], [], []
        for length in range(1, min(self.longest, int(lengths.max(initial=0))) + 1):
            here = np.flatnonzero(reach >= length)
            if not len(here):
                break
            held, found = self.table.get(mix((sums[here + length] - sums[here]) * down[here] + np.uint64(length)))
            at.append(here[held])
            ids.append(found)
            size.append(np.full(len(held), length))
            if length == 1:  # characters that are no piece: as many bytes as they have in UTF-8
                bare = np.setdiff1d(here, here[held], assume_unique=True)
                at.append(bare)
                ids.append(len(self.pieces) - 1 + np.searchsorted([0x80, 0x800, 0x10000], flat[bare], side="right") + 1)
                size.append(np.ones(len(bare), np.int64))
        if not at:
            at = ids = size = [np.zeros(0, np.int64)]
        at, ids, size = map(np.concatenate, (at, ids, size))
        order = np.lexsort((size, place[at] + size))
        at, ids, size = at[order], ids[order], size[order]
        step = (place[at] + size) * (self.longest + 1) + size
        cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(step)]
        # a word has one node more than characters
        begin = at + word[at]
        return Lattice(begin, begin + size, ids, word[at], [*zip(cuts[:-1], cuts[1:], strict=True)], first + np.arange(len(words)), lengths)

    def arcs(self, weights: np.ndarray) -> np.ndarray:
        """Log weights of the pieces (in the last axis), and of one to four bytes."""
        byte = weights.min(axis=-1, keepdims=True) - math.log(256)
        return np.concatenate([weights, *(byte * (k + 1) for k in range(4))], axis=-1)


@dataclass
class Lattice:
    """Arcs between nodes of words, in the order of the recursion: ``steps`` are ranges of arcs that end at one place of their words and are of one length."""

    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    steps: list[tuple[int, int]]
    start: np.ndarray
    lengths: np.ndarray

    def forward(self, arcs: np.ndarray) -> np.ndarray:
        """Log-space forward recursion: for each row of ``arcs`` the log of the sum over all ways from a word's beginning to each node."""
        alpha = np.full((len(arcs), int(self.lengths.sum()) + len(self.lengths)), -np.inf)
        alpha[:, self.start] = 0
        for a, b in self.steps:
            to = self.end[a:b]
            alpha[:, to] = np.logaddexp(alpha[:, to], alpha[:, self.begin[a:b]] + arcs[:, self.piece[a:b]])
        return alpha

    def marginals(self, arcs: np.ndarray) -> np.ndarray:
        """For each row of ``arcs`` and each word the natural log of its probability over all its segmentations."""
        return self.forward(arcs)[:, self.start + self.lengths]

    def expected(self, arcs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of the arcs' pieces in words that occur ``counts`` times, under one row of arcs."""
        alpha = self.forward(arcs[None])[0]
        total = alpha[self.start + self.lengths]
        beta = np.full(len(alpha), -np.inf)
        beta[self.start + self.lengths] = 0
        for a, b in reversed(self.steps):
            begin = self.begin[a:b]
            beta[begin] = np.logaddexp(beta[begin], beta[self.end[a:b]] + arcs[self.piece[a:b]])
        share = np.exp(alpha[self.begin] + arcs[self.piece] + beta[self.end] - total[self.word])
        return np.bincount(self.piece, weights=share * counts[self.word], minlength=len(arcs))


def normalised(weights: np.ndarray) -> np.ndarray:
    top = weights.max()
    return weights - top - math.log(math.fsum(np.exp(weights - top)))


@dataclass
class Model:
    """``rows``: training rows by kind. ``tokens`` and ``types`` by kind, and of all last. ``arcs`` by kind."""

    pieces: Pieces
    arcs: np.ndarray
    rows: list[int]
    tokens: list[int]
    types: list[int]
    p: Parameters = field(default_factory=Parameters)

    def values(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities by the base formula, and by each kind; ``counts`` by kind (rows) and word."""
        spelt = [self.pieces.lattice(words[k : k + _WORDS]).marginals(self.arcs) for k in range(0, len(words), _WORDS)]
        return self._values(np.concatenate([np.zeros((len(self.arcs), 0)), *spelt], axis=1), counts)

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """The same of the end of a text."""
        return self._values(np.full((len(self.arcs), 1), _END), np.array(self.rows, np.float64)[:, None])

    def _values(self, spelt: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, v, d = self.tokens[-1], self.types[-1], self.p.discount
        c = counts.sum(0)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        left = np.array([(d * types + 1) / (tokens + 1) for tokens, types in zip(self.tokens, self.types, strict=True)])
        whole = np.maximum(0, counts - d) / (np.array(self.tokens[:-1])[:, None] + 1) + left[:-1, None] * np.maximum(0, c - d) / (n + 1)
        with np.errstate(divide="ignore"):
            return base, np.logaddexp(np.log(whole), np.log(left[:-1, None] * left[-1]) + spelt) / math.log(10)

    def shares(self) -> np.ndarray:
        """log10 of the share of each kind's rows."""
        rows = np.array(self.rows, np.float64) + 0.5
        return np.log10(rows / rows.sum())


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _hashed(words: list[bytes]) -> np.ndarray:
    return split(pa.array([b" ".join(words)], pa.binary()).cast(pa.string())).hashes if words else np.zeros(0, np.uint64)


def _by_range(words: list[bytes], ranges: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each range that has some of the words, their places and themselves, a line each."""
    of = _range(_hashed(words), ranges)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else []
    for k in np.split(order, cuts[1:]) if len(of) else ():
        yield int(of[k[0]]), k, b"\n".join([words[i] for i in k.tolist()])


def _counts(train: DataFrame, kinds: list[str | None], ranges: int) -> DataFrame:
    """For each range its ``words``, a line each, and ``counts`` by kind and word; tokens and types, by kind and of all; and how many words there are of each size of count."""
    number = {x: k for k, x in enumerate(kinds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lattice")
        counts: list[Counter] = [Counter() for _ in kinds]

        def out(k: int) -> Iterator[pa.RecordBatch]:
            if not counts[k]:
                return
            words, times = list(counts[k]), np.array(list(counts[k].values()), "<i8")
            counts[k].clear()
            for r, at, lines in _by_range(words, ranges):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((r, pa.int32()), (k, pa.int32()), (lines, pa.binary()), (times[at].tobytes(), pa.binary()))], names=["range", "kind", "words", "counts"])

        for batch in batches:
            data, at = buffers(batch.column(0))
            for a, b, kind in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(1).to_pylist(), strict=True):
                k = number[kind]
                counts[k].update(data[a:b].tobytes().translate(_LOWER).split())
            if sum(map(len, counts)) > 150_000:
                for k in range(len(kinds)):
                    yield from out(k)
        for k in range(len(kinds)):
            yield from out(k)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        by: list[dict[bytes, int]] = [{} for _ in kinds]
        for k, lines, times in zip(rows["kind"], rows["words"], rows["counts"], strict=True):
            here = by[k]
            for w, c in zip(lines.split(b"\n"), np.frombuffer(times, "<i8").tolist(), strict=True):
                here[w] = here.get(w, 0) + c
        words = sorted(set().union(*by))
        table = np.array([[x.get(w, 0) for w in words] for x in by], np.int64).reshape(len(kinds), len(words))
        every = np.vstack([table, table.sum(0)])
        sizes = np.bincount(_size(every[-1]), minlength=_SIZES)
        release()
        return pd.DataFrame({"range": rows["range"].iloc[:1], "words": [b"\n".join(words)], "counts": [table.astype("<i8").tobytes()], "tokens": [every.sum(1).tolist()], "types": [(every > 0).sum(1).tolist()], "sizes": [sizes.tolist()]})

    found = train.select("text", "kind").mapInArrow(released(run), "range int, kind int, words binary, counts binary")
    return found.groupBy("range").applyInPandas(merge, "range int, words binary, counts binary, tokens array<long>, types array<long>, sizes array<long>")


#: Sizes of counts are told apart by eighths of powers of two.
_SIZES = 512


def _size(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)) * 8, _SIZES - 1).astype(np.int64)


def _read(words: bytes, counts: bytes, kinds: int) -> tuple[list[str], np.ndarray]:
    found = words.decode().split("\n") if words else []
    return found, np.frombuffer(counts, "<i8").reshape(kinds, len(found))


def _summed(table: DataFrame, column: str, n: int) -> list[int]:
    found = {r["pos"]: r["x"] for r in table.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("x")).collect()}
    return [found.get(k, 0) for k in range(n)]


def _estimate(table: DataFrame, shared, kinds: int, width: int) -> np.ndarray:
    """Expected counts of pieces by kind, over all training words; each counts in the kind where it is most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, arcs = shared.value
        sums = np.zeros(arcs.shape)
        for batch in batches:
            for raw, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words, counts = _read(raw, blob, kinds)
                kind = counts.argmax(0) if words else np.zeros(0, np.int64)
                # how often a word occurs says little of how unseen words are made: each known word counts by the logarithm
                times = np.log2(counts.sum(0) + 1.0)
                for k in range(kinds):
                    of = np.flatnonzero(kind == k)
                    for j in range(0, len(of), _WORDS):
                        some = of[j : j + _WORDS]
                        sums[k] += pieces.lattice([words[i] for i in some.tolist()]).expected(arcs[k], times[some])
        k, x = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(sums[k, x])], names=["kind", "piece", "x"])

    # as many rows as the vocabulary has pieces, for each kind
    found = table.select("words", "counts").mapInArrow(released(run), "kind int, piece int, x double").groupBy("kind", "piece").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((kinds, width))
    out[found["kind"].to_numpy(np.int64), found["piece"].to_numpy(np.int64)] = found["x"]
    return out


def fit(train: DataFrame, vocabulary: str, scratch: Scratch, p: Parameters = Parameters()) -> tuple[Model, DataFrame, int]:
    """The model, its words by range, and the number of ranges; from ``text`` and ``kind`` of ``train``."""
    spark = train.sparkSession
    found = train.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).orderBy(F.col("kind").asc_nulls_first()).collect()
    kinds: list[str | None] = [r["kind"] for r in found] or [None]
    rows = [r["n"] for r in found] or [0]
    ranges = max(1, -(-sum(r["size"] for r in found) // p.range_bytes))
    table = scratch.write(_counts(train, kinds, ranges), "counts")
    tokens, types = (_summed(table, c, len(kinds) + 1) for c in ("tokens", "types"))
    # the ends
    tokens = [x + n for x, n in zip(tokens, [*rows, sum(rows)], strict=True)]
    types = [x + (n > 0) for x, n in zip(types, [*rows, sum(rows)], strict=True)]
    pieces, first = Pieces.load(vocabulary)
    weights = np.tile(first, (len(kinds), 1))
    for _ in range(p.rounds):
        sums = _estimate(table, spark.sparkContext.broadcast((pieces, pieces.arcs(weights))), len(kinds), len(first) + 4)[:, : len(first)]
        every = sums.sum(0)
        # of the prior one half goes by the vocabulary's scores, the other by the pieces of all kinds
        weights = np.stack([normalised(np.log(own + p.prior * (np.exp(first) + every / max(1.0, every.sum())))) for own in sums])
    return Model(pieces, pieces.arcs(weights), rows, tokens, types, p), table, ranges


def _frequent(table: DataFrame, model, kinds: int, p: Parameters) -> dict[str, np.ndarray]:
    """Hashes, base scores and those of each kind of the words of the largest counts, at most ``frequent`` of them."""
    sizes = _summed(table, "sizes", _SIZES)
    least = next((k for k in range(_SIZES) if sum(sizes[k:]) <= p.frequent), _SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words, counts = _read(raw, blob, kinds)
                some = np.flatnonzero(_size(counts.sum(0)) >= least)
                if len(some):
                    words = [words[k] for k in some.tolist()]
                    values = np.vstack(model.value.values(words, counts[:, some]))
                    yield pa.RecordBatch.from_arrays([pa.array([_hashed([w.encode() for w in words]).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["hashes", "values"])

    found = table.select("words", "counts").mapInArrow(released(run), "hashes binary, values binary").toLocalIterator()
    hashes, values = [np.zeros(0, np.uint64)], [np.zeros((kinds + 1, 0))]
    for r in found:
        hashes.append(np.frombuffer(r["hashes"], np.uint64))
        values.append(np.frombuffer(r["values"]).reshape(kinds + 1, -1))
    hashes, values = np.concatenate(hashes), np.concatenate(values, axis=1)
    order = np.argsort(hashes)
    return {"hashes": hashes[order], "values": values[:, order]}


def _repeated(train: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """``hash`` and ``arc``, log10 of the share of lines that the corpus holds more than once; its numbers of lines and of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                w = split(lines(batch.column(0).slice(a, b - a))[0])
                found, n = np.unique(sequences(w)[np.diff(w.first) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    counts = train.select("text").mapInArrow(released(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "lines")
    different, every = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return counts.where("n > 1").select("hash", F.log10((F.col("n") - 1) / F.lit(max(1, every))).alias("arc")), every, different


def _looked_up(docs: DataFrame, keep: list[str], frequent, end: np.ndarray, names: list[str]) -> DataFrame:
    """For each text the columns ``keep`` and its end's values, and a row for each of its lines that holds a word: its hash, what its frequent words add up to, and its other words."""
    texts = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, values = frequent.value["hashes"], frequent.value["values"]
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column(len(keep))
            for a, b in slices(column):
                part, n = [x.slice(a, b - a) for x in batch.columns[: len(keep)]], b - a
                docs = number + np.arange(n)
                number += n
                yield pa.RecordBatch.from_arrays([*part, pa.array(docs), pa.nulls(n, pa.int64()), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int64)), *(pa.array(np.full(n, x)) for x in end), pa.nulls(n, pa.string())], names=columns)
                each, parent = lines(column.slice(a, n))
                w = split(each)
                distinct, of = np.unique(w.hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(hashes, distinct), max(0, len(hashes) - 1))
                known = hashes[at] == distinct if len(hashes) else np.zeros(len(distinct), bool)
                line, held = np.repeat(np.arange(len(each)), np.diff(w.first)), known[of]
                some = np.flatnonzero(np.diff(w.first) > 0)
                sums = [np.bincount(line[held], weights=x[at[of[held]]], minlength=len(each))[some].astype(np.float64) for x in values]
                rest: list[list[bytes]] = [[] for _ in range(len(each))]
                raw, others = w.data.tobytes(), np.flatnonzero(~held)
                for t, x, y in zip(line[others].tolist(), w.starts[others].tolist(), w.ends[others].tolist(), strict=True):
                    rest[t].append(raw[x:y])
                words = pa.array([b" ".join(rest[k]).translate(_LOWER).decode() for k in some.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), x.type) for x in part), pa.array(docs[parent[some]]), pa.array(sequences(w)[some].view(np.int64)), pa.array(np.diff(w.first)[some]), pa.array(np.bincount(line[held], minlength=len(each))[some]), *map(pa.array, sums), words], names=columns)

    columns = [*keep, "_doc", "_line", "n_tokens", "n_known", *names, "_rest"]
    kept = [StructField(f.name, f.dataType, True) for f in texts.schema.fields[:-1]]
    added = [*(StructField(x, LongType()) for x in ("_doc", "_line", "n_tokens", "n_known")), *(StructField(x, DoubleType()) for x in names), StructField("_rest", StringType())]
    return texts.mapInArrow(released(run), StructType([*kept, *added]))


def _asked(rows: DataFrame, ranges: int) -> DataFrame:
    """For each range of words that texts of a batch hold: the batch, these words, a line each, and the rows and words (by place) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [x.encode().split() for x in batch.column(1).to_pylist()]
            place: dict[bytes, int] = {}
            pairs = np.array([k * (1 << 32) + place.setdefault(w, len(place)) for k, x in enumerate(texts) for w in x], np.int64)
            pairs, times = np.unique(pairs, return_counts=True)
            row, word = pairs >> 32, pairs & 0xFFFFFFFF
            where = np.empty(len(place), np.int64)
            for r, at, lines in _by_range(list(place), ranges):
                where[:] = -1
                where[at] = np.arange(len(at))
                here = where[word]
                mine = here >= 0
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in (lines, ids[row[mine]].tobytes(), here[mine].astype("<i4").tobytes(), times[mine].astype("<i4").tobytes())), pa.array(ids[:1])], names=["range", "asked", "rows", "places", "times", "batch"])

    return rows.select("_row", "_rest").where("_rest <> ''").mapInArrow(released(run), "range int, asked binary, rows binary, places binary, times binary, batch long")


def _answered(asked: DataFrame, table: DataFrame, model, kinds: int, names: list[str]) -> DataFrame:
    """For each row what its words of a range add up to."""

    def answer(questions: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        words, counts = _read(known["words"].iloc[0], known["counts"].iloc[0], kinds) if len(known) else ([], np.zeros((kinds, 0), np.int64))
        place = {w: k for k, w in enumerate(words)}
        wanted: dict[str, int] = {}
        asked = [[wanted.setdefault(w, len(wanted)) for w in x.decode().split("\n")] for x in questions["asked"]]
        at = np.array([place.get(w, -1) for w in wanted], np.int64)
        table = np.where(at >= 0, counts[:, at], 0) if len(words) else np.zeros((kinds, len(at)), np.int64)
        base, models = model.value.values(list(wanted), table)
        values = np.vstack([(table.sum(0) > 0).astype(float), base, models])
        out = []
        for mine, batch, rows, places, times in zip(asked, *(questions[c] for c in ("batch", "rows", "places", "times")), strict=True):
            rows, of = np.unique(np.frombuffer(rows, np.int64), return_inverse=True)
            which = np.array(mine, np.int64)[np.frombuffer(places, "<i4")]
            times = np.frombuffer(times, "<i4")
            out.append((batch, rows.tobytes(), b"".join(np.bincount(of, weights=x[which] * times, minlength=len(rows)).tobytes() for x in values)))
        release()
        return pd.DataFrame(out, columns=["batch", "rows", "sums"])

    def add(answers: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.int64) for x in answers["rows"]]
        rows, of = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.concatenate([np.frombuffer(x).reshape(-1, len(k)) for x, k in zip(answers["sums"], parts, strict=True)], axis=1)
        sums = [np.bincount(of, weights=x, minlength=len(rows)) for x in sums]
        return pd.DataFrame({"_row": rows, "_known": sums[0].round().astype(np.int64), **{f"_{c}": x for c, x in zip(names, sums[1:], strict=True)}})

    found = asked.groupBy("range").cogroup(table.select("range", "words", "counts").groupBy("range")).applyInPandas(answer, "batch long, rows binary, sums binary")
    return found.groupBy("batch").applyInPandas(add, "_row long, _known long, " + ", ".join(f"_{c} double" for c in names))


def score(docs: DataFrame, train: DataFrame, vocabulary: str, keep: list[str], kind: str | None = None, p: Parameters = Parameters()) -> DataFrame:
    """The columns ``keep`` of ``docs`` and n_tokens, n_known, train_tokens, base_score, score; learned from ``train`` (both with ``text``).

    ``kind``: a string column of ``train`` that tells its rows' kinds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lattice")
    train = train.select("text", (F.col(kind) if kind else F.lit(None)).cast("string").alias("kind"))
    # as one column no name can clash with those added here
    docs, keep = docs.select(F.struct(*keep).alias("_keep"), "text"), ["_keep"]
    model, table, ranges = fit(train, vocabulary, scratch, p)
    kinds = len(model.rows)
    names = ["base_score", *(f"_m{k}" for k in range(kinds))]
    shared = spark.sparkContext.broadcast(model)
    frequent = spark.sparkContext.broadcast(_frequent(table, shared, kinds, p))
    base, models = model.end()
    # the end is known wherever there is a training text
    found = _looked_up(docs, keep, frequent, np.r_[base, models[:, 0]], names)
    found = found.withColumns({"_row": F.monotonically_increasing_id(), "n_known": F.col("n_known") + F.when(F.col("_line").isNull(), int(sum(model.rows) > 0)).otherwise(0)})
    rows = scratch.write(found, "rows")
    sums = scratch.write(_answered(_asked(rows, ranges), table, shared, kinds, names), "sums")
    scratch.drop("counts")
    repeated, every, different = _repeated(train, scratch)
    more = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    left = F.when(F.col("_line").isNull(), 0.0).otherwise(math.log10(different / every) if every else 0.0)
    each = rows.where("_line is not null").drop(*keep, "_rest").join(sums, "_row", "left").join(repeated, F.col("_line") == F.col("hash"), "left")
    values = {"n_tokens": F.col("n_tokens"), "n_known": more("n_known", "_known"), "base_score": more("base_score", "_base_score")}
    for k in range(kinds):
        words = more(f"_m{k}", f"__m{k}") + left
        top = F.greatest(words, "arc")
        values[f"_m{k}"] = F.coalesce(top + F.log10(F.pow(F.lit(10.0), words - top) + F.pow(F.lit(10.0), F.col("arc") - top)), words)
    totals = each.groupBy("_doc").agg(*(F.sum(x).alias(f"_{c}_") for c, x in values.items()))
    # the first row of each text has its columns and its end
    out = rows.where("_line is null").drop("_rest", "_row", "_line").join(totals, "_doc", "left")
    both = {c: more(c, f"_{c}_") for c in values}
    by_kind = [both[f"_m{k}"] + F.lit(w) for k, w in enumerate(model.shares().tolist())]
    top = F.greatest(*by_kind) if kinds > 1 else by_kind[0]
    total = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in by_kind[1:]), F.pow(F.lit(10.0), by_kind[0] - top)))
    return out.select("_keep.*", both["n_tokens"].alias("n_tokens"), both["n_known"].alias("n_known"), F.lit(model.tokens[-1]).cast("long").alias("train_tokens"), both["base_score"].alias("base_score"), total.alias("score"))
