"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton's arcs carry tokens. It starts as one state with a loop for each symbol; the
merges are then applied in order, each by a gadget: where ``a`` leads to a state that ``b``
leaves, an arc ``ab`` is laid beside the two, and the state after ``a`` loses its arc
``b``. A token's arc thereafter stands wherever its left part's stood and leads where its
right part's led, so later cuts at the parts do not touch it, and it inherits the earlier
ones (Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA", 2024;
Cognetta and Okazaki, "Tokenization as finite-state transduction", 2024).

A state is thus a last token, told apart by which tokens may not follow. Numbering tokens
in pre-order of the trees of right and of left parts, children by descending merge, makes
what one gadget cuts a range of states times a range of tokens; the transition table keeps
for each state its ranges of cut arcs. A word has exactly one path from the start to its
end: its encoding. Decoding joins the labels of the arcs.

Texts are split as the tokenizer's file says: added tokens first, then NFC, white space,
lower case, and words by its pattern; words go to the automaton as byte symbols with a
mark on the last one. Only files of this kind are read; others raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from vellumite.llm.store import kept, released, small_batches
from vellumite.llm.words import Lookup, Words, buffers, hashed, mix, slices, split

#: The pattern by which the tokenizer's file splits words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for text whose characters all lie below U+0250.
_LATIN_LETTERS, _LATIN_NUMBERS, _LATIN_SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_LETTERS}]+|[{_LATIN_NUMBERS}]|[^{_LATIN_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+")
_ANY = regex.compile(WORD_PATTERN.replace(r"\s", r"\p{White_Space}"))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _preorder(part: dict[int, int], rank: dict[int, int], size: int) -> tuple[list[list[int]], list[int], list[int]]:
    """Children by descending merge, and first and past-the-end numbers of each subtree."""
    children: list[list[int]] = [[] for _ in range(size)]
    for t, of in part.items():
        children[of].append(t)
    for x in children:
        x.sort(key=lambda t: -rank[t])
    first, end, n = [0] * size, [0] * size, 0
    todo = [t for t in range(size - 1, -1, -1) if t not in part]
    while todo:
        t = todo.pop()
        if t < 0:
            end[~t] = n
            continue
        first[t] = n
        n += 1
        todo.append(~t)
        todo.extend(reversed(children[t]))
    return children, first, end


class Automaton:
    """The compiled table; ``encode`` takes a word's symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = max(vocab.values()) + 1
        self.suffix = suffix
        self.labels = [""] * size
        for label, t in vocab.items():
            self.labels[t] = label
        rank: dict[int, int] = {}
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        rules: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if t in rank:
                raise ValueError(f"merge {r} makes a token again")
            rank[t], left[t], right[t] = r, vocab[a], vocab[b]
            rules[vocab[a], vocab[b]] = r
        if any(rank.get(x, -1) >= r for t, r in rank.items() for x in (left[t], right[t])):
            raise ValueError("a merge does not build on earlier ones")
        by_right, self.state, state_end = _preorder(right, rank, size)
        by_left, self.number, number_end = _preorder(left, rank, size)
        cuts = np.empty((len(merges), 4), np.int64)
        for r, (a, b) in enumerate(merges):
            a, b = vocab[a], vocab[b]
            # still standing at step r: the part itself and the tokens that took it up later on; of a row of equal symbols the first two merge
            to_state = max([self.state[a] + 1, *(state_end[t] for t in by_right[a] if rank[t] > r)])
            to_number = max([self.number[b] + 1, *(number_end[t] for t in by_left[b] if rank[t] >= r)])
            cuts[r] = self.state[a], to_state, self.number[b], to_number
        lengths = cuts[:, 1] - cuts[:, 0]
        rows = np.repeat(np.arange(len(merges)), lengths)
        states = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + cuts[rows, 0]
        order = np.lexsort((cuts[rows, 2], states))
        states, lows, highs = states[order], cuts[rows, 2][order], cuts[rows, 3][order]
        self.cut_from, self.cut_to = self._merged(states, lows, highs)
        live = {t for t in range(size) if t not in rank}
        for t in sorted(rank, key=rank.get):
            if left[t] in live and right[t] in live and not self._crossed(t, rank, left, right, rules):
                live.add(t)
        self.arcs = {label: t for label, t in vocab.items() if t in live}
        # the longest label, without the suffix, for each beginning of two symbols
        self.reach: dict[str, int] = {}
        for label in self.arcs:
            label = label.removesuffix(suffix)
            self.reach[label[:2]] = max(self.reach.get(label[:2], 1), len(label))

    def _merged(self, states: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Disjoint ranges as one sorted list, each state's in a band of its own."""
        band = len(self.labels) + 1
        lows, highs = states * band + lows, states * band + highs
        reach = np.maximum.accumulate(highs) if len(highs) else highs
        new = np.ones(len(lows), bool)
        new[1:] = lows[1:] > reach[:-1]
        at = np.flatnonzero(new)
        return lows[at], (np.maximum.reduceat(highs, at) if len(at) else highs)

    @staticmethod
    def _crossed(t: int, rank: dict, left: dict, right: dict, rules: dict) -> bool:
        """Whether an earlier gadget cuts the token's own two parts apart, so that its arc is on no path."""
        limit, a, above_a = rank[t], left[t], rank[t]
        while True:
            b, above_b = right[t], rank[t]
            while True:
                r = rules.get((a, b), limit)
                if r < limit and r < above_a and r <= above_b:
                    return True
                if b not in left:
                    break
                b, above_b = left[b], rank[b]
            if a not in right:
                return False
            a, above_a = right[a], rank[a]

    def ready(self) -> Automaton:
        """Prepares single look-ups; for each worker after unpickling."""
        self.known: dict[int, bool] = {}
        return self

    def follows(self, key: int) -> bool:
        """Whether a state has an arc; ``key``: the state times the size of its band, plus the arc's number."""
        k = int(np.searchsorted(self.cut_from, key, side="right")) - 1
        found = k < 0 or int(self.cut_to[k]) <= key
        if len(self.known) >= 50_000:
            self.known.clear()
        self.known[key] = found
        return found

    def encode(self, word: str) -> list[int]:
        """The tokens on the one path that spells the word; longest arcs are tried first."""
        n, arc, suffix, reach, known = len(word), self.arcs.get, self.suffix, self.reach.get, self.known.get
        whole = arc(word + suffix)
        if whole is not None:
            return [whole]
        state, number, band = self.state, self.number, len(self.labels) + 1
        path: list[int] = []
        taken: list[int] = []
        dead: set[tuple[int, int]] = set()
        at = base = 0
        length = reach(word[:2], 1)
        while True:
            if at + length >= n:
                t = arc(word[at:] + suffix)
                length = n - at
            else:
                t = arc(word[at : at + length])
            while True:
                if t is not None:
                    if not path:
                        break
                    key = base + number[t]
                    if (self.follows(key) if (ok := known(key)) is None else ok) and not (dead and (at + length, t) in dead):
                        break
                length -= 1
                if not length:
                    break
                t = arc(word[at : at + length])
            if length:
                path.append(t)
                taken.append(length)
                at += length
                if at == n:
                    return path
                base = state[t] * band
                length = reach(word[at : at + 2], 1)
            while not length:  # no arc from here leads on: back to the last one that has a shorter rival
                if not path:
                    raise ValueError("a symbol has no arc")
                dead.add((at, path.pop()))
                length = taken.pop()
                at -= length
                length -= 1
                base = state[path[-1]] * band if path else 0


class Table:
    """The automaton's arcs by hashes of their labels' bytes, to follow many words at once.

    Every beginning of a word is spelt by exactly one path too, so at each place of a word one arc ends: the longest one that starts where
    the state reached there has it. Words of one length are followed together.
    """

    def __init__(self, automaton: Automaton) -> None:
        size = len(automaton.labels)
        self.state, self.number = (np.array(x, np.int64) for x in (automaton.state, automaton.number))
        self.cut_from, self.cut_to = (np.array(x, np.int64) for x in (automaton.cut_from, automaton.cut_to))
        self.band = size + 1
        of = {c: b for b, c in enumerate(byte_symbols())}
        self.known = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)
        # of arcs within a word, and of those at its end
        self.tables = []
        for last in (False, True):
            held = [(bytes(of[c] for c in (x.removesuffix(automaton.suffix) if last else x)), t) for x, t in automaton.arcs.items() if x.endswith(automaton.suffix) == last]
            found = Lookup(np.array([self.hash(x) for x, _ in held], np.uint64), np.array([t for _, t in held], np.int64))
            self.tables.append((found, max((len(x) for x, _ in held), default=0)))

    @staticmethod
    def hash(label: bytes) -> int:
        return int(mix(np.array([sum((b + 1) * pow(_POWER, k, 1 << 64) for k, b in enumerate(label)) % (1 << 64)], np.uint64))[0])

    def follows(self, keys: np.ndarray) -> np.ndarray:
        """Whether states have arcs; recent answers are kept by a hash of the key."""
        held, found = self.known
        at = (keys * 0x9E3779B1 >> 7) & (len(held) - 1)
        out = found[at]
        new = np.flatnonzero(held[at] != keys)
        if len(new):
            some = keys[new]
            k = np.searchsorted(self.cut_from, some, side="right") - 1
            answer = (k < 0) | (self.cut_to[np.maximum(k, 0)] <= some)
            out[new] = answer
            held[at[new]], found[at[new]] = some, answer
            # of keys that meet in one place one stays, with its own answer
            found[at[new]] = np.where(held[at[new]] == some, answer, found[at[new]])
            clash = new[held[at[new]] != some]
            held[at[clash]] = -1
        return out

    def encode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length, as rows of bytes: the token that ends at each place, or -1 where the path has none; and its length."""
        n, length = words.shape
        sums = np.zeros((length + 1, n), np.uint64)
        np.cumsum((words.T.astype(np.uint64) + np.uint64(1)) * _UP[:length, None], axis=0, out=sums[1:])
        last, size = np.full((length + 1, n), -1, np.int64), np.zeros((length + 1, n), np.int64)
        for b in range(1, length + 1):
            found, longest = self.tables[b == length]
            left = np.arange(n)
            for a in range(max(0, b - longest), b):
                if not len(left):
                    break
                some, t = found.get(mix((sums[b, left] - sums[a, left]) * _DOWN[a]))
                if a:
                    before = last[a, left[some]]
                    ok = before >= 0
                    some, t, before = some[ok], t[ok], before[ok]
                    ok = self.follows(self.state[before] * self.band + self.number[t])
                    some, t = some[ok], t[ok]
                last[b, left[some]], size[b, left[some]] = t, b - a
                left = np.delete(left, some)
        return last, size


#: Words of up to this many bytes are followed together.
_TOGETHER = 40
_POWER = 0x2545F4914F6CDD1D
_UP = np.array([pow(_POWER, k, 1 << 64) for k in range(_TOGETHER + 1)], np.uint64)
_DOWN = np.array([pow(pow(_POWER, -1, 1 << 64), k, 1 << 64) for k in range(_TOGETHER + 1)], np.uint64)


class Tokenizer:
    """Splits texts and looks words up; holds what it needs of the tokenizer's file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": WORD_PATTERN} and spec.get("decoder") is None
        if not known or model["type"] != "BPE" or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} is not a tokenizer of the kind read here")
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.symbols = byte_symbols()

    def word(self, word: str) -> list[int]:
        symbols = self.symbols
        return self.automaton.encode("".join([symbols[b] for b in word.encode()]))

    def ready(self) -> Tokenizer:
        """Prepares look-ups; for each worker after unpickling."""
        self.table = Table(self.automaton)
        self.automaton.ready()
        return self

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and how many each word has."""
        counts = np.zeros(len(words), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray, int]] = []  # words, a token of each, its place from the word's end
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], np.arange(1, _TOGETHER + 2))
        for length in range(1, _TOGETHER + 1):
            ids = order[cuts[length - 1] : cuts[length]]
            if not len(ids):
                continue
            last, size = self.table.encode(np.frombuffer(b"".join([words[k] for k in ids.tolist()]), np.uint8).reshape(len(ids), length))
            if (last[length] < 0).any():
                raise ValueError("a symbol has no arc")
            # back from the end, all words at a time
            at, rows, k = np.full(len(ids), length), np.arange(len(ids)), 0
            while len(rows):
                steps.append((ids[rows], last[at, rows], k))
                counts[ids[rows]] += 1
                at = at - size[at, rows]
                rows, at, k = rows[at > 0], at[at > 0], k + 1
        for w in order[cuts[_TOGETHER] :].tolist():
            found = self.word(words[w].decode())
            counts[w] = len(found)
            steps += [(np.array([w]), np.array([t]), len(found) - 1 - k) for k, t in enumerate(found)]
        ends = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), np.uint32)
        for of, tokens, k in steps:
            flat[ends[of] - 1 - k] = tokens
        return flat, counts

    def label(self, token: int) -> str:
        """What an arc emits in decoding."""
        if token < len(self.automaton.labels) and self.automaton.labels[token]:
            return self.automaton.labels[token]
        return next(x for x, t in self.added.items() if t == token)

    def all_labels(self) -> list[bytes]:
        """What every id is decoded to."""
        labels = [x.encode() for x in self.automaton.labels]
        labels += [b""] * (max(self.added.values(), default=0) + 1 - len(labels))
        for x, t in self.added.items():
            labels[t] = labels[t] or x.encode()
        return labels

    def words(self, text: str, latin: bool) -> list[str | int]:
        """The words of a text; an added token stands as its id. ``latin``: no character from U+0250 on."""
        if "<|" in text and any(x in text for x in self.added):
            out: list[str | int] = []
            for part in re.split(f"({'|'.join(map(re.escape, self.added))})", text):
                out += [self.added[part]] if part in self.added else self.words(part, latin)
            return out
        if latin:
            return _LATIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return _ANY.findall("".join([c.lower() for c in text]) if "Σ" in text else text.lower())


#: Kinds of bytes: white space, letters (and all beyond ASCII), digits, others.
_KIND = np.array([0 if b in (*range(9, 14), 32) else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_LOW = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def units(column: pa.Array) -> Words:
    """The words of (a slice of) a string column as the pattern parts them.

    That holds for letters below U+0240; what white space parts from the rest and holds other characters beyond ASCII is one unit.
    """
    data, offsets = buffers(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    if not n:
        return split(column)
    kind = _KIND[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new |= cut[:-1]
    start = new & (kind > 0)
    # 's and the like: an apostrophe takes the letters after it along if it begins a word
    for a in np.flatnonzero(start[:-1] & (data[:-1] == 39) & (kind[1:] == 1) & ~cut[1:-1]).tolist():
        tail = bytes(_LOW[data[a + 1 : a + 3]])
        size = 2 if tail[:1] in (b"s", b"t", b"m", b"d") else 3 if tail in (b"re", b"ve", b"ll") and not cut[a + 2] else 0
        if size:
            start[a + 1] = False
            if a + size < n and kind[a + size] == 1:
                start[a + size] = True
    # the leading bytes of U+00C0 to U+023F are C3 to C8; the multiplication and division signs are no letters, and a dotted capital I has two when lowered
    odd = (data >= 0xC9) | (data == 0xC2)
    after = np.append(data[1:], 0)
    odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data == 0xC4) & (after == 0xB0)
    if odd.any():
        head = (kind > 0) & np.append(True, kind[:-1] == 0) | (kind > 0) & cut[:-1]
        chunk = np.cumsum(head) - 1
        whole = np.zeros(int(chunk[-1]) + 2, bool)
        whole[chunk[odd]] = True
        start = np.where(whole[chunk], head, start)
    ends = np.flatnonzero((kind > 0) & (np.append(start[1:], True) | np.append(kind[1:] == 0, True) | cut[1:])) + 1
    return hashed(data, np.flatnonzero(start), ends, offsets)


class UnitStore:
    """The tokens of units by their hashes; filled on first use, and beyond ``most`` units anew.

    No token crosses a unit's end, and A-Z are lower-cased as in the hashes, so a unit's tokens do not depend on where it stands.
    """

    def __init__(self, tokenizer: Tokenizer, most: int = 1_000_000) -> None:
        self.tokenizer, self.most = tokenizer, most
        self.clear()

    def clear(self) -> None:
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.main, self.recent = nothing, nothing
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The rows of ``hashes``; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for known, rows in (self.main, self.recent):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                held = known[at] == hashes
                out[held] = rows[at[held]]
        return out

    def add(self, new: dict[int, bytes]) -> None:
        """Rows for units by their hashes."""
        words: list[bytes] = []
        owner: list[int] = []
        fixed: list[tuple[int, int]] = []  # an added token's unit and id
        for k, raw in enumerate(new.values()):
            if raw.isascii():
                words.append(raw.lower())
                owner.append(k)
            elif max(raw) < 0xC9 and 0xC2 not in raw and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw and b"\xc4\xb0" not in raw:
                words.append(raw.decode().lower().encode())
                owner.append(k)
            else:
                for w in self.tokenizer.words(raw.decode(), False):
                    words.append(w.encode() if isinstance(w, str) else b"")
                    owner.append(k)
                    if isinstance(w, int):
                        fixed.append((len(words) - 1, w))
        flat, counts = self.tokenizer.encode_words(words)
        if fixed:
            at = np.cumsum(counts)[[k for k, _ in fixed]]
            flat = np.insert(flat, at, [t for _, t in fixed])
            counts[[k for k, _ in fixed]] = 1
        sizes = np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(new)).astype(np.int64)
        rows = (len(self.size) + np.arange(len(new))).astype(np.int32)
        self.begin = np.r_[self.begin, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)]
        self.size = np.r_[self.size, sizes.astype(np.int32)]
        self.flat = np.r_[self.flat, flat]
        hashes = np.fromiter(new.keys(), np.uint64, len(new))
        self.recent = self._merged(self.recent, (hashes, rows))
        if len(self.recent[0]) > 200_000:
            self.main, self.recent = self._merged(self.main, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        hashes, rows = np.r_[a[0], b[0]], np.r_[a[1], b[1]]
        order = np.argsort(hashes, kind="stable")
        return hashes[order], rows[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one longer)."""
        if len(self.size) > self.most or len(self.flat) > 8 * self.most:
            self.clear()
        parts, new, marked = [], {}, []
        for a, b in slices(column):
            words = units(column.slice(a, b - a))
            hashes, first, of = np.unique(words.hashes, return_index=True, return_inverse=True)
            missing = first[self.find(hashes) < 0]
            whole = words.data.tobytes()
            for h, x, y in zip(words.hashes[missing].tolist(), words.starts[missing].tolist(), words.ends[missing].tolist(), strict=True):
                if h not in new:
                    new[h] = whole[x:y]
            parts.append((words.first, hashes, of.astype(np.int32)))
            if b"<|" in whole:  # an added token may stand in a text, in which case matters
                marked += [k for k in range(a, b) if "<|" in (column[k].as_py() or "")]
        if new:
            self.add(new)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for firsts, hashes, of in parts:
            rows = self.find(hashes)[of]
            size = self.size[rows].astype(np.int64)
            ends = np.append(0, np.cumsum(size))
            ids.append(self.flat[np.repeat(self.begin[rows] - ends[:-1], size) + np.arange(ends[-1])])
            sizes.append(np.diff(ends[firsts]))
        ids, at = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes)))
        if not marked:
            return ids, at
        texts = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k in marked:
            words = self.tokenizer.words(column[k].as_py(), False)
            texts[k] = np.array([t for w in words for t in ([w] if isinstance(w, int) else self.tokenizer.word(w))], np.uint32)
        return np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts]))


def store(shared) -> UnitStore:
    """This worker's store for a broadcast tokenizer."""
    key, stores = str(getattr(shared, "_path", id(shared))), kept("bpe")
    if key not in stores:
        stores.clear()
        stores[key] = UnitStore(shared.value.ready())
    return stores[key]


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of one takes little memory."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty; an empty one has no token, and digests of the empty string. Repeated rows and very long texts are
    encoded each and whole, an empty table gives an empty one, and other columns play no part.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer_path))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of = store(shared)
        labels = units_of.tokenizer.all_labels()
        numbers = [str(t).encode() for t in range(len(labels))]
        for batch in small(batches):
            found, at = units_of.encode(batch.column(1))
            ids, decoded = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                tokens = found[a:b].tolist()
                ids.append(hashlib.sha256(b" ".join(map(numbers.__getitem__, tokens))).hexdigest())
                decoded.append(hashlib.sha256(b" ".join(map(labels.__getitem__, tokens))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(released(run), StructType([rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str], end: int | None = None) -> DataFrame:
    """The columns ``keep`` and ``ids``, little-endian unsigned 32-bit token ids, followed by the id ``end`` if given. Cases as in ``digest``; ``keep`` may hold any name but ``ids``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer_path))
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of = store(shared)
        for batch in small(batches):
            ids, at = units_of.encode(batch.column(len(keep)))
            if end is not None:
                ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
            column = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column], names=[*keep, "ids"])

    return rows.mapInArrow(released(run), StructType([*rows.schema.fields[:-1], StructField("ids", BinaryType())]))


def decode(tokens: DataFrame, tokenizer_path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``text``: the labels of the arcs of ``ids``, joined as the tokenizer's file says, by single spaces."""
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer_path))
    rows = tokens.select(*keep, F.col("ids").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            texts = [None if x is None else " ".join(map(tokenizer.label, np.frombuffer(x, "<u4").tolist())) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(released(run), StructType([*rows.schema.fields[:-1], StructField("text", StringType())]))
