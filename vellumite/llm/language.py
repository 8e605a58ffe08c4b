"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a sample of labelled texts. A
text is compressed in blocks with every dictionary; the language with the smallest total
wins. Texts are reduced to lower-cased letters, with their marks, and single spaces first. A
dictionary lists the words of its sample by how often they occur, the most frequent
last, where matches are cheapest; whole texts are counted, on the executors. A narrow margin
between the two smallest rejects the text (``accepted`` is false) without changing the
prediction.

Defined cases: a null text, an empty one and one without a letter (of Unicode's category L)
get ``und``, score 0, not accepted. Ties go to the alphabetically first language, not
accepted. Repeated rows are predicted alike, and each counts in learning. Very long texts are compressed
whole, in blocks. An empty table gives an empty one. With no labelled row at all every text
gets ``und``. Rows are labelled where ``lang`` is not null; every such label is learned.
Columns to keep may have any names but those of the new ones, and ``_text``.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumite.llm.store import kept, released, small_batches
from vellumite.llm.words import buffers

UNDETERMINED = "und"
#: The same as _others() for texts whose characters all lie below the combining marks.
_BELOW_MARKS = re.compile(r"[\W\d_²³¹¼½¾]+")


@cache
def _others() -> re.Pattern:
    """Runs of what is neither a letter nor a mark."""
    parts, first, last = [], None, None
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            if last != c - 1:
                parts.append([c, c])
            parts[-1][1] = last = c
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]+")


def normalise(text: str) -> str:
    """The words of letters of a text, lower-cased, parted by single spaces; empty without a letter."""
    text = text.lower()
    out = (_BELOW_MARKS if max(text, default="") < "\u0300" else _others()).sub(" ", text).strip()
    return out if any(map(str.isalpha, out)) else ""


def dictionary(counts: Mapping[str, int], size: int) -> bytes:
    """The last ``size`` bytes of words in ascending order of how often they occur, ties in alphabetical order."""
    words = sorted(counts, key=lambda w: (counts[w], w))
    return f" {' '.join(words)} ".encode()[-size:]


@dataclass(frozen=True)
class Parameters:
    """sample_texts: expected texts that a dictionary is made of, by a hash of doc_id. dictionary_bytes: of each dictionary, and all_bytes of all, which many languages share.

    block_bytes: texts are compressed in whole blocks of this size. least_margin: of the second smallest size over the smallest, below which a
    text of any size is rejected, and least_bytes: the same in bytes, as sizes of short texts are coarse. With one language the second is the size without a dictionary.
    """

    sample_texts: int = 400
    dictionary_bytes: int = 32 << 10
    all_bytes: int = 16 << 20
    block_bytes: int = 16384
    level: int = 6
    least_match: int = 3
    least_margin: float = 0.02
    least_bytes: int = 2
    sharpness: float = 40.0


def learn(labelled: DataFrame, p: Parameters = Parameters()) -> dict[str, bytes]:
    """Dictionaries of all languages from ``doc_id``, ``text``, ``lang``."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null and text <> ''")
    # a row for each language, as there will be dictionaries
    rates = [(r["lang"], p.sample_texts / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not rates:
        return {}
    size = min(p.dictionary_bytes, p.all_bytes // len(rates))
    rates = F.broadcast(labelled.sparkSession.createDataFrame(rates, "lang string, rate double"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.select("doc_id", "lang", "text").join(rates, "lang").where(share < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(normalise(text).split())
        for lang, x in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x.keys(), pa.string()), pa.array(x.values(), pa.int64())], names=["lang", "word", "n"])

    words = sample.mapInArrow(released(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # words have a byte and a space at least, so no more of them can stand in a dictionary
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("word")))
    found: dict[str, dict[str, int]] = {}
    for r in words.withColumn("place", place).where(F.col("place") <= size // 2).drop("place").toLocalIterator():
        found.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return {lang: dictionary(found[lang], size) for lang in sorted(found)}


class Classifier:
    """Compressors for all languages, made once for each Python worker."""

    def __init__(self, dictionaries: dict[str, bytes], p: Parameters) -> None:
        self.p, self.langs, self.compressors = p, sorted(dictionaries), []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(p.level, dict_size=len(dictionaries[lang]), source_size=p.block_bytes, min_match=p.least_match, write_checksum=0, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, raw: bytes) -> list[int]:
        n, step = len(raw), self.p.block_bytes
        blocks = [raw[k : k + step] for k in range(0, n, step)]
        return [sum(len(c.compress(x)) for x in blocks) for c in self.compressors]

    def size_without(self, raw: bytes) -> int:
        """The size by no language's dictionary."""
        step = self.p.block_bytes
        how = zstandard.ZstdCompressionParameters.from_level(self.p.level, source_size=step, min_match=self.p.least_match, write_checksum=0, write_content_size=0, write_dict_id=0)
        c = zstandard.ZstdCompressor(compression_params=how)
        return sum(len(c.compress(raw[k : k + step])) for k in range(0, len(raw), step))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score, accepted."""
        raw = normalise(text).encode()
        if not self.langs or not raw:
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(raw)
        best = min(sizes)
        score = 1.0 / sum(math.exp(-self.p.sharpness * (x - best) / best) for x in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else self.size_without(raw)
        return self.langs[sizes.index(best)], score, second - best >= max(self.p.least_bytes, self.p.least_margin * best)


def _classifier(dictionaries: dict[str, bytes], p: Parameters) -> Classifier:
    key = (p, tuple(sorted((k, hash(v)) for k, v in dictionaries.items())))
    made = kept("language")
    if key not in made:
        made.clear()
        made[key] = Classifier(dictionaries, p)
    return made[key]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], p: Parameters = Parameters()) -> DataFrame:
    """The columns ``keep`` of ``docs`` (which must not clash with the new ones) and ``lang_pred``, ``score``, ``accepted``.

    Only ``text`` is an input of a prediction. The dictionaries have a size bounded by the parameters.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    fields = [*rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _classifier(shared.value, p)
        for batch in batches:
            data, at = buffers(batch.column(len(fields)))
            at = at.tolist()
            found = [c.predict(data[a:b].tobytes().decode()) for a, b in zip(at[:-1], at[1:], strict=True)]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *new], names=[*[f.name for f in fields], "lang_pred", "score", "accepted"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    return rows.mapInArrow(released(run), schema)
