"""Phrases that hold together, from count streams in prefix and in suffix order.

Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends, and the pieces into words at
blanks and tabs.  Phrases of 1 to LONGEST words are counted within pieces, per language (null: und), one
length after the other: a phrase is only counted where both phrases of one word less are frequent.  Which
these are is told to the tasks by a filter of FILTER_BITS bits, whatever the number of phrases; it may let
rare phrases pass, which are dropped once counted, but never holds back a frequent one.  Tasks send their
counts as sorted streams.

The frequent phrases are then laid out twice: in order of their words, where every phrase directly follows its
own beginnings, and in order of their words from the last to the first, where it follows its own endings.
One walk along each order, in ranges, carries the count of the last phrase of each length on; these are the
counts of the phrase's beginnings and endings.  The same walks find the phrases that a longer one absorbs:
the phrase one word shorter with the same count.  They leave by a merge join in prefix order.

The score of a cut is floor(1000 a n / (l r)), in decimals of 38 digits; the cut with the least score counts.
Null texts are empty; texts count whole, repeated rows again; very long words are words.  Columns other than
text and lang are not read, so their names cannot clash.  Without candidates, or rows, there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.streams import SCHEMA, Counter, buckets_for, merged
from tessera.llm.tables import drop, store
from tessera.llm.text import U64, Words, byte_class, grams, mix, runs, slices, split, text_bytes
from tessera.operators.ordinals import carry_all

LONGEST = 5
FEWEST = 100
FIRST = 2000
FILTER_BITS = 1 << 26
#: A phrase sets so many bits of the filter.
PLACES = 2
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 1 << 20

_ENDS = byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
_BLANK = byte_class((0x20, 0x20), (0x09, 0x09))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _bits(kind: str, phrases: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter of phrases of a language, a row for each hash."""
    salt = int.from_bytes(kind.encode()[:8].ljust(8, b"\1"), "little") ^ len(kind)
    hashed = mix(phrases + U64(salt))
    return np.stack([mix(hashed + U64(k)) % U64(bits) for k in range(PLACES)]).astype(np.int64)


class Chunk:
    """Words of some texts of one language, with the words from which k words of a piece follow."""

    def __init__(self, texts: pa.Array):
        buf, offsets = text_bytes(texts)
        buf = _LOWER[buf]
        end = _ENDS[buf]
        inside = ~(end | _BLANK[buf])
        self.words = runs(buf, offsets, inside)
        ended = np.concatenate(([0], np.cumsum(end)))[self.words.starts]
        at = np.arange(len(ended))
        broken = np.ones(len(ended), bool)
        broken[1:] = ended[1:] != ended[:-1]
        broken[self.words.first[:-1][self.words.first[:-1] < len(ended)]] = True
        piece = np.cumsum(broken)
        self.left = np.searchsorted(piece, piece, "right") - at
        size = self.words.ends - self.words.starts
        held = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(buf[inside])])
        coded = held.dictionary_encode()
        self.known, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def phrases(self, k: int, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of k words from these words on, and their counts."""
        code = self.ids[starts]
        for j in range(1, k):  # numbers stay below distinct beginnings times distinct words
            _, code = np.unique(code, return_inverse=True)
            code = code * len(self.known) + self.ids[starts + j]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        parts = [self.known.take(pa.array(self.ids[starts[first] + j])) for j in range(k)]
        return (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))), counts


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts by language, some CHUNK_BYTES at a time; languages with few texts wait for the end."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = part.column("text").filter(pc.equal(langs.indices, i))
                held.setdefault(lang, []).append(texts)
                size[lang] = size.get(lang, 0) + texts.nbytes
            if sum(size.values()) >= 2 * CHUNK_BYTES or max(size.values(), default=0) >= CHUNK_BYTES:
                lang = max(size, key=size.get)
                size.pop(lang)
                yield lang, pa.concat_arrays(held.pop(lang))
    for lang, texts in held.items():
        yield lang, pa.concat_arrays(texts)


def _count(docs: DataFrame, k: int, shared) -> DataFrame:
    """(kind, key, n): phrases of k words by language that may be frequent; the phrase without words counts all words."""
    buckets = buckets_for(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(buckets)
        for lang, texts in _chunks(batches):
            chunk = Chunk(texts)
            if k == 1:
                starts = np.arange(len(chunk.ids))
                yield from counter.add(lang, pa.array([""], pa.large_string()), np.array([len(starts)]))
            else:
                begun = grams(chunk.words.hashes(), k - 1) if len(chunk.ids) >= k - 1 else np.zeros(0, U64)
                at = _bits(lang, begun, 8 * len(shared.value))
                good = (shared.value[at >> 3] << (at & 7).astype(np.uint8) >= 128).all(0)
                starts = np.flatnonzero(good[:-1] & good[1:] & (chunk.left[: max(len(good) - 1, 0)] >= k))
            if len(starts):
                yield from counter.add(lang, *chunk.phrases(k, starts))
        yield from counter.flush()

    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return merged(rows.mapInArrow(count, SCHEMA))


def _filter(phrases: DataFrame, k: int):
    """The filter of frequent phrases of k words: a number of bits that does not grow with them."""
    size = FILTER_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in pc.unique(batch.column("kind")).to_pylist():
                words = split(batch.column("key").filter(pc.equal(batch.column("kind"), kind)), ~byte_class((0x20, 0x20)))
                bits = _bits(kind, grams(words.hashes(), k)[words.first[:-1]], size).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(bits)], ["bit"])

    bits = phrases.select("kind", "key").mapInArrow(places, "bit long")
    bytes_ = bits.groupBy((F.col("bit") / 8).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftright(128, CAST(bit % 8 AS INT))")).alias("bits"))
    found = bytes_.toArrow()  # a row per byte at most
    out = np.zeros(size // 8, np.uint8)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, fewest: int = FEWEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, words, n) of all frequent phrases, the one without words included, and the tables it is read from."""
    tables, shared = [], None
    for k in range(1, longest + 1):
        found = store(_count(docs, k, shared).filter(F.col("n") >= fewest), "phrases")
        if shared:
            shared.unpersist()
        tables.append(found)
        if k < longest:
            shared = _filter(found.filter("key <> ''"), k)
    every = reduce(DataFrame.unionByName, tables)
    words = F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.split("key", " "))
    return every.select(F.col("kind").alias("lang"), words.alias("words"), "n"), tables


def collocations(docs: DataFrame, longest: int = LONGEST, fewest: int = FEWEST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first phrases of each language."""
    phrases, tables = frequent_phrases(docs, longest, fewest)
    size = F.size("words")
    counts = {k: F.when(size == k, F.col("n")) for k in range(longest)}
    fronts = carry_all(phrases, ["lang", "words"], {f"front{k}": c for k, c in counts.items()})
    backs = carry_all(fronts, ["lang", F.reverse("words")], {f"back{k}": c for k, c in counts.items() if k})
    told = store(backs, "told")
    cuts = [F.when(size > k, F.struct(_score(k, longest).alias("score"), F.lit(k).alias("cut"), F.col(f"front{k}").alias("l"), _ending(k, longest).alias("r"))) for k in range(1, longest)]
    scored = told.filter(size > 1).withColumn("best", F.array_min(F.array_compact(F.array(*cuts))))

    shorter = told.filter(size > 2)
    same_front = reduce(lambda c, k: c | ((size == k + 1) & (F.col("n") == F.col(f"front{k}"))), range(2, longest), F.lit(False))
    same_back = reduce(lambda c, k: c | ((size == k + 1) & (F.col("n") == F.col(f"back{k}"))), range(2, longest), F.lit(False))
    absorbed = shorter.filter(same_front).select("lang", F.expr("slice(words, 1, size(words) - 1)").alias("words")).unionByName(shorter.filter(same_back).select("lang", F.expr("slice(words, 2, size(words) - 1)").alias("words")))
    left = scored.join(absorbed.hint("merge"), ["lang", "words"], "left_anti")

    rows = left.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("n").alias("a"), "best.l", "best.r", F.col("front0").alias("n"), "best.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = store(rows.withColumn("rank", place).filter(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    for table in (told, *tables):
        drop(table)
    return out


def _ending(k: int, longest: int):
    """The count of what follows the first k words."""
    return F.coalesce(*(F.when(F.size("words") - k == m, F.col(f"back{m}")) for m in range(1, longest)))


def _score(k: int, longest: int):
    """floor(1000 a n / (l r)) of the cut after k words; a long holds it, as a is at most l and r."""
    a, n, front = (F.col(c).cast("decimal(19,0)") for c in ("n", "front0", f"front{k}"))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), front * _ending(k, longest).cast("decimal(19,0)"))
