"""Spelling variants of words, by a bit-sliced position index.

A word is a run of letters (A to Z in either case and U+00C0 to U+00FF) whose A to Z are lower-cased.  To
give the corpus misspellings that are known, a run loses one letter where a hash of doc_id and run is
divisible by SLIPS.  Words have at least LETTERS letters and FEWEST occurrences.

Words within one inserted, deleted or replaced letter of each other share at least half of their letters at
the front or at the back, so the vocabulary is dealt into nodes by front and back halves; a node with more
than NODE words is dealt again by halves of what its words do not share yet, until it is small or
one letter is left.  A pair counts in one node only: behind a deal by backs, pairs with the same front are left out.

In a node, the words in order of their counts are the places of bitsets, one bitset per (position, letter).
For each word, a recurrence over its letters keeps four sets at once: words that agree so far, and those with
one letter replaced, one more or one less, which look at the positions as they are, shifted right or left.
The size of the resulting set is the word's number of near words; its lowest bit is the most frequent one.
No pair becomes a row: a node gives a row per word.

A word's form is its near word with the largest count, if that is at least TIMES its own; roots follow forms
to the end, found by doubling the steps.  Null texts have no runs; a null doc_id counts as an empty one; very
long runs are words like others.  Rows that repeat count again.  Columns other than doc_id and text
are not read, so their names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.streams import SCHEMA, Counter, buckets_for, merged
from tessera.llm.tables import drop, store
from tessera.llm.text import byte_class, runs, slices, text_bytes, whole_groups

SLIPS = 97
LETTERS = 5
FEWEST = 3
TIMES = 2
#: Words that a node may have; where the words differ in one letter's place only, it may have more.
NODE = 2048
#: No front is left out.
NO_BAR = (1 << 31) - 1
#: Runs of more bytes get their hashes one by one.
LONG = 48

_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of byte spans, each going on from the crc32 of what is before it."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    for j in range(int(min(left[0], LONG)) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # spans with more than j bytes
        state[:n] = _CRC[(state[:n] ^ buf[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def words_of(ids: list[int | None], texts: pa.Array) -> tuple[pa.Array, list[str]]:
    """The words of the texts that kept all letters, and those that lost one; short ones are left out."""
    buf, offsets = text_bytes(texts)
    buf = _LOWER[buf]
    lead = buf == _LEAD
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    found = runs(buf, offsets, inside)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    pairs = np.concatenate(([0], np.cumsum(lead)))
    letters = found.ends - found.starts - (pairs[found.ends] - pairs[found.starts])
    long = letters >= LETTERS
    starts, ends, letters = found.starts[long], found.ends[long], letters[long]
    hashed = crcs(buf, starts, ends, before[found.doc[long]])
    slipped = hashed % SLIPS == 0
    changed = []
    for i in np.flatnonzero(slipped & (letters > LETTERS)).tolist():
        run = buf[starts[i] : ends[i]].tobytes().decode()
        k = int(hashed[i]) % len(run)
        changed.append(run[:k] + run[k + 1 :])
    keep = ~slipped
    marks = np.zeros(len(buf) + 1, np.int8)
    marks[starts[keep]] += 1
    marks[ends[keep]] -= 1
    data = buf[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    ends_at = np.concatenate(([0], np.cumsum(ends[keep] - starts[keep])))
    whole = pa.Array.from_buffers(pa.large_string(), int(keep.sum()), [None, pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(data)])
    return whole, changed


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    buckets = buckets_for(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                for words in words_of(part.column("doc_id").to_pylist(), part.column("text")):
                    values = pa.array(words, pa.large_string()) if isinstance(words, list) else words
                    coded = values.dictionary_encode()
                    yield from counter.add("", coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        yield from counter.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)
    return merged(rows).filter(F.col("n") >= FEWEST).select(F.col("key").alias("word"), "n")


def near_words(words: list[str], counts: list[int], m: int, front: int, bar: int) -> Iterator[tuple[int, int, int]]:
    """(place, number of near words, place of the most frequent one) of the words of a node that have any.

    The words have m letters, or m + 1, and share the first `front`; two with m + 1 letters are not
    compared here, nor are words that share the first `bar`.
    """
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    at: list[dict[str, int]] = [{} for _ in range(m + 2)]
    sized = {m: 0, m + 1: 0}
    for place, i in enumerate(order):
        bit = 1 << place
        sized[len(words[i])] |= bit
        for position in range(max(front - 1, 0), len(words[i])):
            letters = at[position]
            letters[words[i][position]] = letters.get(words[i][position], 0) | bit
    every = (1 << len(words)) - 1
    for i in order:
        word = words[i]
        same, replaced, more, less, barred = every, 0, 0, 0, 0
        for k in range(front, len(word)):
            letter = word[k]
            here = at[k].get(letter, 0)
            more = (more | same) & at[k + 1].get(letter, 0)
            less = (less & at[k - 1].get(letter, 0) if k else 0) | same
            replaced = (replaced & here) | (same & ~here)
            same &= here
            if k + 1 == bar:
                barred = same
        near = (replaced & sized[m]) | ((more | same) & sized[m + 1]) if len(word) == m else less & sized[m]
        near &= ~barred
        if near:
            yield i, near.bit_count(), order[(near & -near).bit_length() - 1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "node"):
        rows: dict[tuple, tuple[list[str], list[int]]] = {}
        for word, n, m, front, back, bar in zip(*(table.column(c).to_pylist() for c in ("word", "n", "m", "front", "back", "bar")), strict=True):
            # What names a node, so that nodes of equal hash stay apart.
            words, counts = rows.setdefault((m, front, back, bar, word[:front], word[len(word) - back :]), ([], []))
            words.append(word)
            counts.append(n)
        found = [(words[i], near, words[best], counts[best]) for (m, front, _, bar, _, _), (words, counts) in rows.items() if len(words) > 1 for i, near, best in near_words(words, counts, m, front, bar)]
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["word", "n_near", "best", "best_n"])


def _named(entries: DataFrame) -> DataFrame:
    """Entries (word, n, m, front, back, bar) with their node."""
    return entries.withColumn("node", F.xxhash64("m", "front", "back", "bar", F.expr("substring(word, 1, front)"), F.expr("right(word, back)")))


def _dealt(entries: DataFrame) -> DataFrame:
    """Each entry by the front and by the back half of what its node does not share."""
    half = F.expr("CAST((m - front - back) div 2 AS INT)")
    shares = F.array(
        F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("bar").alias("bar")),
        F.struct(F.col("front").alias("front"), (F.col("back") + half).alias("back"), F.least("bar", F.col("front") + half).alias("bar")),
    )
    return _named(entries.select("word", "n", "m", F.explode(shares).alias("x")).select("word", "n", "m", "x.*").filter("front < bar"))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words."""
    lengths = F.explode(F.sequence(F.greatest(F.lit(LETTERS), F.length("word") - 1), F.length("word")))
    entries = words.select("word", "n", lengths.alias("m")).select("*", F.lit(0).alias("front"), F.lit(0).alias("back"), F.lit(NO_BAR).alias("bar"))
    found, tables = [], []
    members = _dealt(entries)
    while True:
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        held = store(members.join(sizes, "node"), "nodes")
        tables.append(held)
        small = (F.col("size") <= NODE) | (F.col("m") - F.col("front") - F.col("back") <= 1)
        found.append(held.filter(small).select("node", "word", "n", "m", "front", "back", "bar"))
        large = held.filter(~small)
        if large.isEmpty():
            break
        members = _dealt(large.select("word", "n", "m", "front", "back", "bar"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    compared = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_compare, "word string, n_near long, best string, best_n long")
    out = store(compared.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")).select("word", "n_near", "first.best", (-F.col("first.less")).alias("best_n")), "near")
    for table in tables:
        drop(table)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead to; counts grow on the way, so it ends."""
    now = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = store(now.join(next_, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        done = after.filter("moved").isEmpty()
        drop(now)
        now = after.select("word", "root")
        if done:
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = store(vocabulary(docs), "words")
    found = near(words)
    told = words.join(found, "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    placed = store(told.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(placed.filter("form IS NOT NULL"))
    out = store(placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    for table in (words, found, placed, ends):
        drop(table)
    return out
