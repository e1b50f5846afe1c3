"""Benchmark decontamination by a prefix-filtered set join of word shingles.

Every item becomes windows of `window` consecutive words (a shorter item is one window of its own
length).  The shingles of a window are ordered by how rare they are in the corpus; as a window only
occurs where all its shingles do, one necessary prefix shingle, the rarest, suffices as join key.
A document position with such a shingle fixes where the window would lie (positional bound); it must
lie within the document (length bound), and there all its words are compared (128-bit window hash).

The benchmark is joined in chunks of at most CHUNK_BYTES of text, so what is broadcast (some six times that) has a fixed
bound; a larger benchmark takes more passes over the documents, whose rows are numbered once and stored,
so that every row keeps its own spans, null and repeated doc_ids too.  Item texts and document texts are
lower-cased in A-Z.  Nulls and texts without words have no windows; copies of an item count once, equal
texts of several items for each of them.  Texts count whole, whatever their length.  Every row of the
documents gives a row, with text_key, a hash of its text, to tell rows of one doc_id apart; of shingles that
are equally rare the first is the prefix.  Columns other than doc_id, text and item_id are not read, so their
names cannot clash.  Without documents there are no rows, without items no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import store
from tessera.llm.text import ALNUM, U64, Words, grams, slices, split

CHUNK_BYTES = 4 << 20
SHINGLE = 4
FOUND = "n_words long, hit array<long>, items array<string>"


class Index:
    """Windows of one chunk of items, and the shingles that may reveal them, as flat arrays."""

    def __init__(self, texts: list[str | None], window: int):
        words = split(pa.array(texts, pa.string()), ALNUM)
        hashes, counts = words.hashes(lower=True), words.counts
        parts = []  # (first word, item) of every window, by the number of its words
        for size in range(1, window + 1):
            items = np.flatnonzero(counts == size) if size < window else np.flatnonzero(counts >= window)
            each = counts[items] - size + 1
            begin = np.repeat(words.first[items] - np.concatenate(([0], np.cumsum(each)))[:-1], each) + np.arange(each.sum())
            parts.append((size, begin, np.repeat(items, each)))
        size = np.concatenate([np.full(len(begin), n, np.int32) for n, begin, _ in parts])
        start, item = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (1, 2))
        high, low = np.zeros(len(size), U64), np.zeros(len(size), U64)
        for n, begin, _ in parts:
            if len(begin):
                high[size == n], low[size == n] = grams(hashes, n)[begin], grams(hashes, n, 1)[begin]
        # Equal windows are one, with the items that have it.
        order = np.lexsort((item, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        once = new.copy()
        once[1:] |= item[order][1:] != item[order][:-1]
        first = order[new]
        self.size, self.high, self.low, self.start = size[first], high[first], low[first], start[first]
        self.items = item[order][once]
        self.item_first = np.append(np.flatnonzero(new[once]), len(self.items))
        self.hashes = hashes
        self.sizes = np.unique(np.minimum(SHINGLE, self.size)).tolist()
        self.shingles = {}
        for k in self.sizes:
            used = np.zeros(len(hashes), bool)
            for at, _ in self._each(k):
                used[at] = True
            self.shingles[k] = np.unique(grams(hashes, k)[used[: len(hashes) - k + 1]])

    def _each(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows whose shingles have k words, by size: the words where their shingles begin, and the windows."""
        for size in [n for n in np.unique(self.size).tolist() if min(SHINGLE, n) == k]:
            of = np.flatnonzero(self.size == size)
            for i in range(0, len(of), 50_000):
                some = of[i : i + 50_000]
                yield self.start[some][:, None] + np.arange(size - k + 1), some

    def prefixes(self, counts: dict[int, np.ndarray]) -> dict[int, tuple]:
        """For each shingle length: the windows by their rarest shingle that occurs, the first of equals."""
        out = {}
        for k in self.sizes:
            every = grams(self.hashes, k)
            which, offset, of = [], [], []
            for at, some in self._each(k):
                place = np.searchsorted(self.shingles[k], every[at])
                least = counts[k][place].argmin(1)
                which.append(place[np.arange(len(some)), least].astype(np.int32))
                offset.append(least.astype(np.int32))
                of.append(some.astype(np.int32))
            which, offset, of = np.concatenate(which), np.concatenate(offset), np.concatenate(of)
            some = np.flatnonzero(counts[k][which])  # a shingle that never occurs rules its windows out
            some = some[np.argsort(which[some], kind="stable")]
            keys, first = np.unique(which[some], return_index=True)
            if len(keys):
                w = of[some]
                out[k] = self.shingles[k][keys], np.append(first, len(some)), offset[some], w, self.size[w], self.high[w], self.low[w]
        return out


def _marks(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[keys & U64((1 << 22) - 1)] = True
    return table


def _look_up(keys: np.ndarray, marks: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value is a key, and which key it is."""
    at = np.flatnonzero(marks[found & U64((1 << 22) - 1)])
    which = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
    same = keys[which] == found[at]
    return at[same], which[same]


def count_shingles(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle occurs in all documents (no more rows than shingles)."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        marks = {k: _marks(v) for k, v in keys.items()}
        total = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = split(part.column("text"), ALNUM).hashes(lower=True)
                for k, v in keys.items():
                    total[k] += np.bincount(_look_up(v, marks[k], grams(hashes, k))[1], minlength=len(v))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(n[some])], ["k", "i", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
    k, i, n = (rows.column(c).to_numpy() for c in ("k", "i", "n"))
    out = {size: np.zeros(len(v), np.int64) for size, v in shingles.items()}
    for size in out:
        out[size][i[k == size]] = n[k == size]
    return out


def _expand(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group number, its row and every place from first[group] to first[group + 1]."""
    each = first[which + 1] - first[which]
    row = np.repeat(np.arange(len(which)), each)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + first[which][row]


def _verify(words: Words, hashes: np.ndarray, prefix: dict[int, tuple], marks: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(document, first word within it, words, window) of every occurrence of a window, by document."""
    found = []
    whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, (keys, first, offset, window, sizes, high, low) in prefix.items():
        at, which = _look_up(keys, marks[k], grams(hashes, k))
        row, entry = _expand(first, which)
        begin, doc = at[row] - offset[entry], (np.searchsorted(words.first, at, "right") - 1)[row]
        inside = (begin >= words.first[doc]) & (begin + sizes[entry] <= words.first[doc + 1])
        begin, doc, entry = begin[inside], doc[inside], entry[inside]
        for size in np.unique(sizes[entry]).tolist():
            if size not in whole:
                whole[size] = grams(hashes, size), grams(hashes, size, 1)
            own = np.flatnonzero(sizes[entry] == size)
            own = own[(whole[size][0][begin[own]] == high[entry[own]]) & (whole[size][1][begin[own]] == low[entry[own]])]
            found.append((doc[own], begin[own] - words.first[doc[own]], np.full(len(own), size), window[entry[own]]))
    parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
    order = np.argsort(parts[0], kind="stable")
    return tuple(p[order] for p in parts)


def find(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """For each document: its words, the hit ones as [from, to) pairs, and the items that occur in it.

    docs has doc_id and text, items has item_id and text; other columns are ignored.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    chunks = max(1, -(-4 * size // (3 * CHUNK_BYTES)) if size > CHUNK_BYTES else 1)
    dealt = items.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    keys = "doc_id long, text_key long"
    if chunks > 1:  # numbers are only the same in every pass if they are stored
        dealt = store(dealt, "items")
        docs, keys = store(docs.withColumn("row", F.monotonically_increasing_id()), "docs"), "doc_id long, text_key long, row long"
    passes = []
    for chunk in range(chunks):
        rows = dealt.filter(F.col("chunk") == chunk).collect()  # distinct items, so about 3/4 of CHUNK_BYTES
        rows.sort(key=lambda r: (r.item_id is not None, r.item_id or ""))  # items by name, those without one first
        index = Index([r.text for r in rows], window)
        shared = spark.sparkContext.broadcast((index.prefixes(count_shingles(docs, index.shingles)), index.item_first, index.items, pa.array([r.item_id for r in rows], pa.string())))
        passes.append(docs.mapInArrow(_search(shared), f"{keys}, {FOUND}"))
    if chunks == 1:
        return passes[0]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more.filter(F.size("hit") > 0))
    # A row's passes meet again; a row has at most the spans found in it.
    one = (F.max(c).alias(c) for c in ("doc_id", "text_key", "n_words"))
    return every.groupBy("row").agg(*one, F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items")).drop("row")


def _search(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, item_first, items, names = shared.value
        marks = {k: _marks(p[0]) for k, p in prefix.items()}
        unnamed = names.null_count
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column("text"), ALNUM)
                n = part.num_rows
                doc, begin, size, window = _verify(words, words.hashes(lower=True), prefix, marks)
                row, place = _expand(item_first, window)
                pairs = np.unique(doc[row] * len(names) + items[place]) if len(row) else np.zeros(0, np.int64)
                pairs = pairs[pairs % max(1, len(names)) >= unnamed]
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(begin << 16 | size, pa.int64()))
                named = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(names)), pa.int32()), names.take(pa.array(pairs % max(1, len(names)), pa.int64())))
                keys = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(words.counts), hits, named], [*keys, "n_words", "hit", "items"])

    return search


def contamination(found: DataFrame) -> DataFrame:
    """Count hit words, name the items, and apply the rule 20 * n_hit >= n_words.

    Spans are summed up in order of their beginnings, so words in several spans count once.
    """

    def add(state, code):
        begin = F.shiftright(code, 16)
        end = begin + code.bitwiseAND(F.lit(0xFFFF).cast("long"))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(begin, state["end"]))).alias("n"))

    zero = F.lit(0).cast("long")
    n_hit = F.aggregate(F.array_sort("hit"), F.struct(zero.alias("end"), zero.alias("n")), add, lambda state: state["n"])
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "text_key"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
