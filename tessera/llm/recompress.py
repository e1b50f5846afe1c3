"""Substring deduplication by recompression.

Texts are strings of word symbols.  In rounds, runs of one symbol and pairs of neighbouring symbols are
replaced by new symbols.  A pair (a, b) is replaced where the round's coin of a says "left"
and that of b says "right", so whether two neighbours meet depends on those two alone; a new symbol's
name is a hash of what it stands for, hence the same in every document and on every executor.  Equal
substrings are therefore cut into the same symbols except near their ends, and where two high-level
symbols meet inside a long repeat, they meet in every copy of it.

1. Each block of documents names the places where two top-level symbols meet by the words around
   (`CONTEXT` before and after, which holds all that decides the meeting).  A window of words that
   contains no such place with its context, as inside a long run, is named by its own words.
2. Names go to buckets by hash; a bucket tells each block which of its names other blocks have too.
3. A block's windows around shared names are candidates.  They go to buckets by a 128-bit hash of their
   words, with the smallest doc_id that the block has for them, and a bucket answers with one bit per
   window: whether another block has a smaller doc_id for it.
4. Each block marks its words covered by windows that start in a smaller doc_id, and keeps the rest.

Blocks are fixed by doc_id, the block's text is shuffled once and read three times; blocks and buckets
grow in number with the corpus, so no task holds more than a few megabytes whatever the skew: a passage
that a third of all documents share is one name per block.  Blocks send sorted arrays instead of a row
per word, and get bits back: a row for each bucket that a block has names for, which is one row for many
names up to some terabytes and never more than one for each name.

A null or empty text has no words and nothing removed; a long one is a block's work as a whole.  doc_id
names a document: rows that share one are one document to the others, none of them removes words of the
rest, and each keeps its own row; a null doc_id counts as smaller than every number.  Columns other than
doc_id and text are not read, so their names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import U64, Words, grams, joined, mix, split

#: Rounds of renaming.
STEPS = ("runs", "pairs", "pairs")
#: Words on either side of a meeting of symbols that name it; they contain all that decides it.
CONTEXT = 4
BLOCK_BYTES = 2 << 20
#: A bucket gets the names of about so many blocks' text, so a block sends a row to a quarter as many buckets.
BLOCKS_PER_BUCKET = 4

_NULL_DOC = -(1 << 63)
FAR = np.int64(1) << 40
NO_NAME = ~U64(0)


def top_boundaries(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places between top-level symbols, and how many words around decide each one (its reach).

    symbols are word names and doc their documents; a place i lies before word i.  Words up to the edge
    of a document are known, so the first merge takes edges as any other place; from then on their
    reaches are endless, as the words beyond them differ from copy to copy.
    """
    n = len(symbols)
    at = np.arange(n)
    low, high = at.copy(), at.copy()
    edge = np.ones(n, bool)
    edge[1:] = doc[1:] != doc[:-1]
    name, end = symbols, n
    for turn, step in enumerate(STEPS):
        joins = np.zeros(len(name), bool)
        if step == "runs":  # neighbours of one name become one symbol, named by the name and the length
            joins[1:] = (name[1:] == name[:-1]) & ~edge[1:]
        else:  # a symbol whose coin says left takes in the one behind it whose coin says right
            right = ((mix(name + U64(turn + 1)) >> U64(40)) & U64(1)).astype(bool)
            joins[1:] = ~right[:-1] & right[1:] & ~edge[1:]
        name, at, low, high, edge = _merge(name, at, low, high, edge, joins, end, turn)
        if not turn:
            low[edge] -= FAR
            high[edge] += FAR
            end = n + FAR
    return at, np.where(edge, FAR, np.maximum(at - low, high - at))


def _merge(name, at, low, high, edge, joins, end, salt):
    """Join each symbol marked to the one before; boundaries left also depend on their neighbours.

    end is the reach of the place behind the last symbol."""
    if not len(name):
        return name, at, low, high, edge
    before, after = np.empty_like(low), np.empty_like(high)
    before[0], before[1:] = low[0], low[:-1]
    after[-1], after[:-1] = end, high[1:]
    low, high = np.minimum(low, before), np.maximum(high, after)
    starts = np.flatnonzero(~joins)
    sizes = np.diff(np.append(starts, len(name)))
    first = name[starts]
    last = name[starts + sizes - 1]
    new = np.where(sizes > 1, mix(mix(first + U64(salt)) * U64(3) + mix(last ^ U64(0x5BF03635)) + sizes.astype(np.uint64)), first)
    return new, at[starts], low[starts], high[starts], edge[starts]


class Block:
    """One block's documents, and its names and windows computed anew in every pass."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").to_numpy(zero_copy_only=False) if not table.column("doc_id").null_count else table.column("doc_id").fill_null(_NULL_DOC).to_numpy()
        texts = table.column("text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        order = np.lexsort((np.array([t.as_py() or "" for t in texts], object), ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order))
        self.ids = ids[order].astype(np.int64)
        self.words: Words = split(self.table.column("text"))
        self.window = window
        self.doc = self.words.doc
        self.hashes = self.words.hashes()
        # A window starts where enough words of its document follow.
        self.valid = np.zeros(len(self.doc), bool)
        last = len(self.doc) - window
        if last >= 0:
            self.valid[: last + 1] = self.doc[: last + 1] == self.doc[window - 1 :]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, its name: the smallest of its meetings of symbols, or its own."""
        n, w = len(self.doc), self.window
        starts = np.flatnonzero(self.valid)
        if not len(starts):
            return starts, np.zeros(0, U64)
        at, reach = top_boundaries(self.hashes, self.doc)
        at = at[(reach <= CONTEXT) & (at >= CONTEXT) & (at + CONTEXT <= n)]
        at = at[self.doc[at - CONTEXT] == self.doc[at + CONTEXT - 1]]
        value = np.full(n, NO_NAME)
        value[at] = grams(self.hashes, 2 * CONTEXT, 7)[at - CONTEXT]
        # Of the meetings that a window holds with their context, the one with the smallest name.
        names = value[starts + CONTEXT]
        for k in range(CONTEXT + 1, w - CONTEXT + 1):
            np.minimum(names, value[starts + k], out=names)
        bare = np.flatnonzero(names == NO_NAME)
        if len(bare):
            names[bare] = grams(self.hashes, w, 8)[starts[bare]]
        return starts, mix(names)  # smallest names are mostly small: spread them again


def _pack(bucket: np.ndarray, arrays: list[np.ndarray], n_buckets: int, block: int) -> dict:
    """One row per bucket that has entries; the arrays are sorted by bucket already."""
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    row = {"bucket": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), block, np.int32))}
    for k, values in enumerate(arrays):
        row[f"a{k}"] = pa.array([values[a:b].tobytes() for a, b in zip(cut[some], cut[some + 1], strict=True)], pa.binary())
    return row


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the key, so sorted keys are in bucket order."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _distinct(starts: np.ndarray, keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each start's place among them, and whether several documents have the key."""
    owner = doc[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(head)
    unique, place = np.unique(keys[at], return_inverse=True)
    one = np.zeros(len(unique), np.int64)
    one[place] = owner[at]
    several = np.zeros(len(unique), bool)
    several[place[one[place] != owner[at]]] = True
    return unique, place[np.cumsum(head) - 1], several


MESSAGE = "bucket int, block int, a0 binary, a1 binary, a2 binary"
ANSWER = "block int, bucket int, kind int, bits binary"


def _send_names(window: int, n_buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table, window)
        starts, names = block.names()
        unique, _, _ = _distinct(starts, names, block.doc)
        rows = _pack(_buckets(unique, n_buckets), [unique], n_buckets, key[0].as_py())
        none = pa.nulls(len(rows["bucket"]), pa.binary())
        return pa.table(rows | {"a1": none, "a2": none})

    return send


def _shared_names(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Which names of each block other blocks have as well."""
    blobs = table.column("a0").to_pylist()
    keys = np.frombuffer(b"".join(blobs), U64)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return _answer(table, key[0], shared, [len(b) // 8 for b in blobs])


def _answer(table: pa.Table, bucket, flags: np.ndarray, sizes: list[int], kind: int = 0) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = len(sizes)
    return pa.table({"block": table.column("block"), "bucket": pa.array(np.full(n, bucket.as_py(), np.int32)), "kind": pa.array(np.full(n, kind, np.int32)), "bits": pa.array(bits, pa.binary())})


def _flags(answers: pa.Table, buckets: np.ndarray, n_buckets: int) -> np.ndarray:
    """The answers of all buckets, in the order of the sorted keys."""
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    cut = np.searchsorted(buckets, np.arange(n_buckets + 1))
    out = np.zeros(len(buckets), bool)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        size = int(cut[k + 1] - cut[k])
        out[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=size).astype(bool)
    return out


def _candidates(block: Block, shared: np.ndarray, several: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple:
    """Windows with a shared name: sorted distinct hashes, their smallest documents, each start's place."""
    at = starts[(shared | several)[place]]
    high, low = grams(block.hashes, block.window, 1), grams(block.hashes, block.window, 2)
    high, low = high[at], low[at]
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    group = np.cumsum(new) - 1
    place = np.empty(len(order), np.int64)
    place[order] = group
    begin = np.flatnonzero(new)
    ids = block.ids[block.doc[at]]
    smallest = np.minimum.reduceat(ids[order], begin) if len(begin) else np.zeros(0, np.int64)
    return at, place, high[order][new], low[order][new], smallest


def _send_windows(window: int, n_buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, window)
        starts, names = block.names()
        unique, place, several = _distinct(starts, names, block.doc)
        shared = _flags(answers, _buckets(unique, n_buckets), n_buckets)
        _, _, high, low, smallest = _candidates(block, shared, several, starts, place)
        rows = _pack(_buckets(high, n_buckets), [high, low, smallest], n_buckets, key[0].as_py())
        # The answers that the block got travel along, under a bucket of its own, for the last pass.
        own = key[0].as_py()
        none = pa.nulls(1, pa.binary())
        carried = {"bucket": pa.array([-1 - own], pa.int32()), "block": pa.array([own], pa.int32()), "a0": pa.array([np.packbits(shared).tobytes()], pa.binary()), "a1": none, "a2": none}
        return pa.concat_tables([pa.table(rows), pa.table(carried)])

    return send


def _smaller_elsewhere(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each block's windows, whether another block has a smaller document."""
    if key[0].as_py() < 0:
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array(np.ones(len(table), np.int32)), "bits": table.column("a0")})
    blobs = [table.column(f"a{k}").to_pylist() for k in range(3)]
    high, low = (np.frombuffer(b"".join(b), U64) for b in blobs[:2])
    ids = np.frombuffer(b"".join(blobs[2]), np.int64)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    flags = np.zeros(len(order), bool)
    flags[order] = smallest < ids[order]
    return _answer(table, key[0], flags, [len(b) // 8 for b in blobs[0]])


def _mark(window: int, n_buckets: int):
    def mark(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, window)
        starts, names = block.names()
        unique, place, several = _distinct(starts, names, block.doc)
        kinds = answers.column("kind").to_numpy()
        own = answers.filter(pa.array(kinds == 1)).column("bits").to_pylist()
        shared = np.unpackbits(np.frombuffer(own[0], np.uint8), count=len(unique)).astype(bool) if own and len(unique) else np.zeros(len(unique), bool)
        at, place, high, _, smallest = _candidates(block, shared, several, starts, place)
        elsewhere = _flags(answers.filter(pa.array(kinds == 0)), _buckets(high, n_buckets), n_buckets)
        repeats = elsewhere[place] | (smallest[place] < block.ids[block.doc[at]])
        covered = np.zeros(len(block.doc) + 1, np.int64)
        np.add.at(covered, at[repeats], 1)
        np.add.at(covered, at[repeats] + window, -1)
        removed = np.cumsum(covered[:-1]) > 0
        texts = joined(block.words, ~removed)
        counts = block.words.counts
        total = np.concatenate(([0], np.cumsum(removed)))
        gone = total[block.words.first[1:]] - total[block.words.first[:-1]]
        return pa.table(
            {
                "doc_id": block.table.column("doc_id"),
                "n_words": pa.array(counts.astype(np.int64)),
                "n_removed": pa.array(gone.astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                "kept_text": pa.array([str(t, "utf-8") if g else None for t, g in zip(texts, gone.tolist(), strict=True)], pa.string()),
            }
        )

    return mark


def remove_repeats(docs: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of docs.

    kept_text is null where nothing was removed: the text stays as it is then.
    """
    if window < 3 * CONTEXT + 1:
        raise ValueError("a window must have room for a meeting of symbols with its context")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(16, -(-size // block_bytes))
    buckets = max(16, blocks // BLOCKS_PER_BUCKET)
    texts = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    shared = texts.groupBy("block").applyInArrow(_send_names(window, buckets), MESSAGE).groupBy("bucket").applyInArrow(_shared_names, ANSWER)
    windows = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_windows(window, buckets), MESSAGE)
    answers = windows.groupBy("bucket").applyInArrow(_smaller_elsewhere, ANSWER)
    return (
        texts.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(_mark(window, buckets), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
