"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut in Spark tasks; only the histogram of piece lengths, which has at
most `capacity` entries at any data size, reaches the driver.  There the configuration program
(fewest sequences such that patterns cover all lengths) is solved by multiplicative weights, with
an unbounded knapsack by dynamic programming as the pricing step; pattern uses are rounded down and
the few pieces left over are placed best-fit.  The plan maps "the r-th piece of length l" to a
sequence and an offset, so pieces only need a rank within their length: per-task counts give each
task its base and no length, however common, is gathered anywhere.

The counts have a row for each task and length; Spark sends them to all tasks only below its own limit for
that, and shuffles the narrow rows of the pieces beyond.

A null text counts as empty: the document is the end id alone.  Long texts are cut into pieces, never
dropped; rows that repeat are packed one by one, null doc_ids too.  Pieces of one length are alike to the
plan: their order follows the tasks.  Columns other than doc_id and text are not read, so their names cannot
clash.  An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import drop, store
from tessera.llm.text import slices
from tessera.llm.token_files import TOKEN_SLICE, encode_with_end

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack for every room up to the capacity: best value, and the last length taken."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        k = upto[room]
        gain = values[:k] + best[room - lengths[:k]]
        i = int(gain.argmax())
        best[room], choice[room] = gain[i], i
    return best, choice


def configuration_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 60, step: float = 0.1, rate: float = 6.0) -> list[tuple[dict[int, int], float]]:
    """Fractional uses of patterns {length index: copies}, by multiplicative weights.

    A round prices each length by its size times a weight that shrinks as its demand is covered, and
    solves the pricing knapsack once.  Its table holds the best pattern through every length; those
    within a hundredth of the best are used, each until it has covered `step` of some demand.
    """
    covered = np.zeros(len(lengths))
    uses: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        value = lengths[open_] * np.exp(-rate * (covered[open_] - covered[open_].min()))
        best, choice = _knapsack(lengths[open_], value, capacity)
        through = value + best[capacity - lengths[open_]]
        before = covered.copy()
        for j in np.argsort(-through, kind="stable").tolist():
            if through[j] < 0.99 * through.max():
                break
            pattern: dict[int, int] = defaultdict(int)
            room = capacity
            while j >= 0:
                pattern[int(open_[j])] += 1
                room -= int(lengths[open_[j]])
                j = int(choice[room])
            at, copies = np.array(list(pattern)), np.array(list(pattern.values()))
            free = np.minimum(before[at] + step, 1) - covered[at]
            amount = float(np.min(free * demand[at] / copies))
            if amount > 1e-9:
                covered[at] += amount * copies / demand[at]
                uses[tuple(sorted(pattern.items()))] += amount
    return [(dict(p), x) for p, x in uses.items()]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go by rank: (length, first rank, last rank + 1, copies per sequence, first sequence, first offset)."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []  # (((length, copies), ...), sequences)
    if capacity in left:
        bins.append((((capacity, 1),), left.pop(capacity)))
    if left:
        lengths = np.array(sorted(left))
        demand = np.array([left[k] for k in lengths.tolist()], float)
        for pattern, x in sorted(configuration_program(lengths, demand, capacity), key=lambda u: -u[1]):
            named = {int(lengths[i]): n for i, n in pattern.items()}
            times = min(int(x + 1e-9), *(left[k] // n for k, n in named.items()))
            if times:
                bins.append((tuple(sorted(named.items(), reverse=True)), times))
                for k, n in named.items():
                    left[k] -= times * n
        bins = _best_fit(bins, left, capacity)
    rows, ranks, sequence = [], defaultdict(int), 0
    for pattern, times in bins:
        offset = 0
        for length, copies in pattern:
            first = ranks[length]
            rows.append((length, first, first + copies * times, copies, sequence, offset))
            ranks[length] = first + copies * times
            offset += length * copies
        sequence += times
    return rows


def _best_fit(bins: list, left: dict[int, int], capacity: int) -> list:
    """Place what rounding left, longest first, into the fullest sequences that have room."""
    room: dict[int, list] = defaultdict(list)
    for pattern, times in bins:
        room[capacity - sum(k * n for k, n in pattern)].append((pattern, times))
    for length in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            fits = min((r for r in room if r >= length and room[r]), default=None)
            if fits is None:
                each = min(n, capacity // length)
                room[capacity - each * length].append((((length, each),), n // each))
                n -= n // each * each
                continue
            pattern, times = room[fits].pop()
            used = min(n, times)
            if times > used:
                room[fits].append((pattern, times - used))
            grown = dict(pattern)
            grown[length] = grown.get(length, 0) + 1
            room[fits - length].append((tuple(sorted(grown.items(), reverse=True)), used))
            n -= used
    return [b for group in room.values() for b in group]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most capacity tokens, each with its rank among its task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part_id = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", TOKEN_SLICE):
                flat, offsets = encode_with_end(tokenizer, end_id, part.column("text"))
                size = np.diff(offsets)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                begin = offsets[row] + start
                raw = flat.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                run = np.arange(len(by)) - np.searchsorted(by, by)
                rank = np.empty(len(by), np.int64)
                rank[order] = run + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), part_id, np.int32)), part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank)],
                    ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack documents; a row per piece with its sequence_id and gapless offset there."""
    cut = store(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = store(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # At most `capacity` rows reach the driver, whatever the input.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, capacity)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    bases = counts.select("length", "part", (earlier - F.col("n")).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    out = store(_place(ranked, rows), "packed")
    for table in (cut, counts):
        drop(table)
    return out


def _place(ranked: DataFrame, rows: list) -> DataFrame:
    """Find each piece's plan row by its length and rank.

    The plan has a bounded number of rows (a few thousand patterns of a capacity that is fixed), so
    its arrays travel to the tasks, which look ranks up by binary search.
    """
    spark = ranked.sparkSession
    data = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(data)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        span = np.int64(1) << 50
        keys = known[:, 0] * span + known[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = known[np.searchsorted(keys, length * span + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 4] + nth // row[:, 3]
            offset = row[:, 5] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(look, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
