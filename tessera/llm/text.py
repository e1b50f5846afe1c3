"""Vectorised word splitting and hashing over Arrow string columns.

Spark hands each task a stream of Arrow batches; these kernels work on the UTF-8 bytes of a
batch at once, so no Python object is made per word.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one kernel call works on; a longer document is taken on its own.
SLICE_BYTES = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of anything but space and \t..\r.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of letters and digits: ASCII ones and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_TABLE = {False: _BYTE, True: _BYTE[_LOWER]}
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, U64)
        have[0], done, step = 1, 1, base
        while done < size:
            have[done : 2 * done] = have[:done] * U64(step)
            done, step = 2 * done, step * step & 0xFFFFFFFFFFFFFFFF
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _window_sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sum(values[s + j] * base**j) for each [s, e), from one prefix sum."""
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]


@dataclass
class Words:
    """Words of a run of documents: byte spans, and the first word of each document."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return mix(_window_sums(_TABLE[lower][self.buf], _BASE, self.starts, self.ends))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.cast(pa.large_string()).chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array | pa.ChunkedArray, table: np.ndarray = NON_SPACE) -> Words:
    """Words are maximal runs of bytes of the class, within one document."""
    buf, offsets = text_bytes(texts)
    return runs(buf, offsets, table[buf])


def runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words are maximal runs of bytes that lie inside, within one document."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets), offsets)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n words from each word on; the last n - 1 places have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    at = np.arange(m)
    base = (0xD6E8FEB86659FD93 + 2 * seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF | 1
    return mix(_window_sums(hashes if not seed else mix(hashes + U64(seed)), base, at, at + n) + U64(n))


def gram_starts(words: Words, n: int) -> np.ndarray:
    """Indices of the words from which n words of the same document follow."""
    count = words.counts
    if not (count >= n).any():
        return np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], count) - n
    return np.flatnonzero(np.arange(len(last)) <= last)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with at most limit bytes of text, or one longer row."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in order of an integer key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[0].column(key)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def joined(words: Words, keep: np.ndarray | None = None) -> list[memoryview]:
    """For each document, its kept words joined by one space."""
    n_docs = len(words.first) - 1
    keep = np.ones(len(words.starts), bool) if keep is None else keep
    at = np.flatnonzero(keep)
    delta = np.zeros(len(words.buf) + 1, np.int8)
    delta[words.starts[at]] += 1
    delta[words.ends[at]] -= 1
    mask = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    doc = words.doc[at]
    follows = np.zeros(len(at), bool)
    follows[:-1] = doc[1:] == doc[:-1]
    gaps = words.ends[at[follows]]
    buf = words.buf.copy()
    buf[gaps] = 0x20
    mask[gaps] = True
    before = np.concatenate(([0], np.cumsum(mask)))[words.offsets]
    out = memoryview(buf[mask])
    return [out[before[i] : before[i + 1]] for i in range(n_docs)]
