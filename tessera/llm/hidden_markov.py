"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Texts are lower-cased in A-Z; their tokens are words and one end each.  All tokens of the training documents
are counted.  The WORDS most frequent ones, and the end, have emission chances of their own in each of STATES
states; all other words share one tail symbol, within which a word has the chance (c + 1) / (C + D + 1) for
its count c and the C occurrences of D words in the tail, so an unknown word has the rest.  So the chances
of all tokens sum to one in each state.

States begin as clusters of words by their neighbours.  In each of ROUNDS rounds every training document is
passed forwards and backwards in stretches of SEGMENT symbols; tasks add up expected starts, transitions and
emissions, and a row per symbol and task goes on to be summed.  Emissions are smoothed by BACKOFF expected
occurrences of the symbols' overall shares.  Scoring runs the scaled forward recursion over each whole
document, so a score is the exact log10 probability of its text.

Tasks hold the model only, whose size is fixed.  Counts of words in the tail come from a join of the documents'
tail words with the counted vocabulary; no such word is frequent enough to be a hot key.

A null or empty text is the end alone; texts count whole.  Rows with a null doc_id train and are not held
out; rows that repeat are scored one by one and equal texts score alike.  Without training documents, every
token counts as unknown.  Words of more than WORD_BYTES bytes are in the tail.  Columns other than doc_id
and text are not read, so their names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.streams import SCHEMA, Counter, buckets_for, merged
from tessera.llm.tables import drop, store
from tessera.llm.text import NON_SPACE, Words, slices, split

STATES = 16
WORDS = 32_000
WORD_BYTES = 64
SEGMENT = 64
ROUNDS = 4
BACKOFF = 100.0
#: Symbols whose neighbourhood tells words apart at the beginning.
CONTEXTS = 32
#: Stretches that are worked on at once.
LANES = 4096
END, TAIL = 0, 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def coded_words(texts: pa.Array) -> tuple[Words, pa.Array, np.ndarray]:
    """Words of the texts, the distinct ones in lower case, and which of them each word is."""
    words = split(texts)
    size = words.ends - words.starts
    data = _LOWER[words.buf[NON_SPACE[words.buf]]]
    held = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(data)])
    coded = held.dictionary_encode()
    return words, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens; the empty word is the end."""
    buckets = buckets_for(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                _, known, code = coded_words(part.column("text"))
                yield from counter.add("", pa.array([""], pa.large_string()), np.array([part.num_rows]))
                yield from counter.add("", known, np.bincount(code, minlength=len(known)))
        yield from counter.flush()

    return merged(texts.select("text").mapInArrow(count, SCHEMA)).select(F.col("key").alias("word"), F.col("n").alias("c"))


@dataclass
class Dictionary:
    """The symbols: the end, the tail and the most frequent words, with their counts; and what all tokens add up to."""

    words: list[str]
    counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def tail_size(self) -> int:
        """Occurrences and words of the tail, and one for the unknown."""
        inside = int((np.delete(self.counts, TAIL) > 0).sum())
        return int(self.counts[TAIL]) + self.distinct - inside + 1


def dictionary(counted: DataFrame, limit: int = WORDS) -> Dictionary:
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends")).first()
    top = counted.filter((F.col("word") != "") & (F.octet_length("word") <= WORD_BYTES)).orderBy(F.desc("c"), "word").limit(limit).collect()
    counts = np.array([total.ends, 0, *(r.c for r in top)], np.int64)
    counts[TAIL] = total.n - counts.sum()
    return Dictionary([r.word for r in top], counts, total.n, total.v)


CODES = "row long, n_tokens long, known long, base double, ids binary, tail array<string>, times array<int>"


def _encode(shared):
    """Symbols of each text, its words of the tail, and what its other tokens say of the base score."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        logs, seen = np.log10(book.counts + 1.0), book.counts > 0
        logs[TAIL], seen[TAIL] = 0, False
        values = pa.array(book.words, pa.large_string())
        for batch in batches:
            for part in slices(batch, "text"):
                words, known, code = coded_words(part.column("text"))
                n = part.num_rows
                symbol = pc.fill_null(pc.index_in(known, value_set=values), -1).to_numpy().astype(np.int64) + 2
                symbol[symbol == 1] = TAIL
                ids = symbol[code] if len(code) else np.zeros(0, np.int64)
                ids = np.insert(ids, words.first[1:], END)
                at = words.first + np.arange(n + 1)
                sums = [np.concatenate(([0], np.cumsum(x[ids]))) for x in (logs, seen)]
                base, told = (s[at[1:]] - s[at[:-1]] for s in sums)
                blob = ids.astype("<u2")
                in_tail = np.flatnonzero(symbol[code] == TAIL) if len(code) else np.zeros(0, np.int64)
                pair, times = np.unique(words.doc[in_tail] * max(len(known), 1) + code[in_tail], return_counts=True)
                cut = np.searchsorted(pair, np.arange(n + 1) * max(len(known), 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), known.take(pa.array(pair % max(len(known), 1))).cast(pa.string()))
                bytes_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(blob)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.diff(at)), pa.array(told.astype(np.int64)), pa.array(base.astype(float)), bytes_, tail, pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))],
                    ["row", "n_tokens", "known", "base", "ids", "tail", "times"],
                )

    return encode


@dataclass
class Model:
    start: np.ndarray
    inner: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row of chances per symbol, one for each state


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of some documents, and where each document's begin."""
    _, at, data = column.cast(pa.large_binary()).buffers()
    first = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    ids = np.frombuffer(data, "<u2") if data is not None else np.zeros(0, "<u2")
    return ids[first[0] : first[-1]].astype(np.int64), first - first[0]


def stretches(first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of the pieces of at most so many symbols, the longest first, and whether a text begins there."""
    pieces = -(-np.diff(first) // longest)
    doc = np.repeat(np.arange(len(pieces)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[doc] + nth * longest
    size = np.minimum(first[doc + 1] - begin, longest)
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order], nth[order] == 0


def _columns(k: int) -> list[str]:
    return [f"s{i}" for i in range(k)]


class Expected:
    """Expected counts of a model over stretches of symbols."""

    def __init__(self, model: Model):
        self.model = Model(*(x.astype(np.float32) for x in (model.start, model.inner, model.move, model.emit)))
        n, k = model.emit.shape
        self.emit, self.move, self.start, self.log = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k), 0.0

    def add(self, ids: np.ndarray, first: np.ndarray) -> None:
        begin, size, opens = stretches(first, SEGMENT)
        for a in range(0, len(begin), LANES):
            some = slice(a, a + LANES)
            self._add(ids, begin[some], size[some], opens[some])

    def _add(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, opens: np.ndarray) -> None:
        m, k, steps = self.model, len(self.start), int(size[0])
        active = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # stretches with more than t symbols
        symbols = [ids[begin[:n] + t] for t, n in enumerate(active)]
        ahead, scale = [], []
        for t, n in enumerate(active):
            now = (ahead[-1][:n] @ m.move if t else np.where(opens[:, None], m.start, m.inner)) * m.emit[symbols[t]]
            scale.append(now.sum(1, keepdims=True))
            now /= scale[-1]
            ahead.append(now)
        self.log += sum(float(np.log(s).sum()) for s in scale)
        back = np.ones((active[-1], k), np.float32)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            if len(back) < n:
                back = np.concatenate((back, np.ones((n - len(back), k), np.float32)))
            if t:
                after = back * m.emit[symbols[t]] / scale[t]
                self.move += m.move * (ahead[t - 1][:n].T @ after)
            state = ahead[t] = ahead[t] * back
            state /= state.sum(1, keepdims=True)
            if t:
                back = after @ m.move.T
            else:
                self.start += state[opens].sum(0)
        flat, states = np.concatenate(symbols), np.concatenate(ahead)
        for i in range(k):
            self.emit[:, i] += np.bincount(flat, states[:, i], minlength=len(self.emit))


def _expect(shared):
    """Sums of a task: a row per symbol, then per state it is left from, the starts and the log-likelihood."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected(shared.value)
        for batch in batches:
            total.add(*_ids(batch.column("ids")))
        n, k = total.emit.shape
        some = np.flatnonzero(total.emit.any(1))
        table = np.concatenate((total.emit[some], total.move, total.start[None], np.eye(1, k) * total.log))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, n + np.arange(k + 2)))), *(pa.array(table[:, i]) for i in range(k))], ["id", *_columns(k)])

    return expect


def _neighbours(n: int):
    """How often each of n symbols stands before and behind each of the first CONTEXTS ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * 2 * CONTEXTS, np.int64)
        for batch in batches:
            ids, first = _ids(batch.column("ids"))
            inner = np.ones(len(ids), bool)
            inner[first[1:] - 1] = False
            at = np.flatnonzero(inner)
            left, right = ids[at], ids[at + 1]
            cells = np.concatenate(((left * 2 * CONTEXTS + right)[right < CONTEXTS], (right * 2 * CONTEXTS + CONTEXTS + left)[left < CONTEXTS]))
            total += np.bincount(cells, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return count


def clusters(near: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Symbols by their neighbours: weighted means of square roots of shares, from a fixed start."""
    x = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1)).astype(np.float32)
    draw = np.random.default_rng(13)
    centre = x[draw.choice(len(x), 1, p=weight / weight.sum())]
    while len(centre) < k:
        far = weight * np.maximum(0, np.min(((x**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * x @ centre.T), axis=1))
        centre = np.concatenate((centre, x[draw.choice(len(x), 1, p=far / far.sum())] if far.sum() > 0 else x[[len(centre) % len(x)]]))
    for _ in range(rounds):
        own = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for i in range(k):
            mine = own == i
            if mine.any():
                centre[i] = np.average(x[mine], axis=0, weights=weight[mine])
    return own


def shares(book: Dictionary) -> np.ndarray:
    """Overall chances of the symbols; none is zero."""
    return (book.counts + 1.0) / (book.counts + 1.0).sum()


def begin(book: Dictionary, near: np.ndarray, k: int) -> Model:
    """Each state emits mostly the words of one cluster; moves follow the clusters of neighbours."""
    overall = shares(book)
    own = clusters(near, overall, k)
    emit = np.where(own[:, None] == np.arange(k), 0.8, 0.2 / max(k - 1, 1)) * overall[:, None]
    move = np.ones((k, k))
    n = min(CONTEXTS, len(own))
    np.add.at(move, (np.repeat(own, n), np.tile(own[:n], len(own))), near[:, :n].reshape(-1))
    move /= move.sum(1, keepdims=True)
    even = np.full(k, 1 / k)
    return Model(even, even, move, emit / emit.sum(0))


def improved(total: Expected, overall: np.ndarray, backoff: float = BACKOFF) -> Model:
    move = total.move + 1.0
    start = total.start + 1.0
    states = total.emit.sum(0) + 1.0
    emit = total.emit + backoff * overall[:, None]
    return Model(start / start.sum(), states / states.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(codes: DataFrame, book: Dictionary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model and the log-likelihood before each round, from the symbols of the training documents."""
    context = codes.sparkSession.sparkContext
    n = len(book.counts)
    cells = codes.select("ids").mapInArrow(_neighbours(n), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2 * CONTEXTS for each symbol at most
    near = np.zeros(n * 2 * CONTEXTS)
    near[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    model, logs = begin(book, near.reshape(n, 2 * CONTEXTS), states), []
    schema = "id long, " + ", ".join(f"{c} double" for c in _columns(states))
    for _ in range(rounds):
        shared = context.broadcast(model)
        sums = codes.select("ids").mapInArrow(_expect(shared), schema).groupBy("id").agg(*(F.sum(c).alias(c) for c in _columns(states))).toArrow()
        shared.unpersist()
        table = np.zeros((n + states + 2, states))
        table[sums["id"].to_numpy()] = np.stack([sums[c].to_numpy() for c in _columns(states)], axis=1)
        total = Expected(model)
        total.emit, total.move, total.start = table[:n], table[n : n + states], table[n + states]
        logs.append(float(table[-1, 0]))
        model = improved(total, shares(book))
    return model, logs


def forward(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of each document's probability: the forward recursion over all documents side by side."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, left = first[:-1][order], size[order]
    log = np.zeros(len(size))
    now = np.broadcast_to(model.start, (len(size), len(model.start)))
    for t in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -t, "left"))
        now = (now[:n] @ model.move if t else now[:n]) * model.emit[ids[begin[:n] + t]]
        total = now.sum(1)
        log[:n] += np.log10(total)
        now = now / total[:, None]
    out = np.empty(len(size))
    out[order] = log
    return out


def _likelihood(shared, kept: list[str]):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = forward(shared.value, *_ids(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(symbols)], [*kept, "symbols"])

    return rate


def score(docs: DataFrame, held_out, states: int = STATES, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_tail) of every row; rows not held out train."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    counted = store(count_tokens(rows.filter("NOT held_out")), "tokens")
    book = dictionary(counted, words)
    context = docs.sparkSession.sparkContext
    named = rows.withColumn("row", F.monotonically_increasing_id())
    # The row number, which carries doc_id and held_out, is fixed once the codes are written.
    shared = context.broadcast(book)
    told = named.select(F.struct("row", "doc_id", "held_out").alias("row"), "text").mapInArrow(_encode(shared), CODES.replace("row long", "row struct<row: long, doc_id: long, held_out: boolean>"))
    codes = store(told.select("row.*", "n_tokens", "known", "base", "ids", "tail", "times"), "codes")
    model, _ = train(codes.filter("NOT held_out"), book, states, rounds)

    each = codes.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    found = each.join(counted, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    model_ = context.broadcast(model)
    rated = codes.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "ids", F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + t).alias("n_tail"))
    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "n_tail"]
    exact = rated.mapInArrow(_likelihood(model_, kept), ", ".join(f"{c} {rated.schema[c].dataType.simpleString()}" for c in kept) + ", symbols double")
    logs = F.coalesce("logs", F.lit(0.0))
    out = store(
        exact.join(found, "row", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(book.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + logs - F.col("n_tokens") * float(np.log10(book.tokens + book.distinct + 1))).alias("base_score"),
            (F.col("symbols") + logs - F.col("n_tail") * float(np.log10(book.tail_size))).alias("score"), "n_tail",
        ),
        "language_model",
    )
    for table in (counted, codes):
        drop(table)
    return out
