"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words, lower-cased in A-Z, their shapes (runs of upper case, lower case, digits
and each other sign, as in "Aa," or "A!!"), pairs of neighbouring shapes, and whether a word repeats the one
before; all are hashed to TERMS numbers.
Term weights are damped counts times inverse document frequency over all documents; a truncated singular value
decomposition of a bounded sample of labelled documents gives the latent space.  The labelled vectors
are broadcast (at most SAMPLE rows of RANK numbers), and every document of the corpus is compared with
all of them in blocks by exact cosine products; its NEIGHBOURS nearest vote by similarity.

The sample is the SAMPLE labelled rows with the smallest hashes of doc_id; where a doc_id repeats, of the
rows that have these labels, the first 2 * SAMPLE in that order.  A null or empty text has no terms and
gets the sample's mean label; with no labels at all every score is 0.5.  Texts count whole, whatever their
length.  Labels that are not 0 or 1 are left out; a doc_id that repeats is scored row by row, and equal
texts score alike.  Of neighbours that are equally near, which ones vote is fixed by the model alone.
Other columns are passed on or not read; the name of the score may be chosen.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import unused
from tessera.llm.text import U64, _window_sums, mix, slices, split

TERMS = 4096
#: The first terms are shapes, pairs of them and repeats, the others words.
SHAPES = 3072
#: Words say less about quality than shapes: their weights are this share.
WORD_WEIGHT = 0.35
RANK = 48
SAMPLE = 4096
NEIGHBOURS = 25
BLOCK = 2048

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = _CLASS[0x80:] = ord("a")
_CLASS[0x30:0x3A] = ord("9")
_CODE = mix(np.arange(256, dtype=np.uint64) + U64(11))
_BASE = 0xA24BAED4963EE407


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo a number; null has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse term counts: row offsets, terms, counts; and the words of each row."""
    words = split(texts)
    n = len(words.first) - 1
    if not len(words.starts):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(n, np.int64)
    kind = _CLASS[words.buf]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.starts] = True
    place = np.flatnonzero(keep)
    begin, end = np.searchsorted(place, words.starts), np.searchsorted(place, words.ends)
    shape = mix(_window_sums(_CODE[kind[place]], _BASE, begin, end))
    hashes = words.hashes(lower=True)
    same = np.zeros(len(shape), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    doc = words.doc
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    same[1:] &= doc[1:] == doc[:-1]
    forms = np.concatenate((shape, mix(shape[inner] * U64(3) + shape[inner + 1]), mix(same.astype(np.uint64) + U64(77)))) % U64(SHAPES)
    terms = np.concatenate((forms, U64(SHAPES) + hashes % U64(TERMS - SHAPES)))
    rows = np.concatenate((doc, doc[inner], doc, doc))
    keys, counts = np.unique(rows * TERMS + terms.astype(np.int64), return_counts=True)
    return np.searchsorted(keys, np.arange(n + 1) * TERMS), keys % TERMS, counts.astype(float), words.counts


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


@dataclass
class Model:
    """Term weights, the latent basis, and the labelled vectors with their labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero where a row has no weighted term."""
        return _unit(_project(offsets, terms, _damped(offsets, counts) * self.weight[terms], self.basis))

    def score(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        known = np.flatnonzero(np.abs(vectors).sum(1) > 0)
        for at in range(0, len(known), BLOCK):
            some = known[at : at + BLOCK]
            cosine = vectors[some] @ self.vectors.T
            near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k :]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** 8 + 1e-9
            out[some] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def _damped(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts' shares of their rows."""
    rows = _rows(offsets)
    total = np.bincount(rows, counts, minlength=len(offsets) - 1)
    return np.sqrt(counts / np.maximum(total[rows], 1))


def _project(offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, basis.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(basis[terms] * values[:, None].astype(np.float32), offsets[some], axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def _right_singular(matrix: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The leading right singular vectors, by block power iteration from a fixed start."""
    rank = min(rank, *matrix.shape)
    basis = np.random.default_rng(7).normal(size=(matrix.shape[1], rank)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    return basis.astype(np.float32)


def labelled_counts(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> list[tuple[int, int, bytes, bytes]]:
    """(doc_id, label, terms, counts) of the bounded sample, the last two as bytes; no text reaches the driver."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, terms, counts, _ = term_counts(part.column("text"))
                blobs = [[x[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] for x in (terms.astype("<u2"), counts.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(b, pa.binary()) for b in blobs)], ["doc_id", "label", "terms", "counts"])

    # The sample has a fixed bound, so it may be sent to every task.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.mapInArrow(count, "doc_id long, label int, terms binary, counts binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "terms", "counts").limit(2 * limit).collect()
    return sorted((r.doc_id, r.label, bytes(r.terms), bytes(r.counts)) for r in rows)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of all documents, and in how many each term occurs (TERMS + 1 rows at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)  # the last one counts documents
        for batch in batches:
            for part in slices(batch, "text"):
                total[:TERMS] += np.bincount(term_counts(part.column("text"))[1], minlength=TERMS)
                total[TERMS] += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return int(out[TERMS]), out[:TERMS]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Model:
    rows = labelled_counts(docs, labels, label, limit)
    y = np.array([label for _, label, _, _ in rows], float)
    if not len(rows):
        return Model(np.zeros(TERMS), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    offsets = np.concatenate(([0], np.cumsum([len(t) // 2 for _, _, t, _ in rows]))).astype(np.int64)
    terms = np.frombuffer(b"".join(t for _, _, t, _ in rows), "<u2").astype(np.int64)
    counts = np.frombuffer(b"".join(c for *_, c in rows), "<u4").astype(float)
    n_docs, frequency = document_frequencies(docs)
    weight = np.where(frequency > 0, np.log((1 + n_docs) / (1 + frequency)) + 0.3, 0)
    weight[SHAPES:] *= WORD_WEIGHT
    dense = np.zeros((len(rows), TERMS), np.float32)
    dense[_rows(offsets), terms] = _damped(offsets, counts) * weight[terms]
    basis = _right_singular(dense, RANK)
    model = Model(weight, basis, np.zeros((0, basis.shape[1]), np.float32), y, float(y.mean()))
    blocks = [offsets[a : a + 257] for a in range(0, len(rows), 256)]  # a block's terms by RANK are held at once
    model.vectors = np.concatenate([model.embed(o - o[0], terms[o[0] : o[-1]], counts[o[0] : o[-1]]) for o in blocks])
    return model


def score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of every row, with its score in a column of its own, which none of them may be named like."""
    if unused(name, columns) != name:
        raise ValueError(f"there is a column {name} already: give the score another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(name, "double")
    text = unused("scored_text", columns)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, text):
                offsets, terms, counts, _ = term_counts(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(known.score(known.embed(offsets, terms, counts)), pa.float64())], [*columns, name])

    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(rate, schema)
