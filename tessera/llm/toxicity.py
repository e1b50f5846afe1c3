"""Toxicity by multiple-instance learning: sentences are instances, documents are labelled bags.

A sentence's score is a logistic function of the features of its words (each word, and its beginnings
of several lengths, lower-cased in A-Z and hashed); a document's score is the noisy-or of its sentences,
1 - prod(1 - p).  Only document labels are known in training: the likelihood of the noisy-or is climbed
by gradient steps over a bounded sample of labelled documents, the SAMPLE rows with the smallest hashes
of doc_id, as far as SAMPLE_BYTES of text, without documents of more than LONGEST_BYTES.  Scoring covers every sentence of every document and can return the offending ones.

A null or empty text has no sentences and scores 0.  With no labels every score is the noisy-or of
sentences at the starting bias.  Labels that are not 0 or 1 are left out; where a doc_id repeats, of the
rows that have the sample's labels, the first 2 * SAMPLE by the same order train.  Texts count whole,
whatever their length; rows that repeat are scored one by one, and equal texts score alike.  Other columns
are passed on or not read; the names of the results may be chosen.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import unused
from tessera.llm.text import _BASE, _TABLE, ALNUM, U64, Words, _window_sums, byte_class, mix, slices, split

FEATURES = 1 << 18
BEGINNINGS = (4, 5, 6, 7, 8)
SAMPLE = 4000
#: Bytes of text that train at most, in all and in one document; longer documents are scored, but do not train.
SAMPLE_BYTES = 64 << 20
LONGEST_BYTES = 4 << 20
ROUNDS = 200
START_BIAS = -6.0
PENALTY = 0.2
FEWEST = 5
#: Sentences end at these bytes.
SENTENCE = ~byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: the word itself, and each of its beginnings."""
    values = _TABLE[True][words.buf]
    size = words.ends - words.starts
    at, found = [np.arange(len(size))], [mix(_window_sums(values, _BASE, words.starts, words.ends))]
    for k in BEGINNINGS:
        long = np.flatnonzero(size > k)
        at.append(long)
        found.append(mix(_window_sums(values, _BASE, words.starts[long], words.starts[long] + k) + U64(k)))
    return np.concatenate(at), (np.concatenate(found) % U64(FEATURES)).astype(np.int64)


def instances(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of the texts, and distinct (sentence, feature) pairs sorted by sentence."""
    sentences = split(texts, SENTENCE)
    words = split(texts, ALNUM)
    if not len(words.starts):
        return sentences, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(sentences.starts) + 1, np.int64)
    of_word = np.searchsorted(sentences.starts, words.starts, "right") - 1
    word, feature = word_features(words)
    keys = np.unique(of_word[word] * FEATURES + feature)
    sentence = keys // FEATURES
    return sentences, sentence, keys % FEATURES, np.searchsorted(sentence, np.arange(len(sentences.starts) + 1))


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def sentences(self, sentence: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Chances of the sentences; one without words has none."""
        p = 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(sentence, self.weight[feature], minlength=n), -30, 30)))
        return np.where(np.bincount(sentence, minlength=n) > 0, p, 0.0)


def noisy_or(chances: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(chances, 1 - 1e-12)))))
    return np.clip(-np.expm1(total[first[1:]] - total[first[:-1]]), 0, 1) + 0.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Train on a bounded sample; sentences' feature ids, not texts, reach the driver."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    )

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sentences, _, feature, cut = instances(part.column("text"))
                sizes = np.diff(cut).astype("<i4")
                first = sentences.first
                feature = feature.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array([sizes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([feature[cut[a] : cut[b]].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                    ["doc_id", "label", "sizes", "features"],
                )

    # The sample has a fixed bound in rows, so it may be sent to every task; its texts are measured before any is read.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").withColumns({"key": F.xxhash64("text"), "size": F.coalesce(F.octet_length("text"), F.lit(0))})
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("key")]
    measured = rows.filter(F.col("size") <= LONGEST_BYTES).select("doc_id", "label", "key", "size").orderBy(*order).limit(2 * limit).collect()
    total = np.cumsum([0, *(r.size for r in measured)])[1:]
    picked = {(r.doc_id, r.label, r.key) for r, t in zip(measured, total.tolist(), strict=True) if t <= SAMPLE_BYTES}
    taken = docs.sparkSession.createDataFrame(sorted(picked), "doc_id long, label int, key long")
    # Rows that repeat are as many as were measured.
    found = rows.join(F.broadcast(taken), ["doc_id", "label", "key"]).select("doc_id", "label", "text").mapInArrow(bags, "doc_id long, label int, sizes binary, features binary").limit(2 * limit).collect()
    rows = sorted(found, key=lambda r: (r.doc_id, r.label, r.features))
    return train([np.frombuffer(r.sizes, "<i4") for r in rows], [np.frombuffer(r.features, "<i4") for r in rows], np.array([r.label for r in rows], float))


def train(sizes: list[np.ndarray], features: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Climb the noisy-or likelihood by adaptive gradient steps with an absolute-value penalty.

    Features of fewer than FEWEST documents are left out, so that no document is learnt by heart.
    """
    model = Model(np.zeros(FEATURES), START_BIAS)
    if not len(y) or not sum(map(len, features)):
        return model
    documents = np.zeros(FEATURES, np.int64)
    for f in features:
        documents[np.unique(f)] += 1
    known = np.flatnonzero(documents >= FEWEST)
    place = np.full(FEATURES, -1)
    place[known] = np.arange(len(known))
    size = np.concatenate(sizes).astype(np.int64)
    column = place[np.concatenate(features)]
    sentence = np.repeat(np.arange(len(size)), size)[column >= 0]
    column = column[column >= 0]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sizes])))
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    w, bias = np.zeros(len(known)), START_BIAS
    seen = np.full(len(known) + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, w[column], minlength=len(size)), -30, 30)))
        whole = np.clip(noisy_or(p, first), 1e-9, 1 - 1e-9)
        # d log-likelihood / d logit of a sentence is -p in a clean bag and p (1 - P) / P in a toxic one.
        slope = np.where(y[doc] > 0, p * (1 - whole[doc]) / whole[doc], -p)
        grad = np.bincount(column, slope[sentence], minlength=len(known))
        seen[:-1] += grad**2
        rate = 0.5 / np.sqrt(seen[:-1])
        w = w + rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        g = slope.sum()
        seen[-1] += g * g
        bias = min(bias + 0.2 * g / np.sqrt(seen[-1]), -2.0)
    model.weight[known] = w
    model.bias = bias
    return model


def score(docs: DataFrame, model: Model, columns: list[str], threshold: float = 0.5, names: tuple[str, str] = ("score", "sentences")) -> DataFrame:
    """The given columns of every row, its score, and the sentences beyond the threshold, in two columns of their own."""
    for name in names:
        if unused(name, columns) != name:
            raise ValueError(f"there is a column {name} already: give the result another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(names[0], "double").add(names[1], T.ArrayType(T.StringType()))
    text = unused("scored_text", columns)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, text):
                sentences, sentence, feature, _ = instances(part.column(text))
                p = known.sentences(sentence, feature, len(sentences.starts))
                worst: list[list[str]] = [[] for _ in range(part.num_rows)]
                bad = np.flatnonzero(p >= threshold)
                for i, d in zip(bad.tolist(), (np.searchsorted(sentences.first, bad, "right") - 1).tolist(), strict=True):
                    worst[d].append(sentences.buf[sentences.starts[i] : sentences.ends[i]].tobytes().decode().strip())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(noisy_or(p, sentences.first)), pa.array(worst, pa.list_(pa.string()))], [*columns, *names])

    return docs.select(*columns, F.col("text").alias(text)).mapInArrow(rate, schema)
