"""The language model against a plain forward recursion, plain counts, and sums over all texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hidden_markov as h
from tessera.llm.quality import remainder
from tests.llm.helpers import WORD, ascii_lower, documents, empty


def tokens(text):
    return [ascii_lower(w) for w in WORD.findall(text or "")] + [""]


def test_scores_of_odd_documents(spark, sf_dir, monkeypatch):
    rows, docs = documents(spark, sf_dir)
    rows.append((None, "a b unheard"))
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], docs.schema)
    kept = {}
    for name in ("dictionary", "train"):
        monkeypatch.setattr(h, name, lambda *a, f=getattr(h, name), name=name: kept.setdefault(name, f(*a)))
    got = h.score(docs, remainder("doc_id", 7) == 2, states=3, words=400, rounds=2).collect()
    assert len(got) == len(rows)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(t for i, text in rows if not held[i] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    book, (model, logs) = kept["dictionary"], kept["train"]
    assert logs[1] > logs[0]
    inside = {"": h.END} | {w: k + 2 for k, w in enumerate(book.words)}
    tail = [w for w in count if w not in inside]
    share = sum(count[w] for w in tail) + len(tail) + 1
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and math.isclose(sum((count[w] + 1) / share for w in tail) + 1 / share, 1)
    by_row = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6), r.held_out, r.train_tokens) for r in got)
    want = []
    for i, text in rows:
        words = tokens(text)
        now, log = model.start, 0.0
        for k, w in enumerate(words):
            now = (now @ model.move if k else now) * model.emit[inside.get(w, h.TAIL)]
            log += math.log10(now.sum()) + (0 if w in inside else math.log10((count[w] + 1) / share))
            now = now / now.sum()
        want.append((str(i), len(words), sum(count[w] > 0 for w in words), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), 6), round(log, 6), held[i], n))
    for a, b in zip(by_row, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[5:] == b[5:] and a[3:5] == pytest.approx(b[3:5], abs=1e-5)


def test_without_rows_or_training_documents(spark):
    assert h.score(empty(spark), remainder("doc_id", 7) == 2).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = h.score(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r.score <= 0 for r in got)


def test_rounds_climb_and_equal_plain_sums():
    rng = np.random.default_rng(1)
    model = h.Model(*(x / x.sum(-1, keepdims=True) for x in (rng.random(2) + 0.1, rng.random(2) + 0.1, rng.random((2, 2)) + 0.1)), np.zeros((4, 2)))
    model.emit = rng.random((4, 2)) + 0.1
    model.emit /= model.emit.sum(0)
    ids, first = np.array([2, 3, 2, 0, 3, 0, 0]), np.array([0, 4, 6, 7])
    total = h.Expected(model)
    total.add(ids, first)
    emit, move, start, log = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        paths = np.array(np.meshgrid(*[[0, 1]] * n, indexing="ij")).reshape(n, -1).T
        chance = np.array([model.start[p[0]] * model.emit[ids[a], p[0]] * np.prod([model.move[p[t - 1], p[t]] * model.emit[ids[a + t], p[t]] for t in range(1, n)]) for p in paths])
        log += math.log(chance.sum())
        for p, c in zip(paths, chance / chance.sum(), strict=True):
            start[p[0]] += c
            for t in range(n):
                emit[ids[a + t], p[t]] += c
                move[p[t - 1], p[t]] += c * (t > 0)
    for got, want in ((total.emit, emit), (total.move, move), (total.start, start), (total.log, log)):
        assert np.allclose(got, want, rtol=1e-4)
    assert np.allclose(h.forward(model, ids, first).sum(), log / math.log(10))


def test_long_documents_train_in_stretches():
    begin, size, opens = h.stretches(np.array([0, 5, 5, 130]), 64)
    assert sorted(zip(begin.tolist(), size.tolist(), opens.tolist(), strict=True)) == [(0, 5, True), (5, 64, True), (69, 61, False)]


def test_states_beat_single_words_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = h.score(docs, remainder("doc_id", 7) == 2).filter("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r.model > 0.97 * r.base
