import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_copies, near_copies
from tessera.llm.components import components
from tests.llm.helpers import WORD, ascii_lower, documents, empty


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_documents(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall(ascii_lower(text or ""))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for group in by.values() for a in group for b in group if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {d: (len(sets[d]), found[d], found[d] == d) for d in sets}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (502, 502)]
    pairs += [tuple(map(int, p)) for p in rng.integers(1_000, 1_300, (250, 2))]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    want = roots({i for p in pairs for i in p}, pairs)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_real_documents_equal_brute_force(spark, sf_dir):
    rows, frame = documents(spark, sf_dir)
    assert result(near_copies.near_copies(frame)) == brute_documents(rows)
    assert near_copies.near_copies(empty(spark)).count() == 0


def planted(seed, groups, size, words=60):
    """Groups of near copies, some around the threshold, over texts that share one long passage."""
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(size):
            w = list(base)
            for j in rng.integers(0, words, rng.integers(0, 3)):
                w[j] = f"x{rng.integers(1 << 30)}"
            rows.append(" ".join(w) + (" " + passage if g % 2 else ""))
    rows += [passage + f" own{i}" for i in range(5)] + ["one two", "ONE two", "three", "", "a b c d", "a b c d e"]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("groups", "size", "limits"), [(30, 6, {}), (3, 60, {}), (6, 40, {"NODE": 12, "FEW": 2}), (6, 40, {"NODE": 12, "FEW": 2, "DEPTH": 1}), (6, 40, {"LOAD": 900, "FEW": 3})])
def test_planted_groups_equal_brute_force(spark, monkeypatch, groups, size, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    rows = planted(groups, groups, size)
    assert result(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_documents(rows)


def test_recall_of_links_near_the_threshold(spark, monkeypatch):
    """Pairs with similarities from 0.75 to 0.8 over a passage that makes every first node large."""
    monkeypatch.setattr(near_copies, "NODE", 40)
    monkeypatch.setattr(near_copies, "FEW", 2)
    passage = [f"p{i}" for i in range(36)]
    rows = []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(12)]
        rows += [(2 * g, " ".join(passage + own)), (2 * g + 1, " ".join(passage + own[:8] + [f"h{g}w{i}" for i in range(3)]))]
    want = brute_documents(rows)
    got = result(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    linked = [d for d in want if want[d][1] != d]
    assert linked and np.mean([got[d] == want[d] for d in linked]) >= 0.99


def test_signatures_that_agree_in_too_few_places(spark):
    """At the threshold of 0.75, half of the places is missed by far less than one pair in a thousand."""
    rng = np.random.default_rng(8)
    agree = (rng.random((200_000, near_copies.SIGNATURE)) < 0.75).mean(1)
    assert (agree < near_copies.LEAST_AGREEMENT).mean() < 1e-4


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "A B C D E F")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("3", "1", False), ("None", "None", True)]


def test_rows_of_one_id_keep_their_own_texts(spark):
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "one two three four five six")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True)]


def test_half_alike_sets_are_told_apart_in_bounded_time():
    """A full node of sets that share half of their shingles and are not linked, and some that are."""
    rng = np.random.default_rng(7)
    shared = rng.integers(0, 1 << 63, 128, dtype=np.uint64)
    found = [np.sort(np.concatenate((shared, rng.integers(0, 1 << 63, 128, dtype=np.uint64)))) for _ in range(near_copies.NODE - 40)]
    found += [np.sort(np.concatenate((f[:240], rng.integers(0, 1 << 63, 16, dtype=np.uint64)))) for f in found[:40]]
    batch = pa.RecordBatch.from_pydict({"node": np.zeros(len(found), np.int64), "cid": np.arange(len(found)), "set": [f.tobytes() for f in found]})
    begun = time.process_time()
    got = pa.Table.from_batches(list(near_copies._compare(75)(iter([batch])))).to_pydict()
    assert time.process_time() - begun < 60
    assert {frozenset(p) for p in zip(got["a"], got["b"], strict=True)} == {frozenset((i, near_copies.NODE - 40 + i)) for i in range(40)}


def test_only_texts_that_are_compared_are_shuffled(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(2000)]
    rows += [(3000 + i, rows[i][1] + " more") for i in range(20)] + [rows[5]] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    wanted = docs.filter("doc_id < 20 OR doc_id >= 3000").select("doc_id", "text_key").distinct()
    picked = near_copies._wanted_texts(docs, wanted)
    assert {r.doc_id for r in wanted.collect()} <= {r.doc_id for r in picked.collect()} and picked.count() < 60
    got = result(near_copies.near_copies(docs.drop("text_key")))
    assert all(got[3000 + i][1] == i for i in range(20)) and sum(not v[2] for v in got.values()) == 20


def brute_vectors(rows):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    ids = list(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    found = roots([i for i, _ in rows], links)
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (degree[i], found[i], found[i] == i) for i, _ in rows}


@pytest.mark.parametrize("chunk", [4096, 40])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_copies, "CHUNK", chunk)
    monkeypatch.setattr(embedding_copies, "LEAF", 64)
    monkeypatch.setattr(embedding_copies, "BLOCK", 30)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = [b + rng.normal(size=16) * s for b in base[:40] for s in (0.05, 0.1, 0.2, 0.3)]
    hot = [base[50] + rng.normal(size=16) * 0.02 for _ in range(150)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near, *hot])]
    rows += [(1_000 + i, rows[60][1]) for i in range(90)]
    rows += [(2_000, None), (2_001, []), (2_002, [0.0] * 16), (2_003, [float("nan")] * 16), (2_004, [None] * 16), (2_005, [1.0] * 8), (2_006, [2.0] * 8), (2_007, [float("inf")] + [1.0] * 15)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_copies.near_embeddings(frame).collect()}
    want = brute_vectors(rows)
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and missed <= 0.01 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1:] == want[i][1:] for i in want]) > 0.99
    assert embedding_copies.near_embeddings(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("classes", "copies"), [(50_000, 16), (1_000_000, 26)])
def test_forest_recall_and_copies_at_the_threshold(classes, copies):
    """Pairs of 64 numbers at a cosine of 0.9 meet in a leaf, and vectors lie in a bounded number of leaves."""
    rng = np.random.default_rng(6)

    def unit(n):
        x = rng.normal(size=(n, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    forest = embedding_copies.grow(unit(6_000), classes, 64)
    a, b = unit(400), unit(400)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = []
    for x in (a, b):
        row, leaf = forest.leaves(x)
        met.append([set(leaf[row == i]) for i in range(len(x))])
    assert np.mean([bool(p & q) for p, q in zip(*met, strict=True)]) >= 0.98
    assert np.mean([len(p) for p in met[0]]) <= copies


def test_cosines_at_the_threshold_are_told_in_double_precision():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = x @ x.T
    for threshold in exact[np.triu_indices(60, 1)][:40]:
        assert (embedding_copies._near(x, x, threshold + 1e-12) == (exact >= threshold + 1e-12)).all()


def clustered(n, dim=64, cosine=0.97, seed=9):
    """Unit vectors of which a third are near one direction, so that two of these have about the cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    hot = n // 3
    x[:hot] = rng.normal(size=dim) / np.sqrt(dim) * np.sqrt(cosine) + rng.normal(size=(hot, dim)) / np.sqrt(dim) * np.sqrt(1 - cosine)
    return x / np.linalg.norm(x, axis=1, keepdims=True), hot


@pytest.mark.parametrize("cosine", [0.97, 0.93])
def test_a_dense_group_does_not_multiply(spark, cosine):
    x, hot = clustered(20_000, cosine=cosine)
    order = np.random.default_rng(1).permutation(len(x))
    centres, dense = embedding_copies.cores(x[order], 0.9)
    if cosine == 0.97:
        assert dense.sum() >= 0.9 * hot and len(centres) == 1
    for classes in (20_000, 1_000_000, 100_000_000):
        forest = embedding_copies.grow(x[order][~dense], classes, 64)
        row, _ = forest.leaves(np.concatenate((x[:300], x[-300:])))
        copies = np.bincount(row, minlength=600)
        assert copies[:300].mean() < 2 * copies[300:].mean(), (classes, copies[:300].mean(), copies[300:].mean())
    if cosine == 0.97:
        frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
        got = {r.vec_id: r for r in embedding_copies.near_embeddings(frame).collect()}
        want = np.concatenate([(x[a : a + 2000] @ x.T >= 0.9).sum(1) - 1 for a in range(0, len(x), 2000)])
        assert all(got[i].n_links == want[i] for i in range(hot)) and all(got[i].component_id == 0 for i in range(hot))
        assert np.mean([got[i].n_links == want[i] for i in range(len(x))]) > 0.999


def test_members_of_a_core_are_surely_linked():
    rng = np.random.default_rng(3)
    for threshold in (0.9, 0.5, 0.0, -0.5):
        near = embedding_copies.core_cosine(threshold)
        centre = np.eye(8)[0]
        side = rng.normal(size=(500, 8)) * (np.arange(8) > 0)
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        x = near * centre + np.sqrt(1 - near**2) * np.concatenate((side, -side))  # on the rim, some opposite each other
        assert (x @ x.T).min() >= threshold


def test_near_cores_are_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(embedding_copies, "CHUNK", 30)
    rng = np.random.default_rng(5)
    a = rng.normal(size=16)
    b = a + rng.normal(size=16) * 0.6
    rows = [(i, (c + rng.normal(size=16) * 0.1).tolist()) for i, c in enumerate([a, b, -a] * 100)]
    assert len(embedding_copies.cores(np.array([np.array(v) / np.linalg.norm(v) for _, v in rows]), 0.9)[0]) >= 3
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_copies.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_vectors(rows)


def test_doubles_of_any_size(spark):
    rows = [(i, [s, s * k]) for i, (s, k) in enumerate([(1e200, 1.0), (1e200, 1.01), (1e-200, 1.0), (5e-324, 1.0), (1.7e308, 1.0), (1e200, -1.0), (3.0, 3.0)])]
    got = {r.vec_id: r.n_links for r in embedding_copies.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(v) / max(map(abs, v)) for _, v in rows]
    unit = np.array([v / np.linalg.norm(v) for v in unit])
    assert got == dict(enumerate(((unit @ unit.T >= 0.9).sum(1) - 1).tolist()))
