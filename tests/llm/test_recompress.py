import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.recompress import CONTEXT, FAR, Block, remove_repeats, top_boundaries
from tessera.llm.text import mix
from tests.llm.helpers import WORD, documents, empty


def brute(rows, window=13):
    first, out = {}, {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def result(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}


def test_real_documents_equal_brute_force(spark, sf_dir):
    rows, frame = documents(spark, sf_dir)
    want = brute(rows)
    assert any(x[1] for x in want.values()) and result(remove_repeats(frame)) == want
    assert remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_runs_shared_passages_and_edges(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [" ".join(rng.choice(list("abcdef"), rng.integers(10, 40))) for _ in range(6)] + ["x " * 30, "x " * 13 + "y", "y " + "x " * 12, "a b " * 20]
    rows = []
    for i in range(150):
        parts = [str(passages[j]) for j in rng.integers(0, len(passages), rng.integers(0, 4))]
        parts += [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30)))]
        rng.shuffle(parts)
        rows.append((int(rng.integers(0, 1 << 40)) if i % 3 else i, " \n".join(parts)))
    rows = list({i: (i, t) for i, t in rows}.values())
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=500)) == brute(rows)


def test_large_group_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 2 else f"own{i} {text} tail{i}") for i in range(400)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2_000)
    assert result(got) == brute(rows)
    assert {r.doc_id: r.kept_text for r in got.collect()}[2] == "own2 tail2"


def test_null_and_repeated_ids_do_not_fail(spark):
    text = " ".join("abcdefghijklmnop")
    got = remove_repeats(spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 16), ("1", 16), ("2", 0), ("None", 0)]


def test_equal_substrings_are_cut_alike():
    rng = np.random.default_rng(9)
    middle = rng.integers(0, 50, 60)
    cuts = []
    for _ in range(20):
        left, right = rng.integers(0, 50, 7), rng.integers(0, 50, 7)
        at, reach = top_boundaries(mix(np.concatenate((left, middle, right)).astype(np.uint64)), np.zeros(74, int))
        assert (reach[(reach < FAR // 2)] <= 40).all()
        cuts.append({int(a) for a, r in zip(at, reach, strict=True) if a - r >= 7 and a + r <= 67 and r <= CONTEXT})
    assert all(c == cuts[0] for c in cuts) and len(cuts[0]) > 10


@pytest.mark.parametrize("length", (13, 14, 20))
def test_passage_at_an_edge_of_one_document_and_amid_the_other(spark, length):
    """Pairs of documents, each with a passage of its own, at the start, the end or as the whole of one."""
    rng = np.random.default_rng(length)
    rows = []
    for i in range(600):
        kinds = int(rng.integers(2, 12)) if i % 2 else 1000  # few words make runs
        passage = " ".join(f"p{i}x{k}" for k in rng.integers(0, kinds, length))
        own = [" ".join(f"o{i}{side}{k}" for k in range(20)) for side in "abcd"]
        edge = (f"{passage} {own[0]}", f"{own[0]} {passage}", passage)[i % 3]
        pair = [edge, f"{own[2]} {passage} {own[3]}"]
        rng.shuffle(pair)
        rows += [(2 * i, str(pair[0])), (2 * i + 1, str(pair[1]))]
    want = brute(rows)
    assert all(want[2 * i + 1][1] >= length for i in range(600))
    assert result(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def names_of(texts, window=13):
    """The names that each distinct window gets, wherever it lies."""
    block = Block(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), window)
    starts, names = block.names()
    words, found = [WORD.findall(t) for t in texts], {}
    first = block.words.first
    for s, name in zip(starts.tolist(), names.tolist(), strict=True):
        d = int(block.doc[s])
        found.setdefault(tuple(words[d][s - first[d] : s - first[d] + window]), set()).add(name)
    return found


@given(st.lists(st.integers(0, 4), min_size=13, max_size=30), st.lists(st.tuples(st.lists(st.integers(0, 6), max_size=8), st.lists(st.integers(0, 6), max_size=8)), min_size=2, max_size=12))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_equal_names_in_any_surroundings(passage, sides):
    texts = [" ".join(map(str, [*left, *passage, *right])) for left, right in sides] + [" ".join(map(str, passage))]
    assert all(len(names) == 1 for names in names_of(texts).values())


def test_equal_windows_of_the_real_documents_have_equal_names(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert all(len(names) == 1 for names in names_of([t or "" for t in texts]).values())
