"""Near words against plain edit distances, on ordinary words and where every node must be dealt again."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import spelling
from tessera.llm.streams import SCHEMA, merged
from tessera.llm.streams import Counter as Streams
from tests.llm.helpers import ascii_lower, documents, empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def cut(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return (len(a) == len(b) + 1 and b in cut(a)) or (len(b) == len(a) + 1 and a in cut(b))


def brute(words):
    near = {w: [] for w in words}
    by_key = {}
    for w in words:
        for k in {w} | cut(w):
            by_key.setdefault(k, []).append(w)
    for same in by_key.values():
        for a in same:
            near[a] += [b for b in same if a != b and is_near(a, b)]
    out = {}
    for w, n in words.items():
        found = set(near[w])
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(found), words[form] if form else None]
    for w in words:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def plain(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_of_odd_documents(spark, sf_dir):
    rows, docs = documents(spark, sf_dir)
    rows = rows + [(None, "naïveté Naïveté NAïVETé naïvete × naïvete naïvete " * 3), (7, "éàüöß " * 3 + "éàüöx " * 9)]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], docs.schema)
    assert plain(spelling.spelling_variants(docs)) == brute(words_of(rows))
    assert spelling.spelling_variants(empty(spark)).count() == 0


@pytest.mark.parametrize("node", [2, 5])
def test_nodes_dealt_again_and_again_lose_and_double_nothing(spark, monkeypatch, node):
    monkeypatch.setattr(spelling, "NODE", node)
    rng = np.random.default_rng(3)
    words = {"ab" + "".join(rng.choice(list("abé"), rng.integers(3, 8))): int(rng.integers(3, 40)) for _ in range(400)}
    words |= {"a" * k: 3 + k for k in range(5, 30)} | {"x" * 300: 4, "x" * 301: 9, "x" * 150 + "y" + "x" * 149: 3}
    found = spelling.near(spark.createDataFrame(list(words.items()), "word string, n long"))
    want = {w: (v[3], min((b for b in words if is_near(w, b)), key=lambda b: (-words[b], b))) for w, v in brute(words).items() if v[3]}
    assert {r.word: (r.n_near, r.best) for r in found.collect()} == want


def test_chains_of_forms_lead_to_the_last(spark):
    names = ["w" * k for k in range(5, 30)]
    forms = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == dict.fromkeys(names[:-1], names[-1])
    assert spelling.roots(forms.limit(0)).count() == 0


def test_hashes_of_spans():
    buf = np.frombuffer("12:abcé".encode() + b"q" * 90, np.uint8)
    starts, ends = np.array([3, 0, 8, 8]), np.array([8, 3, 98, 9])
    before = np.array([zlib.crc32(b"12:"), 0, 5, zlib.crc32(b"x")], np.uint32)
    want = [zlib.crc32(buf[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before, strict=True)]
    assert spelling.crcs(buf, starts, ends, before).tolist() == want


def test_streams_add_up(spark, monkeypatch):
    from tessera.llm import streams

    monkeypatch.setattr(streams, "FLUSH", 3)
    counter = Streams(4)
    batches = [b for kind, keys, n in (("x", ["", "b", "ä"], [1, 2, 3]), ("y", ["b"], [5]), ("x", ["b", ""], [7, 1 << 40])) for b in counter.add(kind, pa.array(keys), np.array(n))] + list(counter.flush())
    assert len(batches) == 2 and not list(counter.flush())
    frame = spark.createDataFrame(pa.Table.from_batches(batches).to_pylist(), SCHEMA)
    assert sorted(map(tuple, merged(frame).collect())) == [("x", "", (1 << 40) + 1), ("x", "b", 9), ("x", "ä", 3), ("y", "b", 5)]
