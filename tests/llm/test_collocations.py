"""Phrases against plain counting, with low limits so that every length has some."""

import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import collocations as c
from tests.llm.helpers import ascii_lower

SCHEMA = "doc_id long, text string, lang string, n long, words array<string>, kind string"


def brute(rows, longest, fewest, first):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", ascii_lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= fewest}
        gone = {q[i : i + m] for q, a in frequent.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if a >= f[q[i : i + m]]}
        scored = []
        for p, a in frequent.items():
            if p not in gone:
                score, cut = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out |= {(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:first])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, 1, ["x"], "k") for i, (lang, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("longest", "fewest", "first"), [(5, 3, 2000), (3, 8, 5)])
def test_phrases_equal_plain_counts(spark, sf_dir, longest, fewest, first):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(None, "A b A b a b,a b\ta \x01b a\x01 b"), ("en", None), ("en", ""), (None, "é ı É K é ı " * 4), ("a\nb", "one two three four five six; " * 9), ("de", " . ,x" * 5), ("en", "y" * 70_000 + " z")]
    rows += [("und", "a b a \x01 a b"), ("xx", "same same same same same same same same same same")]
    got = [tuple(r) for r in c.collocations(frame(spark, rows), longest, fewest, first).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, longest, fewest, first)


def test_without_rows_or_candidates(spark):
    assert c.collocations(frame(spark, [("en", "a b")]).limit(0)).count() == 0
    assert c.collocations(frame(spark, [("en", "a b"), (None, None)])).count() == 0


def test_large_products_are_exact(spark):
    big = (1 << 40) + 7
    row = spark.createDataFrame([(["a", "b"], big, big + 5, big + 3, big * 3)], "words array<string>, n long, front1 long, back1 long, front0 long")
    assert row.select(c._score(1, 2).alias("s")).first().s == 1000 * big * big * 3 // ((big + 5) * (big + 3))


def test_a_filter_that_lets_all_pass_changes_nothing(spark, monkeypatch):
    rows = [("en", "a b c d e. x y " * 20), ("fr", "a b c d e. y x " * 20)]
    monkeypatch.setattr(c, "FILTER_BITS", 64)
    assert {tuple(r) for r in c.collocations(frame(spark, rows), 5, 10, 100).collect()} == brute(rows, 5, 10, 100)
