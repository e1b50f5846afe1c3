import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.queries import op2_quality, op9_toxicity
from tests.llm.helpers import documents, empty

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "modulus", "rest", "threshold", "least"), [(op2_quality, "quality", 4, 2, 0.7, 0.95), (op9_toxicity, "toxic", 5, 0, 0.5, 0.88)])
def test_held_out_accuracy(spark, query, label, modulus, rest, threshold, least):
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in truth if got[d].held_out]
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    right = sum(got[d].predicted == truth[d] for d in held)
    assert right >= least * len(held), (right, len(held))


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, sf_dir, module, label):
    rows, frame = documents(spark, sf_dir)
    labels = spark.createDataFrame([(i, i % 2, i % 2, None) for i, _ in rows[:60]] + [(None, 1, 1, None), (3, None, 7, None)], "doc_id long, quality int, toxic int, text string")
    model = module.fit(frame, labels, label)
    got = {r.doc_id: r.score for r in module.score(frame, model, ["doc_id", "rank"]).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert got[10_000] == got[10_001] == got[10_002]
    assert module.score(empty(spark), model, ["doc_id"]).count() == 0
    untrained = module.fit(frame, labels.limit(0), label)
    assert module.score(frame, untrained, ["doc_id"]).count() == len(rows)


def test_repeated_documents_score_alike(spark):
    text = "Some text that is here.\nyou idiot clown! Fine words."
    frame = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        scores = {r.score for r in module.score(frame, module.fit(frame, labels, label), ["doc_id"]).collect()}
        assert len(scores) == 1


def test_offending_sentences_are_located(spark):
    clean = [f"word{i} text here. nothing wrong{i} at all" for i in range(200)]
    toxic = [f"word{i} text here. you awful idiot{'' if i % 2 else 's'}. nothing wrong{i}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    for r in got:
        assert (r.score >= 0.5) == (r.doc_id >= 200)
        assert len(r.sentences) == int(r.doc_id >= 200) and all("idiot" in s for s in r.sentences)


def test_term_weights_count_all_documents(spark):
    """Documents without a label count in the inverse document frequencies."""
    texts = [f"Plain words {i} here." for i in range(20)] + ["A-B-C # 12:30 !? [x]"] * 60 + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    offsets, terms, _, _ = quality.term_counts(pa.array(texts, pa.string()))
    frequency = np.bincount(terms, minlength=quality.TERMS)
    weight = quality.fit(docs, labels).weight
    share = np.where(np.arange(quality.TERMS) < quality.SHAPES, 1, quality.WORD_WEIGHT)
    assert np.allclose(weight, share * np.where(frequency > 0, np.log((1 + len(texts)) / (1 + frequency)) + 0.3, 0))
    assert (weight[terms[offsets[20] :]] > 0).all()


def test_votes_equal_a_plain_count(spark, sf_dir):
    """Every document against every labelled vector, one by one."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    for r in docs.select("doc_id", "text").collect():
        vector = model.embed(*quality.term_counts(pa.array([r.text]))[:3])[0].astype(float)
        cosines = sorted(((float(v @ vector), y) for v, y in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)
        votes = [(max(c, 0) ** 8 + 1e-9, y) for c, y in cosines[: quality.NEIGHBOURS]]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if np.abs(vector).sum() else model.prior
        # Neighbours that are equally near the last place may differ.
        assert abs(got[r.doc_id] - want) < 1e-3 or abs(cosines[quality.NEIGHBOURS - 1][0] - cosines[quality.NEIGHBOURS][0]) < 1e-6


def test_noisy_or_equals_a_plain_product(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for r in docs.select("doc_id", "text").collect():
        clean = 1.0
        for sentence in re.split(r"[\n!.?]", r.text or ""):
            _, which, feature, _ = toxicity.instances(pa.array([sentence]))
            if len(which):
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + model.weight[feature].sum())))
        assert abs(got[r.doc_id] - (1 - clean)) < 1e-9


def test_names_of_results_may_be_chosen_and_must_be_free(spark):
    frame = spark.createDataFrame([(1, "Some text.", 5, "x")], "doc_id long, text string, score int, sentences string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    with pytest.raises(ValueError, match="score"):
        quality.score(frame, quality.fit(frame, labels), frame.columns)
    assert quality.score(frame, quality.fit(frame, labels), frame.columns, "rating").first().score == 5
    with pytest.raises(ValueError, match="sentences"):
        toxicity.score(frame, toxicity.fit(frame, labels), ["doc_id", "sentences"])
    row = toxicity.score(frame, toxicity.fit(frame, labels), frame.columns, names=("chance", "offending")).first()
    assert row.sentences == "x" and 0 <= row.chance <= 1


def test_sample_of_repeated_documents_is_bounded_in_order(spark):
    docs = spark.createDataFrame([(i % 5, f"Text {i}.") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    few = quality.labelled_counts(docs, labels, "quality", limit=3)
    assert len(few) == 6 and few == quality.labelled_counts(docs.repartition(7), labels, "quality", limit=3)


def test_the_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    texts = ["bad thing. " * (1 + i % 3) for i in range(40)] + ["bad thing. " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda sizes, features, y: taken.append((len(y), sum(map(len, sizes)))))
    for total, longest in ((1 << 20, 1 << 20), (1 << 20, 100), (200, 100), (0, 100)):
        monkeypatch.setattr(toxicity, "SAMPLE_BYTES", total)
        monkeypatch.setattr(toxicity, "LONGEST_BYTES", longest)
        toxicity.fit(docs, labels)
    a, b, c, d = (n for n, _ in taken)
    assert (a, b, d) == (41, 40, 0) and 5 <= c < 20
