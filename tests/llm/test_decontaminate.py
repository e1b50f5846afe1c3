import hashlib

from tessera.llm import decontaminate
from tessera.llm.decontaminate import contamination, find
from tests.llm.helpers import ITEM_WORD, ascii_lower, documents, empty


def words(text):
    return ITEM_WORD.findall(ascii_lower(text or ""))


def brute(rows, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in rows:
        w, hit, names = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        joined = ",".join(sorted(names))
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def result(frame):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(frame).collect()}


def cases(spark, sf_dir):
    rows, _ = documents(spark, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "..."), (903, "a b"), (904, items[0][1]), (905, "A B"), (906, "naïve CAFÉ")]
    text = items[0][1]
    rows += [(20_000, "lead-in " + text.upper() + " and " + text), (20_001, " ".join(text.split()[:12])), (20_002, " ".join(text.split()[1:14]))]
    return rows, items


def test_contamination_equals_brute_force(spark, sf_dir):
    rows, items = cases(spark, sf_dir)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert any(x[4] for x in want.values()) and result(find(docs, bench)) == want


def test_benchmark_beyond_one_chunk(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 4_000)
    rows, items = cases(spark, sf_dir)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(find(docs, bench)) == brute(rows, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(find(empty(spark), none)) == {}
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert result(find(docs, none)) == brute([(1, "a b c")], [])


def test_rows_keep_their_own_spans_whatever_the_benchmark_size(spark, monkeypatch):
    """Null and repeated doc_ids with equal word counts stay apart when passes are merged."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(60)]
    rows = [(None if k % 2 else 7, f"{t} tail{k}") for k, t in items] + [(None, "no item here")] * 3
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def every():
        return sorted(map(str, contamination(find(docs, bench)).collect()))

    want = every()
    assert len(want) == 63
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 3_000)
    assert every() == want


def test_copies_of_an_item_do_not_fill_a_chunk(spark, monkeypatch):
    items = [(1, " ".join(f"same{j}" for j in range(30)))] * 100 + [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(2, 40)]
    rows = [(k, t) for k, t in items[99:]]
    sizes, index = [], decontaminate.Index

    def watched(texts, window):
        sizes.append(sum(map(len, texts)))
        return index(texts, window)

    monkeypatch.setattr(decontaminate, "Index", watched)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 4_000)
    got = result(find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(rows, items) and len(sizes) > 1 and max(sizes) <= 2 * 4_000
