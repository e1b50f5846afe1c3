import glob
import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.bpe import default_tokenizer
from tessera.llm.packing import pack, plan
from tessera.llm.tables import new_path
from tessera.llm.token_files import read_token_files, with_checksum, write_token_files
from tests.llm.helpers import documents, empty


TOKENIZER = Tokenizer.from_file(default_tokenizer())


def ids_of(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, sf_dir):
    rows, frame = documents(spark, sf_dir)
    path = new_path(spark, "test")
    write_token_files(frame, path, default_tokenizer(), 2)
    back = read_token_files(spark, path)
    stored = {r.doc_id: r for r in back.collect()}
    digests = {r.doc_id: r.ids_crc32 for r in with_checksum(back).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        want = ids_of(text, 2)
        assert stored[doc_id].ids == want and stored[doc_id].start == start and stored[doc_id].n_tokens == len(want)
        assert digests[doc_id] == crc(want)
        start += len(want)
    assert len(stored) == len(rows)


def test_token_files_repeated_ids_and_empty_table(spark):
    path = new_path(spark, "test")
    write_token_files(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c"), (0, None)], "doc_id long, text string"), path, default_tokenizer(), 2)
    got = sorted((r.start, r.n_tokens) for r in read_token_files(spark, path).collect())
    assert got == [(0, 3), (3, 1), (4, 2), (6, 2)]
    path = new_path(spark, "test")
    write_token_files(empty(spark), path, default_tokenizer(), 2)
    assert with_checksum(read_token_files(spark, path)).count() == 0


def test_packing_places_every_piece_once(spark, sf_dir):
    rows, frame = documents(spark, sf_dir)
    got = pack(frame, default_tokenizer(), 0, 256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in rows:
        want, at = ids_of(text, 0), 0
        for i, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and r.ids_crc32 == crc(want[at : at + 256]) and r.length == len(want[at : at + 256])
            at += r.length
        assert at == len(want)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.02 * total / 256 + 1
    assert pack(empty(spark), default_tokenizer(), 0, 256).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 2049, 20_000), np.full(9_999, 683), np.minimum(2048, rng.lognormal(6, 1.2, 30_000).astype(int) + 1), np.full(7, 2048)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        rows = plan(histogram, 2048)
        placed = {}
        for length, a, b, *_ in rows:
            placed.setdefault(length, []).append((a, b))
        for length, n in histogram.items():
            at = 0
            for a, b in sorted(placed[length]):
                assert a == at
                at = b
            assert at == n
        used = max(first + -(-(b - a) // per) for _, a, b, per, first, _ in rows)
        large = int((lengths > 1024).sum())
        assert used <= 1.02 * max(lengths.sum() / 2048, large, len(lengths) / 2 * (lengths.min() > 682)) + 1
    assert plan({}, 2048) == []


def test_files_hold_bloom_filters_and_row_indexes(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, f"{tmp_path}/ids", default_tokenizer(), end_id=2, shards=3)
    files = glob.glob(f"{tmp_path}/ids/*.orc")
    assert files
    java = spark._jvm.org.apache
    for name in files:
        reader = java.orc.OrcFile.createReader(java.hadoop.fs.Path(name), java.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        rows, kinds = reader.rows(), set()
        for stripe in reader.getStripes():
            kinds |= {(s.getColumn(), s.getKind().toString()) for s in rows.readStripeFooter(stripe).getStreamsList()}
        assert (2, "BLOOM_FILTER_UTF8") in kinds and (2, "ROW_INDEX") in kinds  # column 2 is doc_id
    one = read_token_files(spark, f"{tmp_path}/ids").filter("doc_id = 7")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "NestedLoop" not in plan
