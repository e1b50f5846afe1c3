"""Counts of strings over a corpus as sorted streams.

A task adds up what it sees in a run of at most FLUSH distinct keys and sends it as a few sorted streams,
one per bucket, which take a fraction of the bytes that a row per key would.  The streams of a bucket
are read out again and added up by Spark, which spills where it must.  A key that is everywhere is one
entry per run, and buckets are dealt by a hash of the key, so no key and no beginning of keys is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import U64, Words, text_bytes

#: Keys, before they are added up, that a task holds at most.
FLUSH = 800_000
#: Bytes of keys likewise, but for one longer slice of text.
FLUSH_BYTES = 32 << 20
#: Buckets for each partition of a shuffle.
BUCKETS = 2
#: Streams of one kind and bucket: keys in order, one to a line, and their counts.
SCHEMA = "kind string, bucket int, keys string, counts array<long>"


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    buf, offsets = text_bytes(keys)
    return Words(buf, offsets[:-1], offsets[1:], np.arange(len(offsets)), offsets).hashes()


class Counter:
    """Adds up counts of keys by kind; keys hold no line feed."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.held: list[pa.Table] = []
        self.rows = self.bytes = 0

    def add(self, kind: str, keys: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        bucket = (key_hashes(keys) % U64(self.buckets)).astype(np.int32)
        kinds = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), pa.array([kind], pa.string())).cast(pa.string())
        self.held.append(pa.table({"kind": kinds, "bucket": pa.array(bucket), "key": keys.cast(pa.large_string()), "n": pa.array(counts, pa.int64())}))
        self.rows, self.bytes = self.rows + len(keys), self.bytes + keys.nbytes
        if self.rows >= FLUSH or self.bytes >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        table = pa.concat_tables(self.held).group_by(["kind", "bucket", "key"], use_threads=False).aggregate([("n", "sum")])
        self.held, self.rows, self.bytes = [], 0, 0
        table = table.take(pc.sort_indices(table, [("kind", "ascending"), ("bucket", "ascending"), ("key", "ascending")])).combine_chunks()
        bucket = table["bucket"].to_numpy()
        kind = table["kind"].combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else bucket
        cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]), [True])))
        first = pa.array(cut[:-1])
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _one(table["key"]).cast(pa.string()))
        counts = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), _one(table["n_sum"]))
        yield pa.RecordBatch.from_arrays([_one(table["kind"]).take(first), _one(table["bucket"]).take(first), pc.binary_join(lists, "\n"), counts], ["kind", "bucket", "keys", "counts"])


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def buckets_for(frame: DataFrame) -> int:
    return BUCKETS * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def merged(streams: DataFrame) -> DataFrame:
    """(kind, key, n) of all streams; one shuffle, of the streams."""
    each = streams.repartition("bucket").select("kind", "bucket", F.explode(F.arrays_zip(F.split("keys", "\n").alias("key"), F.col("counts").alias("n"))).alias("each"))
    return each.groupBy("bucket", "kind", F.col("each.key").alias("key")).agg(F.sum("each.n").alias("n")).select("kind", "key", "n")
