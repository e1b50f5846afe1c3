"""Token-id files: ORC stripes with run-length encoded ids, row indexes and Bloom filters on doc_id.

Documents are dealt by range of doc_id, so file order is doc_id order; each task tokenises its
range and keeps a running token offset, so a document's place in the whole stream is its shard's
base plus its offset there and no global sort or single-task window over documents is needed.

Null or empty texts hold the end id alone.  Rows with a null doc_id come first; rows that share a
doc_id follow each other in the order of their texts' hashes.  Other input columns are ignored.
An empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder
from tessera.llm.text import slices

FILE_SCHEMA = T.StructType(
    [T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("shard_offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)
TOKEN_SLICE = 3 << 20
#: Text of one file at most, about, unless one document has more; small inputs have a file for each shuffle partition.
SHARD_BYTES = 256 << 20


def encode_with_end(tokenizer: str, end_id: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids with end_id after each text, and the row offsets."""
    ids, counts = encoder(tokenizer).encode(texts)
    offsets = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(offsets[-1], end_id, np.int32)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = ids
    return out, offsets


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Tokenise (doc_id, text) and write ORC files in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", TOKEN_SLICE):
                flat, offsets = encode_with_end(tokenizer, end_id, part.column("text"))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), part.column("doc_id").cast(pa.int64()), pa.array(done + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                    ["shard", "doc_id", "shard_offset", "n_tokens", "ids"],
                )
                done += int(offsets[-1])

    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (
        ordered.select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows (doc_id, start, n_tokens, ids); start counts the ids of all documents before.

    Shard totals come from the narrow columns alone; there is one row of them per file, so one task sums them up.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row per file, of 12 bytes: as many as the shards of the write, so they may go to every task.
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("shard_offset")).alias("start"), "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """Replace ids by the unsigned CRC-32 of their little-endian 32-bit form."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            at = lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
