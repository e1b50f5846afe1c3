"""From raw documents to packed sequences: the training-data operators one after the other.

Each stage gets all that the one before kept, as a written table.  A filtering stage removes the rows it
decides against and leaves every other row as it was, whatever the length of its text; rows without a doc_id
are never copies or contaminated.  Rows that repeat are judged alike.  Columns of documents are passed on
under their names, which may be any.  An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import decontaminate, near_copies, packing, quality, secrets
from tessera.llm.bpe import default_tokenizer
from tessera.llm.tables import drop, new_path, read, temporary_tables, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores below 0.7; null and empty texts get the mean label."""
    labels = read(spark, sf_dir, "labels").filter(quality.remainder("doc_id", 4) != 2)
    model = quality.fit(docs, labels, "quality")
    name = unused("score", docs.columns)
    return quality.score(docs, model, docs.columns, name).filter(F.col(name) >= 0.7).select(*docs.columns)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents but for those found by doc_id and text: another text under the same doc_id stays."""
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep the document with the smallest doc_id.

    Rows that share a doc_id are judged by their own texts; rows of one doc_id and text stay or go together.
    """
    return _without(docs, near_copies.near_copies(docs, percent=75).filter("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth or more lies in benchmark windows; null and empty texts stay."""
    found = decontaminate.contamination(decontaminate.find(docs, read(spark, sf_dir, "benchmark")))
    return _without(docs, found.filter("contaminated"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, null and empty texts as they are.

    Where a text was changed, n_chars, if there is such a column of whole numbers, counts it anew.
    """
    changed = unused("changed", docs.columns)
    hidden = secrets.redact(docs, changed)
    if "n_chars" in docs.columns and isinstance(kind := docs.schema["n_chars"].dataType, T.IntegralType):
        hidden = hidden.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return hidden.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 2048 tokens; a null text counts as empty and is the end id alone."""
    return packing.pack(docs, default_tokenizer(), end_id=0, capacity=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_copies", keep_one_copy),
    ("decontaminate", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]
#: No SQL for a model, a tokenizer and a packing plan; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; what a stage wrote in between, and its input, are deleted once its result is stored."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop(before)
        docs = before = spark.read.parquet(path)
    return docs
