"""The numbered queries: each applies its operator to its whole table and returns every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import default_tokenizer
from tessera.llm.oracles import ORACLES
from tessera.llm.tables import new_path, read


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.recompress import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(quality.remainder("doc_id", 4) != 2), "quality")
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (quality.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import report, scan

    return report(scan(read(spark, sf_dir, "documents")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import read_token_files, with_checksum, write_token_files

    path = new_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=2)
    return with_checksum(read_token_files(spark, path))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contamination, find

    return contamination(find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))).drop("text_key")


def op6_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_copies import near_embeddings

    return near_embeddings(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), default_tokenizer(), end_id=0, capacity=2048)


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_copies import near_copies

    return near_copies(read(spark, sf_dir, "documents"), percent=75).select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality, toxicity

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(quality.remainder("doc_id", 5) != 0), "toxic")
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_text import extract

    return extract(read(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.collocations import collocations

    return collocations(read(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import hidden_markov, quality

    return hidden_markov.score(read(spark, sf_dir, "documents"), held_out=quality.remainder("doc_id", 7) == 2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repeats, op2_quality, op3_secrets, op4_token_files, op5_decontaminate, op6_embedding_copies, op7_packing, op8_near_copies, op9_toxicity, op10_html_text, op11_spelling, op12_collocations, op13_language_model, pipeline)}
