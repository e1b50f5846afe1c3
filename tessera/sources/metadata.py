"""Counts and key ranges of a table from file footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def footer_summary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(records, min_key, max_key).  With aggregate push-down only footers are read.

    The settings for that are those of a session of its own, so queries of the given one do not see them.
    """
    reader = spark.newSession()
    reader.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    reader.conf.set("spark.sql.sources.useV1SourceList", "")
    return reader.read.parquet(path).agg(F.count("*").alias("records"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def file_sizes(frame: DataFrame) -> DataFrame:
    """(file, bytes) of the files that a table is read from; none of their columns is."""
    return frame.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
