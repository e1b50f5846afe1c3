"""Record files in three tiers, scans that check what they read, partitioned level folders, reports as CSV.

Tiers name trade-offs, not formats of their own: Parquet does the encoding.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.captured import CapturedException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.metadata import file_sizes

#: Writer options by tier.
TIERS = {
    "plain": {"compression": "none"},
    "delta": {"compression": "none", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"},
    "packed": {"compression": "lz4_raw", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"},
}
RECORD = T.StructType([T.StructField("hi", T.LongType(), False), T.StructField("lo", T.LongType(), False)])


def write_records(frame: DataFrame, path: str, keys: list[str], tier: str = "packed") -> None:
    """Sorted by range of the keys, so that deltas are small and files have narrow key ranges."""
    ordered = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.options(**TIERS[tier]).parquet(path)


def open_records(spark: SparkSession, path: str, schema: T.StructType = RECORD, rows: int | None = None, size: int | None = None) -> DataFrame | None:
    """The table, or None where a file is damaged or there is none with the columns, rows or bytes asked for.

    All footers are read, in tasks, so a damaged file is found before any row is used; rows are counted from them.
    """
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path)
    except (AnalysisException, Py4JJavaError, SparkException):
        return None
    if any(f.name not in found.columns for f in schema):
        return None
    if size is not None and file_sizes(found).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] != size:
        return None
    if rows is not None and found.count() != rows:
        return None
    return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def write_levels(frame: DataFrame, path: str) -> None:
    """One folder per level and player; readers prune by both.

    Rows are dealt by range of all columns, so a large level is written by as many tasks as it has ranges.
    """
    rest = [c for c in frame.columns if c not in ("level", "player")]
    frame.repartitionByRange("level", "player", *rest).sortWithinPartitions("level", "player", *rest).write.partitionBy("level", "player").mode("append").parquet(path)


def read_levels(spark: SparkSession, path: str, level: int | None = None, player: int | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    if level is not None:
        found = found.filter(F.col("level") == level)
    return found if player is None else found.filter(F.col("player") == player)


def level_path(level: int, player: str) -> str:
    """The folder of one level and player, black or white."""
    return f"level={level}/player={player}"


def player_of(path: Column) -> Column:
    """The player that a path's folder names; null where it names none."""
    found = F.regexp_extract(path, r"(?:^|/)player=(black|white)(?:/|$)", 1)
    return F.when(found != "", found)


def concatenate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The segments' rows; older segments may lack columns, which are null there."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def evolve(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of an older layout in the new one: numeric columns that did not exist are zero."""
    have = set(frame.columns)
    return frame.select(*((F.coalesce(F.col(f.name), F.lit(0)) if f.name in have and isinstance(f.dataType, T.NumericType) else F.col(f.name) if f.name in have else F.lit(0 if isinstance(f.dataType, T.NumericType) else None)).cast(f.dataType).alias(f.name) for f in schema))


def write_report(frame: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header; nulls are blank."""
    frame.coalesce(1).write.option("header", "true").option("nullValue", "").mode("overwrite").csv(path)


def compact(spark: SparkSession, source: str, target: str, keys: list[str], rows_per_file: int = 5_000_000) -> None:
    """Rewrite many small files as fewer sorted ones."""
    spark.read.parquet(source).repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", rows_per_file).parquet(target)
