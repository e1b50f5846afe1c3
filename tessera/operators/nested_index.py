"""A hierarchy of key prefixes with offsets, and its expansion back to rows.

Every level holds its distinct prefixes in order, each with the ordinal of its first child in the level
below and the number of its children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import carry_forward, exclusive_prefix_sum, position


def leaf(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with their ordinals."""
    return position(frame.select(*keys).distinct(), keys)


def level(frame: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Distinct prefixes of the first `depth` keys with the ordinal of the first child."""
    children = frame.select(*keys[: depth + 1]).distinct().groupBy(*keys[:depth]).agg(F.count("*").alias("children"))
    return exclusive_prefix_sum(children, keys[:depth], F.col("children"), "offset")


def level_of(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """The last prefix level from leaves that have their positions: its offsets are the least of them."""
    return leaves.groupBy(*keys[:-1]).agg(F.min("position").alias("offset"), F.count("*").alias("children"))


def expand(index: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuild full keys from the last prefix level and the leaf patterns by position.

    A prefix stands before its first leaf and is carried on to the last, so no prefix, however many leaves
    it has, becomes an array or a task of its own.
    """
    owners = index.select(F.struct(*keys[:-1]).alias("__owner"), F.col("offset").alias("position"), F.lit(0).alias("__side"))
    both = owners.unionByName(leaves.select("position", keys[-1], F.lit(1).alias("__side")), allowMissingColumns=True)
    carried = carry_forward(both, ["position", "__side"], "__owner", "__last").filter("__side = 1")
    return carried.select(*(F.col(f"__last.{k}").alias(k) for k in keys[:-1]), keys[-1], "position")
