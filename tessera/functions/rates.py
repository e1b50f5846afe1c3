"""Rates in boards and in megabytes, where a board's key takes 16 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of 16 bytes in 2**20 bytes.
BOARDS_PER_MEGABYTE = (1 << 20) // 16


def boards_per_second(megabytes: Column) -> Column:
    return megabytes * BOARDS_PER_MEGABYTE


def megabytes_per_second(boards: Column) -> Column:
    return F.floor(boards / BOARDS_PER_MEGABYTE)
