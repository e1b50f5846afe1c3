"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.jobs import relational, statespace, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, **storage.QUERIES, **statespace.QUERIES}
ORACLES: dict[str, str] = {**relational.ORACLES, **storage.ORACLES, **statespace.ORACLES}
