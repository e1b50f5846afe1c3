"""Queries that go through files: record tiers, segments, level folders, reports, streams of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import records
from tessera.sources.index_store import IndexStore
from tessera.sources.tables import new_path, read
from tessera.streaming import merging

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HIERARCHY = ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey"]
#: Keys in a file of the indexes below, few enough for small tables to have several files.
INDEX_ROWS = 10_000
MONTH = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT)"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hi"), F.col("l_suppkey").alias("lo"))


def _through(tier: str):
    @query(f"records_{tier}", "SELECT l_partkey AS hi, l_suppkey AS lo FROM lineitem")
    def roundtrip(spark, sf_dir):
        path = new_path(spark, f"records-{tier}")
        records.write_records(pairs(spark, sf_dir), path, ["hi", "lo"], tier)
        return records.open_records(spark, path)


for _tier in records.TIERS:
    _through(_tier)


@query("records_shaped", "SELECT CAST(o_custkey AS INT) AS pattern, CAST(o_orderkey % 32768 AS SMALLINT) AS leaf FROM orders")
def records_shaped(spark, sf_dir):
    """Records of narrower fields, read with the schema they were written for."""
    path = new_path(spark, "records-shaped")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("pattern"), (F.col("o_orderkey") % 32768).cast("short").alias("leaf"))
    records.write_records(rows, path, ["pattern", "leaf"])
    return records.open_records(spark, path, T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("leaf", T.ShortType())]))


@query("segments_joined", "SELECT l_partkey AS hi, CASE WHEN l_linenumber > 3 THEN l_suppkey ELSE 0 END AS lo FROM lineitem")
def segments_joined(spark, sf_dir):
    """Segments of two layouts as one: the older one has no second field, which becomes zero."""
    rows = read(spark, sf_dir, "lineitem")
    old, new = new_path(spark, "segment"), new_path(spark, "segment")
    rows.filter("l_linenumber <= 3").select(F.col("l_partkey").alias("hi")).write.parquet(old)
    rows.filter("l_linenumber > 3").select(F.col("l_partkey").alias("hi"), F.col("l_suppkey").alias("lo")).write.parquet(new)
    return records.evolve(records.concatenate(spark, [old, new]), records.RECORD)


@query("level_folders", f"SELECT {MONTH} AS level, CAST(o_custkey % 2 AS INT) AS player, o_orderkey FROM orders WHERE o_custkey % 2 = 1")
def level_folders(spark, sf_dir):
    """One folder per level and player, found again by discovery; one player's are read."""
    path = new_path(spark, "levels")
    level = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    records.write_levels(read(spark, sf_dir, "orders").select(level.alias("level"), (F.col("o_custkey") % 2).cast("int").alias("player"), "o_orderkey"), path)
    return records.read_levels(spark, path, player=1).select("level", "player", "o_orderkey")


@query("report_file", "SELECT o_orderpriority AS side, count(*) AS total, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN NULL ELSE CAST(count(*) // count(*) FILTER (o_orderstatus = 'P') AS BIGINT) END AS ratio FROM orders GROUP BY 1")
def report_file(spark, sf_dir):
    """A report with blanks where a denominator is zero, as a CSV file that is read back."""
    path = new_path(spark, "report")
    partial = F.count_if(F.col("o_orderstatus") == "P")
    report = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("side")).agg(F.count("*").alias("total"), partial.alias("p")).select("side", "total", F.expr("CASE WHEN p <> 0 THEN total div p END").alias("ratio"))
    records.write_report(report, path)
    return spark.read.schema("side string, total long, ratio long").option("header", "true").csv(path)


@query("union_all", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def union_all(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").unionByName(rows.filter("l_linestatus = 'O'").select("l_partkey", "l_suppkey"))


@query(
    "merge_into_index",
    "WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM k GROUP BY ALL) "
    'SELECT l_returnflag, l_linestatus, l_suppkey, CAST(sum(n) OVER (ORDER BY l_returnflag, l_linestatus, l_suppkey) - n AS BIGINT) AS "offset" FROM g',
)
def merge_into_index(spark, sf_dir):
    """New keys merged into a stored index: only files that they fall into are written again."""
    rows = read(spark, sf_dir, "lineitem").select(*HIERARCHY, "l_linenumber")
    index = IndexStore(spark, new_path(spark, "index"), HIERARCHY, rows_per_file=INDEX_ROWS)
    index.build(rows.filter("l_linenumber <= 3"))
    index.merge(rows.filter("l_linenumber > 3"))
    return index.prefixes()


@query(
    "index_lookup",
    "WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <= 3), p AS (SELECT *, CAST(row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_suppkey, l_partkey) - 1 AS BIGINT) AS position FROM k) "
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey, l_partkey, position FROM lineitem LEFT JOIN p USING (l_returnflag, l_linestatus, l_suppkey, l_partkey)",
)
def index_lookup(spark, sf_dir):
    """The position of every line's key in a stored index, or none, by files, prefixes and then leaves."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *HIERARCHY)
    index = IndexStore(spark, new_path(spark, "index"), HIERARCHY, rows_per_file=INDEX_ROWS)
    index.build(rows.filter("l_linenumber <= 3"))
    index.check()
    return index.lookup(rows)


@query("stream_distinct", "SELECT DISTINCT l_partkey AS hi, l_suppkey AS lo FROM lineitem")
def stream_distinct(spark, sf_dir):
    """Distinct keys of files that arrive, kept in a state store over the batches of a stream."""
    arriving, out, mark = (new_path(spark, name) for name in ("arriving", "merged", "stream"))
    rows = pairs(spark, sf_dir)
    rows.repartition(4).write.parquet(arriving)
    merging.run_to_table(merging.merged(merging.arriving(spark, arriving, rows.schema, files_per_batch=2), ["hi", "lo"]), out, mark)
    return spark.read.schema(rows.schema).parquet(out)
