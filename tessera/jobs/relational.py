"""Queries over the relational tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bits, rates
from tessera.operators import asof, nested_index
from tessera.operators.ordinals import exclusive_prefix_sum, next_value, position, previous_value, skip_rows
from tessera.sources.records import player_of
from tessera.sources.tables import read, store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["l_partkey", "l_suppkey"]
HIERARCHY = ["l_returnflag", "l_linestatus", "l_suppkey", "l_partkey"]


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders")


def month(column: str):
    return (F.year(column) * 12 + F.month(column)).cast("long")


MONTH = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT)"


# --- distinct, merge and set operations ------------------------------------------------------------


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedup_two_key(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEYS).distinct()


@query("SELECT l_partkey, l_suppkey, CAST(row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def sort_two_key(spark, sf_dir):
    return position(lines(spark, sf_dir).select(*KEYS).distinct(), KEYS)


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber BETWEEN 3 AND 4 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 4")
def merge_dedup(spark, sf_dir):
    rows = lines(spark, sf_dir)
    parts = [rows.filter(c).select(*KEYS) for c in ("l_linenumber <= 2", "l_linenumber BETWEEN 3 AND 4", "l_linenumber > 4")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def union_distinct(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.filter("l_returnflag = 'R'").select("l_partkey").union(rows.filter("l_returnflag = 'A'").select("l_partkey")).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS generated, count(DISTINCT (l_partkey, l_suppkey)) AS unique_rows, count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS dups FROM lineitem GROUP BY ALL")
def dup_accounting(spark, sf_dir):
    group = ["l_returnflag", "l_linestatus"]
    # Two steps of partial aggregation: one row per key first, then sums of what was merged.
    each = lines(spark, sf_dir).groupBy(*group, *KEYS).agg(F.count("*").alias("n"))
    return each.groupBy(*group).agg(F.sum("n").alias("generated"), F.count("*").alias("unique_rows"), F.sum(F.col("n") - 1).alias("dups"))


@query("SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_partkey) > 1 AS is_dup FROM lineitem")
def adjacent_dup_flag(spark, sf_dir):
    """Whether the row before in key order has the same key; a frequent key lies in as many ranges as it needs."""
    rows = lines(spark, sf_dir).select(*KEYS, F.struct(*KEYS).alias("pair"), F.xxhash64("l_orderkey", "l_linenumber").alias("tie"))
    told = previous_value(rows, [*KEYS, "tie"], "pair", "before")
    return told.select(*KEYS, F.coalesce(F.col("before") == F.col("pair"), F.lit(False)).alias("is_dup"))


# --- ordinals and windows --------------------------------------------------------------------------


@query("SELECT l_partkey, l_suppkey, n, CAST(sum(n) OVER (ORDER BY l_partkey, l_suppkey) - n AS BIGINT) AS before FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)", "exclusive_prefix_sum")
def lines_before(spark, sf_dir):
    return exclusive_prefix_sum(lines(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS, F.col("n"), "before")


@query(f"SELECT level, n, CAST(sum(n) OVER (ORDER BY level) AS BIGINT) AS cumulative FROM (SELECT {MONTH} AS level, count(*) AS n FROM orders GROUP BY 1)")
def cumulative_sum(spark, sf_dir):
    levels = orders(spark, sf_dir).groupBy(month("o_orderdate").alias("level")).agg(F.count("*").alias("n"))
    return levels.withColumn("cumulative", F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))


@query(
    "WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM k GROUP BY ALL), "
    "o AS (SELECT *, CAST(sum(n) OVER (ORDER BY l_returnflag, l_linestatus) - n AS BIGINT) AS first_child FROM g) "
    'SELECT l_returnflag, l_linestatus, first_child AS "offset", lead(first_child, 1, (SELECT count(*) FROM k)) OVER (ORDER BY l_returnflag, l_linestatus) AS "end" FROM o'
)
def lead_span(spark, sf_dir):
    return _spans(lines(spark, sf_dir), 2)


@query(
    "WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM k GROUP BY ALL), "
    "o AS (SELECT *, CAST(sum(n) OVER (ORDER BY l_returnflag, l_linestatus, l_suppkey) - n AS BIGINT) AS first_child FROM g) "
    'SELECT l_returnflag, l_linestatus, l_suppkey, first_child AS "offset", lead(first_child, 1, (SELECT count(*) FROM k)) OVER (ORDER BY l_returnflag, l_linestatus, l_suppkey) AS "end" FROM o'
)
def lead_span_lowest(spark, sf_dir):
    """The same for the level right above the leaves, which grows with the table."""
    return _spans(lines(spark, sf_dir), 3)


def _spans(rows: DataFrame, depth: int) -> DataFrame:
    """Prefixes with where their children begin and end; the next prefix is found range by range."""
    keys = HIERARCHY[:depth]
    index = next_value(nested_index.level(rows, HIERARCHY, depth), keys, "offset", "next")
    return index.select(*keys, "offset", F.coalesce("next", F.col("offset") + F.col("children")).alias("end"))


@query(
    "WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), d AS (SELECT l_partkey, l_suppkey - lag(l_suppkey, 1, 0) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS d FROM k), "
    "z AS (SELECT l_partkey, xor(d << 1, d >> 63) AS z FROM d) SELECT l_partkey, CAST(sum(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS bytes FROM z GROUP BY 1"
)
def delta_zigzag_varint_size(spark, sf_dir):
    """Bytes of each part's suppliers as differences; a part with very many lies in several ranges."""
    keys = lines(spark, sf_dir).select(*KEYS).distinct().withColumn("pair", F.struct(*KEYS))
    told = previous_value(keys, KEYS, "pair", "before")
    delta = F.col("l_suppkey") - F.when(F.col("before.l_partkey") == F.col("l_partkey"), F.col("before.l_suppkey")).otherwise(F.lit(0))
    return told.withColumn("d", delta).groupBy("l_partkey").agg(F.sum(bits.varint_length(bits.zigzag(F.col("d")))).alias("bytes"))


@query("SELECT l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (ORDER BY l_partkey, l_suppkey) AS rn FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) WHERE rn > 1000")
def resume_offset(spark, sf_dir):
    """Skip what was done before: the first 1000 keys in order."""
    return sort_two_key(spark, sf_dir).filter("position >= 1000").select(*KEYS)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 100")
def resume_checked(spark, sf_dir):
    """Skip the first 100 orders, whose last one must be the one that the run before finished with."""
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    finished = rows.orderBy("o_orderkey").limit(100).agg(F.max("o_orderkey").alias("o_orderkey")).first()
    return skip_rows(rows, ["o_orderkey"], 100, finished.asDict())


@query("SELECT l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ORDER BY 1, 2 LIMIT 500")
def leading_sample(spark, sf_dir):
    return dedup_two_key(spark, sf_dir).orderBy(*KEYS).limit(500)


@query(
    "WITH d AS (SELECT DISTINCT l_shipdate, l_suppkey FROM lineitem), v AS (SELECT DISTINCT l_suppkey, CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS day FROM d), "
    "n AS (SELECT l_suppkey, day, lead(day) OVER (PARTITION BY l_suppkey ORDER BY day) AS next FROM v) SELECT l_suppkey, min(day) AS first_gap FROM n WHERE next IS NULL OR next > day + 1 GROUP BY 1"
)
def first_gap(spark, sf_dir):
    """The last day before the first day on which a supplier shipped nothing."""
    days = lines(spark, sf_dir).select("l_suppkey", F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("day")).distinct()
    after = F.lead("day").over(Window.partitionBy("l_suppkey").orderBy("day"))
    return days.withColumn("next", after).filter("next IS NULL OR next > day + 1").groupBy("l_suppkey").agg(F.min("day").alias("first_gap"))


# --- nested index ----------------------------------------------------------------------------------


@query('WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM k GROUP BY ALL) SELECT l_returnflag, l_linestatus, CAST(sum(n) OVER (ORDER BY l_returnflag, l_linestatus) - n AS BIGINT) AS "offset" FROM g')
def nested_index_l1(spark, sf_dir):
    return nested_index.level(lines(spark, sf_dir), HIERARCHY, 2).drop("children")


@query(
    "WITH k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_partkey FROM lineitem), g AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM k GROUP BY ALL) "
    'SELECT l_returnflag, l_linestatus, l_suppkey, CAST(sum(n) OVER (ORDER BY l_returnflag, l_linestatus, l_suppkey) - n AS BIGINT) AS "offset" FROM g'
)
def nested_index_l2(spark, sf_dir):
    return nested_index.level(lines(spark, sf_dir), HIERARCHY, 3).drop("children")


LEAF = "SELECT *, CAST(row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_suppkey, l_partkey) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_partkey FROM lineitem)"


@query(f"SELECT position, l_partkey FROM ({LEAF})")
def nested_index_leaf(spark, sf_dir):
    return nested_index.leaf(lines(spark, sf_dir), HIERARCHY).select("position", "l_partkey")


@query(LEAF)
def nested_expand(spark, sf_dir):
    """Full keys from prefixes, offsets and leaf patterns alone."""
    leaves = store(nested_index.leaf(lines(spark, sf_dir), HIERARCHY), "leaves")
    return nested_index.expand(nested_index.level_of(leaves, HIERARCHY), leaves.select("position", "l_partkey"), HIERARCHY)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <> 1")
def having_not_one(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n <> 1")


# --- joins and lookups -----------------------------------------------------------------------------


@query("SELECT o_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def lookup_join(spark, sf_dir):
    chosen = orders(spark, sf_dir).filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return chosen.join(lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", *KEYS, F.col("l_quantity").cast("long").alias("quantity"))


@query("SELECT s_suppkey, n_name, position FROM (SELECT *, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS position FROM supplier) JOIN nation ON s_nationkey = n_nationkey")
def key_position(spark, sf_dir):
    placed = position(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey"])
    return placed.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "position")


@query(
    "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders), b AS (SELECT o_orderkey AS k, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) "
    "SELECT o_orderkey, o_custkey, CAST(p - 1 AS BIGINT) AS position FROM a JOIN b USING (p)"
)
def positional_join(spark, sf_dir):
    """Two files in one order joined by place: keys in one, values in the other."""
    placed = position(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return placed.select("position", "o_orderkey").join(placed.select("position", "o_custkey"), "position").select("o_orderkey", "o_custkey", "position")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def referential_anti_join(spark, sf_dir):
    return orders(spark, sf_dir).join(lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) OR l_quantity <= 0 OR l_discount NOT BETWEEN 0 AND 1 OR l_linenumber < 1")
def invariant_violations(spark, sf_dir):
    """Rows that must not exist; a healthy table gives none."""
    rows = lines(spark, sf_dir)
    bad = rows.filter("l_quantity <= 0 OR l_discount NOT BETWEEN 0 AND 1 OR l_linenumber < 1")
    orphans = rows.filter("NOT (l_quantity <= 0 OR l_discount NOT BETWEEN 0 AND 1 OR l_linenumber < 1)").join(orders(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return bad.unionByName(orphans).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 700 AND 1250 AND o_custkey >= 100")
def range_lookup(spark, sf_dir):
    return orders(spark, sf_dir).filter(F.col("o_orderkey").between(700, 1250) & (F.col("o_custkey") >= 100)).select("o_orderkey", "o_custkey")


def _nearest_sql(least: str, sign: str) -> str:
    return (
        f"WITH r AS (SELECT user_id, ts, {least}(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') "
        f"SELECT l.event_id, l.user_id, r.view_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {sign} r.ts"
    )


def _nearest(spark, sf_dir, join, run):
    events = read(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return join(left, right, "user_id", "ts", "seen", "view_id", run).select("event_id", "user_id", "view_id")


@query(_nearest_sql("min", ">="))
def asof_le(spark, sf_dir):
    """For each purchase, the user's last view at or before it."""
    return _nearest(spark, sf_dir, asof.asof_le, "first")


@query(_nearest_sql("min", "<="))
def asof_ge(spark, sf_dir):
    """For each purchase, the user's first view at or after it."""
    return _nearest(spark, sf_dir, asof.asof_ge, "first")


DAYS = "SELECT l_suppkey, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS day, l_partkey FROM lineitem"


def _run_sql(least: str) -> str:
    return (
        f"WITH r AS (SELECT l_suppkey, day, {least}(l_partkey) AS found FROM ({DAYS}) GROUP BY ALL), l AS (SELECT s_suppkey, 9000 + s_suppkey % 2000 AS day FROM supplier) "
        "SELECT s_suppkey, found FROM l ASOF LEFT JOIN r ON l.s_suppkey = r.l_suppkey AND l.day >= r.day"
    )


def _run(spark, sf_dir, run):
    right = lines(spark, sf_dir).select(F.col("l_suppkey").alias("s_suppkey"), F.datediff("l_shipdate", F.lit("1970-01-01")).alias("day"), "l_partkey")
    left = read(spark, sf_dir, "supplier").select("s_suppkey", (9000 + F.col("s_suppkey") % 2000).cast("int").alias("day"))
    return asof.asof_le(left, right, "s_suppkey", "day", "l_partkey", "found", run).select("s_suppkey", "found")


@query(_run_sql("min"))
def asof_first_of_run(spark, sf_dir):
    """The last day before a supplier's own day: of its run of lines, the first."""
    return _run(spark, sf_dir, "first")


@query(_run_sql("max"))
def asof_last_of_run(spark, sf_dir):
    """The same, with the last of the run."""
    return _run(spark, sf_dir, "last")


@query(f"SELECT o_orderpriority, max({MONTH}) AS deepest FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def semi_join_max(spark, sf_dir):
    present = orders(spark, sf_dir).join(lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return present.groupBy("o_orderpriority").agg(F.max(month("o_orderdate")).alias("deepest"))


# --- aggregates ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total, count(l_orderkey) AS children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def child_sum(spark, sf_dir):
    """Parents with the sum of their children; those without get 0.  The children are summed before the join."""
    children = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count("*").alias("children"))
    joined = orders(spark, sf_dir).select("o_orderkey").join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("children", F.lit(0)).alias("children"))


@query("SELECT l_suppkey, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total, sum(CAST(floor(l_extendedprice) AS BIGINT)) <= 16777214 AS fits FROM lineitem GROUP BY 1")
def checked_sum(spark, sf_dir):
    """Exact sums, and whether they stay below the reserved top value of a counter of three bytes."""
    total = F.sum(F.col("l_extendedprice").cast("long").cast("decimal(38,0)"))
    return lines(spark, sf_dir).groupBy("l_suppkey").agg(total.alias("exact")).select("l_suppkey", F.col("exact").cast("long").alias("total"), (F.col("exact") <= 2**24 - 2).alias("fits"))


WIDTH = "CASE WHEN {0} <= 14 THEN 0 WHEN {0} <= 254 THEN 1 WHEN {0} <= 65534 THEN 2 WHEN {0} <= 16777214 THEN 3 WHEN {0} <= 4294967294 THEN 4 ELSE 8 END"


def width(column):
    """The narrowest counter for a value: 0 for four bits, else bytes; the top value is reserved."""
    out = F.lit(8)
    for size in (4, 3, 2, 1):
        out = F.when(column <= 2 ** (8 * size) - 2, size).otherwise(out)
    return F.when(column <= 14, 0).otherwise(out).cast("long")


@query("WITH s AS (SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL) SELECT l_suppkey, max(total) AS most, CAST(" + WIDTH.format("max(total)") + " AS BIGINT) AS width FROM s GROUP BY 1")
def width_tier(spark, sf_dir):
    sums = lines(spark, sf_dir).groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return sums.groupBy("l_suppkey").agg(F.max("total").alias("most")).withColumn("width", width(F.col("most")))


@query(
    f"WITH m AS (SELECT {MONTH} AS level, o_custkey, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT level, max(n) AS most FROM m GROUP BY 1) "
    "SELECT level, most, max(most) OVER (ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor FROM w"
)
def monotone_floor(spark, sf_dir):
    """A level needs at least the width of every deeper one."""
    each = orders(spark, sf_dir).groupBy(month("o_orderdate").alias("level"), "o_custkey").agg(F.count("*").alias("n"))
    deeper = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    return each.groupBy("level").agg(F.max("n").alias("most")).withColumn("floor", F.max("most").over(deeper))


@query(
    "SELECT coalesce(o_orderpriority, 'ALL') AS side, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS black, CAST(sum(CAST(o_orderstatus = 'O' AS INT)) AS BIGINT) AS white, CAST(sum(CAST(o_orderstatus = 'P' AS INT)) AS BIGINT) AS tie, count(*) AS total "
    "FROM orders GROUP BY ROLLUP (o_orderpriority)"
)
def census_rollup(spark, sf_dir):
    status = {"black": "F", "white": "O", "tie": "P"}
    sums = [F.sum((F.col("o_orderstatus") == v).cast("long")).alias(k) for k, v in status.items()]
    return orders(spark, sf_dir).rollup("o_orderpriority").agg(*sums, F.count("*").alias("total")).withColumn("side", F.coalesce("o_orderpriority", F.lit("ALL"))).drop("o_orderpriority")


@query("SELECT b AS bit, CAST(sum((l_partkey >> b) & 1) AS BIGINT) AS set_count, count(*) AS total FROM lineitem, range(16) t(b) GROUP BY 1")
def bit_occupancy(spark, sf_dir):
    """How often each of 16 bits is set: one pass with 16 counters, then one row per counter."""
    counters = [F.sum(bits.bit_slice(F.col("l_partkey"), b, 1)).alias(f"b{b}") for b in range(16)]
    once = lines(spark, sf_dir).agg(F.count("*").alias("total"), *counters)
    return once.select("total", F.posexplode(F.array(*(f"b{b}" for b in range(16)))).alias("bit", "set_count")).select(F.col("bit").cast("long").alias("bit"), "set_count", "total")


@query("SELECT CAST(bit_count(l_partkey & 65535) AS BIGINT) AS ones, count(*) AS n FROM lineitem GROUP BY 1")
def popcount_histogram(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.bit_count(F.col("l_partkey").bitwiseAND(F.lit(65535))).cast("long").alias("ones")).agg(F.count("*").alias("n"))


@query(
    "SELECT l_returnflag, count(*) AS records, CAST(sum(bit_count(l_partkey & 65535)) AS BIGINT) AS ones, CAST(sum(bit_count(l_partkey & 65535)) * 1000 // count(*) AS BIGINT) AS average_permille, "
    "CAST(16 - bit_count(bit_or(l_partkey & 65535)) AS BIGINT) AS idle_bits FROM lineitem GROUP BY 1"
)
def popcount_summary(spark, sf_dir):
    """Average population of the patterns of 16 bits, and how many bits no pattern sets."""
    pattern = F.col("l_partkey").bitwiseAND(F.lit(65535))
    sums = lines(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("records"), F.sum(F.bit_count(pattern)).cast("long").alias("ones"), F.bit_or(pattern).alias("used"))
    return sums.select("l_returnflag", "records", "ones", F.expr("ones * 1000 div records").alias("average_permille"), (16 - F.bit_count("used")).cast("long").alias("idle_bits"))


#: Bits to number the patterns of 16 bits with k ones.
BAND_BITS = [max(1, math.ceil(math.log2(math.comb(16, k)))) if math.comb(16, k) > 1 else 0 for k in range(17)]


@query(
    "WITH b AS (SELECT bit_count(l_partkey & 65535) AS ones, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT CAST(ones AS BIGINT) AS ones, n, CAST([" + ",".join(map(str, BAND_BITS)) + "][ones + 1] AS BIGINT) AS bits FROM b) "
    "SELECT coalesce(ones, -1) AS ones, CAST(sum(n) AS BIGINT) AS records, CAST(sum((n * bits + 7) // 8) AS BIGINT) AS bytes FROM w GROUP BY ROLLUP (ones)"
)
def band_sizes(spark, sf_dir):
    """Bytes of each population's patterns when numbered within it; -1 is the total."""
    table = F.array(*(F.lit(b).cast("long") for b in BAND_BITS))
    sized = popcount_histogram(spark, sf_dir).withColumn("size", F.floor((F.col("n") * F.element_at(table, F.col("ones").cast("int") + 1) + 7) / 8))
    return sized.rollup("ones").agg(F.sum("n").alias("records"), F.sum("size").cast("long").alias("bytes")).withColumn("ones", F.coalesce("ones", F.lit(-1).cast("long")))


@query(
    "WITH b AS (SELECT l_returnflag, bit_count(l_partkey & 65535) AS ones, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT l_returnflag, n, (n * [" + ",".join(map(str, BAND_BITS)) + "][ones + 1] + 7) // 8 AS bytes FROM b) "
    "SELECT l_returnflag, CAST(sum(n) * 2 AS BIGINT) AS plain_bytes, CAST(sum(bytes) AS BIGINT) AS band_bytes, CAST((sum(n) * 2 - sum(bytes)) * 10000 // (sum(n) * 2) AS BIGINT) AS reduction_hundredths FROM w GROUP BY 1"
)
def band_reduction(spark, sf_dir):
    """What numbering patterns within their population saves against two bytes each, in hundredths of a percent."""
    table = F.array(*(F.lit(b).cast("long") for b in BAND_BITS))
    ones = F.bit_count(F.col("l_partkey").bitwiseAND(F.lit(65535)))
    counts = lines(spark, sf_dir).groupBy("l_returnflag", ones.alias("ones")).agg(F.count("*").alias("n"))
    sums = counts.withColumn("bytes", F.floor((F.col("n") * F.element_at(table, F.col("ones") + 1) + 7) / 8)).groupBy("l_returnflag").agg((F.sum("n") * 2).alias("plain_bytes"), F.sum("bytes").cast("long").alias("band_bytes"))
    return sums.withColumn("reduction_hundredths", F.expr("CASE WHEN plain_bytes > 0 THEN (plain_bytes - band_bytes) * 10000 div plain_bytes END"))


@query(
    f"SELECT {MONTH} AS level, count(*) AS boards, CAST(sum(CAST(o_orderstatus = 'F' AS INT)) AS BIGINT) AS black, CAST(sum(CAST(o_orderstatus = 'O' AS INT)) AS BIGINT) AS white, count(DISTINCT o_custkey) AS groups, count(*) * 2 + count(DISTINCT o_custkey) * 16 AS uncompressed_bytes FROM orders GROUP BY 1"
)
def level_store_stats(spark, sf_dir):
    each = orders(spark, sf_dir).groupBy(month("o_orderdate").alias("level"), "o_custkey").agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("f"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("o"))
    stats = each.groupBy("level").agg(F.sum("n").alias("boards"), F.sum("f").alias("black"), F.sum("o").alias("white"), F.count("*").alias("groups"))
    return stats.withColumn("uncompressed_bytes", F.col("boards") * 2 + F.col("groups") * 16)


@query(
    f"WITH s AS (SELECT {MONTH} AS level, count(*) AS boards, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1), b AS (SELECT level, boards, boards * 16 AS flat, boards * 2 + groups * 16 AS nested FROM s) "
    "SELECT level, CAST(nested * 800 // boards AS BIGINT) AS bits_per_board_hundredths, CAST(flat * 1000 // nested AS BIGINT) AS ratio_permille, CAST(CASE WHEN flat >= nested THEN (flat - nested) * 10000 // flat ELSE -((nested - flat) * 10000 // flat) END AS BIGINT) AS reduction_hundredths FROM b"
)
def store_ratios(spark, sf_dir):
    """Bits per board, ratio and reduction of a level with a nested index against flat keys; blank without boards."""
    sized = level_store_stats(spark, sf_dir).select("level", "boards", (F.col("boards") * 16).alias("flat"), F.col("uncompressed_bytes").alias("nested"))

    def share(value: str, whole: str, alias: str):
        return F.expr(f"CASE WHEN {whole} <> 0 THEN {value} div {whole} END").alias(alias)

    return sized.select("level", share("nested * 800", "boards", "bits_per_board_hundredths"), share("flat * 1000", "nested", "ratio_permille"), share("(flat - nested) * 10000", "flat", "reduction_hundredths"))


SUMMARY = f"WITH m AS (SELECT {MONTH} AS level, o_custkey, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT level, CAST(sum(n) AS BIGINT) AS generated, count(*) AS uniq FROM m GROUP BY 1) "


def _levels(spark, sf_dir):
    each = orders(spark, sf_dir).groupBy(month("o_orderdate").alias("level"), "o_custkey").agg(F.count("*").alias("n"))
    return each.groupBy("level").agg(F.sum("n").alias("generated"), F.count("*").alias("uniq"))


@query(SUMMARY + "SELECT level, generated, uniq, generated - uniq AS dups, lag(uniq, 1, 0) OVER (ORDER BY level) AS boards_in FROM s")
def level_summary(spark, sf_dir):
    before = F.lag("uniq", 1, 0).over(Window.orderBy("level"))
    return _levels(spark, sf_dir).withColumn("dups", F.col("generated") - F.col("uniq")).withColumn("boards_in", before)


@query(
    SUMMARY + "SELECT level, CASE WHEN generated - uniq = 0 THEN NULL ELSE CAST(uniq * 1000 // (generated - uniq) AS BIGINT) END AS ratio_permille, "
    "CASE WHEN generated = 0 THEN NULL ELSE CAST((generated - uniq) * 10000 // generated AS BIGINT) END AS dups_pct_hundredths FROM s"
)
def safe_ratios(spark, sf_dir):
    """Ratios in whole parts; a zero denominator gives null."""
    dups = F.col("generated") - F.col("uniq")
    return _levels(spark, sf_dir).select("level", F.try_divide(F.col("uniq") * 1000 - F.try_mod(F.col("uniq") * 1000, dups), dups).cast("long").alias("ratio_permille"), F.floor(F.try_divide(dups * 10000 - F.try_mod(dups * 10000, F.col("generated")), F.col("generated"))).alias("dups_pct_hundredths"))


# --- projections -----------------------------------------------------------------------------------

#: A word of 62 bits made of a key, so that every bit varies and none is the sign.
MIXED = "(o_orderkey * 2654435761 + o_custkey * 40503) & 4611686018427387903"


def mixed():
    return F.expr(MIXED)


@query(f"SELECT o_orderkey, (v >> 34) & 268435455 AS top, (v >> 16) & 262143 AS middle, v & 65535 AS leaf FROM (SELECT o_orderkey, {MIXED} AS v FROM orders)")
def bit_slice(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", *(bits.bit_slice(mixed(), low, n).alias(k) for k, low, n in (("top", 34, 28), ("middle", 16, 18), ("leaf", 0, 16))))


@query(f"SELECT o_orderkey, {MIXED} AS v FROM orders")
def bit_concat(spark, sf_dir):
    parts = orders(spark, sf_dir).select("o_orderkey", *(bits.bit_slice(mixed(), low, n).alias(k) for k, low, n in (("top", 34, 28), ("middle", 16, 18), ("leaf", 0, 16))))
    return parts.select("o_orderkey", bits.bit_concat([(F.col("top"), 28), (F.col("middle"), 18), (F.col("leaf"), 16)]).alias("v"))


RING4 = bits.ring_order(4)


@query("SELECT p_partkey, CAST(" + " + ".join(f"(((p_partkey & 65535) >> {15 - p}) & 1) * {1 << (15 - k)}" for k, p in enumerate(RING4)) + " AS BIGINT) AS ring FROM part")
def bit_permute(spark, sf_dir):
    """16 bits as a 4x4 board, from rows to rings."""
    return read(spark, sf_dir, "part").select("p_partkey", bits.gather_bits(F.col("p_partkey").bitwiseAND(F.lit(65535)), RING4).alias("ring"))


@query("SELECT p_partkey, p_partkey & 65535 AS back FROM part")
def bit_permute_roundtrip(spark, sf_dir):
    ring = bit_permute(spark, sf_dir)
    return ring.select("p_partkey", bits.gather_bits(F.col("ring"), bits.inverse_order(RING4)).alias("back"))


def _bits_sql(order: list[int], width: int, value: str) -> str:
    return "(" + " | ".join(f"(((({value}) >> {width - 1 - p}) & 1) << {width - 1 - k})" for k, p in enumerate(order)) + ")"


RING8 = bits.ring_order(8)
WORDS = "WITH w AS (SELECT o_orderkey, CAST(" + MIXED + " AS UBIGINT) AS v FROM orders) "


def as_hex(value):
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@query(WORDS + f"SELECT o_orderkey, printf('%016x', {_bits_sql(RING8, 64, 'v')}) AS ring, printf('%016x', v) AS back FROM w")
def ring_permute64(spark, sf_dir):
    """64 bits as an 8x8 board, from rows to rings and back."""
    moved = orders(spark, sf_dir).select("o_orderkey", bits.gather_bits(mixed(), RING8).alias("moved"))
    return moved.select("o_orderkey", as_hex(F.col("moved")).alias("ring"), as_hex(bits.gather_bits(F.col("moved"), bits.inverse_order(RING8))).alias("back"))


#: Where each cell of an 8x8 board comes from after turns by 90, 180 and 270 degrees clockwise.
TURNS = {
    "quarter": [8 * (7 - c) + r for r in range(8) for c in range(8)],
    "half": [8 * (7 - r) + 7 - c for r in range(8) for c in range(8)],
    "three_quarters": [8 * c + 7 - r for r in range(8) for c in range(8)],
}


@query(WORDS + "SELECT o_orderkey, " + ", ".join(f"printf('%016x', {_bits_sql(order, 64, 'v')}) AS {name}" for name, order in TURNS.items()) + " FROM w")
def bit_rotations(spark, sf_dir):
    """The turns of a board by 90, 180 and 270 degrees."""
    rows = orders(spark, sf_dir).select("o_orderkey", mixed().alias("v"))
    return rows.select("o_orderkey", *(as_hex(bits.rotate(F.col("v"), k + 1)).alias(name) for k, name in enumerate(TURNS)))


#: Row-major order of the cells of an 8x8 board after each symmetry.
SYMMETRY = {
    "flipped": [8 * (7 - r) + c for r in range(8) for c in range(8)],
    "mirrored": [8 * r + 7 - c for r in range(8) for c in range(8)],
    "transposed": [8 * c + r for r in range(8) for c in range(8)],
}


@query("WITH w AS (SELECT o_orderkey, CAST(" + MIXED + " AS UBIGINT) AS v FROM orders) SELECT o_orderkey, " + ", ".join(f"printf('%016x', {_bits_sql(order, 64, 'v')}) AS {name}" for name, order in SYMMETRY.items()) + " FROM w")
def bit_symmetries(spark, sf_dir):
    """The board symmetries of a word: upside down, left to right, along the diagonal."""
    rows = orders(spark, sf_dir).select("o_orderkey", mixed().alias("v"))
    moved = {"flipped": bits.byte_swap, "mirrored": bits.mirror, "transposed": bits.transpose}
    return rows.select("o_orderkey", *(F.lower(F.lpad(F.hex(f(F.col("v"))), 16, "0")).alias(name) for name, f in moved.items()))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN bit_count(l_partkey) > bit_count(l_suppkey) THEN 'BLACK' WHEN bit_count(l_partkey) < bit_count(l_suppkey) THEN 'WHITE' ELSE 'TIE' END AS outcome FROM lineitem")
def classify_popcount(spark, sf_dir):
    return lines(spark, sf_dir).select("l_orderkey", *KEYS, bits.classify(F.col("l_partkey"), F.col("l_suppkey")).alias("outcome"))


ONE_HOT = ", ".join(f"CAST(o_orderstatus = '{v}' AS BIGINT) AS {k}" for k, v in (("black", "F"), ("white", "O"), ("tie", "P")))


@query(f"SELECT o_orderkey, {ONE_HOT} FROM orders")
def one_hot(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", *((F.col("o_orderstatus") == v).cast("long").alias(k) for k, v in (("black", "F"), ("white", "O"), ("tie", "P"))))


@query("SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey END AS black, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS white FROM lineitem")
def conditional_swap(spark, sf_dir):
    flip = F.col("l_returnflag") == "R"
    return lines(spark, sf_dir).select("l_orderkey", F.when(flip, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("black"), F.when(flip, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("white"))


@query("SELECT CASE WHEN l_linestatus = 'O' THEN 'black' ELSE 'white' END AS player, count(*) AS rows_in, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def two_way_split(spark, sf_dir):
    player = F.when(F.col("l_linestatus") == "O", "black").otherwise("white")
    each = lines(spark, sf_dir).groupBy(player.alias("player"), "l_partkey").agg(F.count("*").alias("n"))
    return each.groupBy("player").agg(F.sum("n").alias("rows_in"), F.count("*").alias("parts"))


@query("SELECT p_partkey, CAST(" + " + ".join(f"((p_partkey >> {p}) & 1) * [" + ",".join(str(math.comb(p, k)) for k in range(17)) + f"][bit_count(p_partkey & {(1 << (p + 1)) - 1}) + 1]" for p in range(16)) + " AS BIGINT) AS rank FROM part")
def combinadic_rank(spark, sf_dir):
    """Of every key, the place of its lower 16 bits among the patterns with as many ones."""
    return read(spark, sf_dir, "part").select("p_partkey", bits.combinadic_rank(F.col("p_partkey").bitwiseAND(F.lit(65535))).alias("rank"))


@query("SELECT p_partkey, p_partkey & 65535 AS back FROM part")
def combinadic_roundtrip(spark, sf_dir):
    ones = F.bit_count(F.col("p_partkey").bitwiseAND(F.lit(65535)))
    return combinadic_rank(spark, sf_dir).select("p_partkey", bits.combinadic_unrank(F.col("rank"), ones).alias("back"))


@query("SELECT p_partkey, CAST([" + ",".join(str(math.comb(16, k)) for k in range(17)) + "][bit_count(p_partkey & 65535) + 1] AS BIGINT) AS patterns FROM part")
def binomials(spark, sf_dir):
    """How many patterns of 16 bits have as many ones as each key's lower bits."""
    return read(spark, sf_dir, "part").select("p_partkey", bits.binomial(16, F.bit_count(F.col("p_partkey").bitwiseAND(F.lit(65535))), 16).alias("patterns"))


@query("SELECT o_orderkey, v | o_custkey AS occupied, v AS colors, xor(v | o_custkey, v) AS flipped FROM (SELECT o_orderkey, o_custkey, " + MIXED + " AS v FROM orders)")
def color_flip(spark, sf_dir):
    """The discs of the other colour among the occupied cells."""
    boards = orders(spark, sf_dir).select("o_orderkey", mixed().bitwiseOR(F.col("o_custkey")).alias("occupied"), mixed().alias("colors"))
    return boards.withColumn("flipped", bits.color_flip(F.col("occupied"), F.col("colors")))


@query("SELECT o_orderkey, CAST(((o_orderkey & 15) | ((o_custkey & 15) << 4)) AS BIGINT) AS packed, o_orderkey & 15 AS low, o_custkey & 15 AS high FROM orders")
def nibble_pack(spark, sf_dir):
    packed = orders(spark, sf_dir).select("o_orderkey", bits.nibble_pack(F.col("o_orderkey"), F.col("o_custkey")).alias("packed"))
    return packed.select("*", bits.bit_slice(F.col("packed"), 0, 4).alias("low"), bits.bit_slice(F.col("packed"), 4, 4).alias("high"))


@query("SELECT p_partkey, translate(lpad(bin(p_partkey & 65535), 16, '0'), '01', '.#') AS drawn FROM part")
def render_bits(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", bits.render(F.col("p_partkey").bitwiseAND(F.lit(65535)), 16).alias("drawn"))


@query("SELECT p_partkey, list_min([p_partkey * 40503 % 65536, p_partkey * 30011 % 65536, 65535 - p_partkey % 65536]) AS least FROM part")
def array_min_struct(spark, sf_dir):
    """The smallest of several candidate rows, compared field by field; the first wins a tie."""
    key = F.col("p_partkey")
    candidates = F.array(*(F.struct(v.cast("long").alias("v"), F.lit(i).alias("i")) for i, v in enumerate((key * 40503 % 65536, key * 30011 % 65536, 65535 - key % 65536))))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_min(candidates)["v"].alias("least"))


@query("SELECT o_orderkey, concat(o_custkey // 3600, ':', lpad(CAST(o_custkey % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0')) AS hms FROM orders")
def format_hms(spark, sf_dir):
    s = F.col("o_custkey")
    return orders(spark, sf_dir).select("o_orderkey", F.format_string("%d:%02d:%02d", F.expr("o_custkey div 3600"), F.expr("o_custkey % 3600 div 60"), s % 60).alias("hms"))


@query(SUMMARY + "SELECT level, CASE WHEN sum(uniq) OVER w = 0 THEN NULL ELSE CAST((sum(uniq) OVER () - sum(uniq) OVER w) * 100 // sum(uniq) OVER w AS BIGINT) END AS eta FROM s WINDOW w AS (ORDER BY level)")
def eta_projection(spark, sf_dir):
    """Time left when what is done so far took 100 units, by level."""
    done = F.sum("uniq").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    levels = _levels(spark, sf_dir).withColumn("done", done)
    total = F.sum("uniq").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("total", total).select("level", F.expr("CASE WHEN done = 0 THEN NULL ELSE (total - done) * 100 div done END").alias("eta"))


@query(SUMMARY + "SELECT level, generated AS mb_per_second, generated * 65536 AS boards_per_second, uniq * 65536 // 65536 AS back FROM s")
def rate_conversion(spark, sf_dir):
    """Megabytes a second as boards of 16 bytes a second, and back."""
    return _levels(spark, sf_dir).select("level", F.col("generated").alias("mb_per_second"), rates.boards_per_second(F.col("generated")).alias("boards_per_second"), rates.megabytes_per_second(rates.boards_per_second(F.col("uniq"))).alias("back"))


@query(
    "SELECT o_orderkey, concat('level=', o_custkey % 61, '/player=', CASE WHEN o_orderkey % 2 = 1 THEN 'black' ELSE 'white' END) AS path, CASE WHEN o_orderkey % 2 = 1 THEN 'black' ELSE 'white' END AS player, "
    "CAST(NULL AS VARCHAR) AS none FROM orders"
)
def path_player(spark, sf_dir):
    """The folder of a level and player, the player read back from it, and from a path without one."""
    path = F.format_string("level=%d/player=%s", F.col("o_custkey") % 61, F.when(F.col("o_orderkey") % 2 == 1, "black").otherwise("white"))
    return orders(spark, sf_dir).select("o_orderkey", path.alias("path"), player_of(path).alias("player"), player_of(F.col("o_orderpriority")).alias("none"))


@query(SUMMARY + "SELECT level, uniq, coalesce(lag(dups * 1000 // generated) OVER (ORDER BY level), 500) AS share_before FROM (SELECT *, generated - uniq AS dups FROM s)")
def level_eta_split(spark, sf_dir):
    """The share of merging in the level before, in thousandths; half where there is none."""
    share = F.expr("(generated - uniq) * 1000 div generated")
    return _levels(spark, sf_dir).withColumn("share", share).select("level", "uniq", F.coalesce(F.lag("share").over(Window.orderBy("level")), F.lit(500)).alias("share_before"))


@query(SUMMARY + "SELECT concat_ws(' |', lpad(CAST(level AS VARCHAR), 8, ' '), lpad(CAST(generated AS VARCHAR), 12, ' '), lpad(CAST(uniq AS VARCHAR), 12, ' ')) AS line FROM s")
def fixed_width_row(spark, sf_dir):
    cells = [F.lpad(F.col(c).cast("string"), n, " ") for c, n in (("level", 8), ("generated", 12), ("uniq", 12))]
    return _levels(spark, sf_dir).select(F.concat_ws(" |", *cells).alias("line"))


@query("SELECT count(*) AS records, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders")
def meta_min_max_count(spark, sf_dir):
    """Answered from the files' footers where the reader allows it."""
    from tessera.sources.metadata import footer_summary

    return footer_summary(spark, f"{sf_dir}/orders.parquet", "o_orderkey")
