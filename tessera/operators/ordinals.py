"""Ordinal positions, running sums and values carried on over a whole table in key order.

No window runs over the whole table in one task: rows are dealt by range of their keys and written once in
order, with their place; what a range passes on to the next is one row, and within a range a window does
the rest.  So no key, however frequent, and no group keeps its rows in one task.  A task holds one range: there are
as many as a shuffle has partitions, and more where those would outgrow RANGE_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import store

#: Bits of a place below the number of its range.
PLACE_BITS = 33
#: Rows that a task sorts or holds in a window, about.
RANGE_ROWS = 1 << 18


def ranges(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: those of a shuffle, and more where each would have over RANGE_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def _ranged(frame: DataFrame, keys: list[str | Column]) -> tuple[DataFrame, int]:
    """The rows, written in key order, and the number of ranges: __place grows along the whole order, __range numbers its ranges."""
    n = ranges(frame.sparkSession, frame.count())
    ordered = frame.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id())
    return store(ordered, "ranges").withColumn("__range", F.shiftright("__place", PLACE_BITS).cast("int")), n


def _with_bases(ranged: DataFrame, n: int, bases: DataFrame) -> DataFrame:
    """Each range in a task of its own, beside what it gets from the others.

    By a hash of their numbers, ranges would meet in a task, and Spark would put tasks together by their bytes on disk.
    """
    return ranged.repartitionById(n, "__range").join(F.broadcast(bases), "__range")


def exclusive_prefix_sum(frame: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of value over all rows whose keys come before; keys must identify rows."""
    ranged, n = _ranged(frame.withColumn("__value", value.cast("long")), keys)
    totals = ranged.groupBy("__range").agg(F.sum("__value").alias("__total"))
    # One row per range, whatever the size of the table.
    bases = totals.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__base"))
    before = F.sum("__value").over(Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    return _with_bases(ranged, n, bases).withColumn(name, (F.col("__base") + before - F.col("__value")).cast("long")).drop("__range", "__place", "__value", "__base")


def position(frame: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Add each row's place in key order, from 0."""
    return exclusive_prefix_sum(frame, keys, F.lit(1), name)


def carry_forward(frame: DataFrame, keys: list[str | Column], column: str, name: str) -> DataFrame:
    """Add the last value of a column that is not null, up to and with each row, in key order."""
    return carry_all(frame, keys, {name: F.col(column)})


def carry_all(frame: DataFrame, keys: list[str | Column], columns: dict[str, Column]) -> DataFrame:
    """Add under each name the last value of its column that is not null, up to and with each row, in key order."""
    held = {name: f"__held_{i}" for i, name in enumerate(columns)}
    ranged, parts = _ranged(frame.withColumns({held[n]: c for n, c in columns.items()}), keys)
    ends = ranged.groupBy("__range").agg(*(F.max_by(h, F.when(F.col(h).isNotNull(), F.col("__place"))).alias(h) for h in held.values()))
    # One row per range, whatever the size of the table.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("__range", *(F.last(h, ignorenulls=True).over(earlier).alias(f"{h}_base") for h in held.values()))
    own = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    told = _with_bases(ranged, parts, bases).select("*", *(F.coalesce(F.last(h, ignorenulls=True).over(own), F.col(f"{h}_base")).alias(f"{h}_found") for h in held.values()))
    return told.select(*frame.columns, *(F.col(f"{h}_found").alias(n) for n, h in held.items()))


def next_value(frame: DataFrame, keys: list[str | Column], column: str, name: str) -> DataFrame:
    """Add the column's value in the next row in key order; null in the last row."""
    return _neighbour(frame, keys, column, name, F.lead, F.min_by)


def previous_value(frame: DataFrame, keys: list[str | Column], column: str, name: str) -> DataFrame:
    """Add the column's value in the row before in key order; null in the first row."""
    return _neighbour(frame, keys, column, name, F.lag, F.max_by)


def _neighbour(frame: DataFrame, keys: list[str | Column], column: str, name: str, step, edge) -> DataFrame:
    """The value of a neighbouring row, which for the last or first row of a range lies in the next or previous range."""
    ranged, n = _ranged(frame, keys)
    value = F.struct(F.col(column).alias("v"))
    edges = ranged.groupBy("__range").agg(edge(value, "__place").alias("__edge"))
    # One row per range, whatever the size of the table.
    beyond = edges.select("__range", step("__edge").over(Window.orderBy("__range")).alias("__beyond"))
    own = step(value).over(Window.partitionBy("__range").orderBy("__place"))
    told = _with_bases(ranged, n, beyond).select("*", F.coalesce(own, F.col("__beyond")).alias("__found"))
    return told.select(*frame.columns, F.col("__found.v").alias(name))


def first_rows(frame: DataFrame, group: str, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each group in key order, for an n that may be large.

    Counts per range and group decide: ranges that lie before the n-th row are taken whole, and of the one that it
    lies in, the rows up to it.
    """
    ranged, parts = _ranged(frame, [group, *keys])
    counts = ranged.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    # One row per range and group that lies in it.
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = counts.select(F.col(group).alias("__group"), F.col("__range").alias("__at"), (F.lit(n) - F.sum("__n").over(before) + F.col("__n")).alias("__left"), "__n").filter("__left > 0")
    taken = ranged.join(left, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__at")))
    whole = taken.filter("__n <= __left").select(*frame.columns)
    place = F.row_number().over(Window.partitionBy("__range", group).orderBy("__place"))
    cut = taken.filter("__n > __left").repartitionById(parts, "__range").withColumn("__nth", place).filter("__nth <= __left")
    return whole.unionByName(cut.select(*frame.columns))


def skip_rows(frame: DataFrame, keys: list[str], n: int, last: dict | None = None) -> DataFrame:
    """The rows after the first n in key order; if the last one skipped is not `last`, the scan fails.

    A run that resumes names the row that it finished with, so a table that changed meanwhile is noticed.
    """
    placed = position(frame, keys)
    after = F.col("position") >= n
    if last:
        same = F.lit(True)
        for k, v in last.items():
            same = same & F.col(k).eqNullSafe(F.lit(v))
        wrong = F.raise_error(F.lit("the last row skipped is not the one that was finished with")).cast("boolean")
        after = F.when((F.col("position") == n - 1) & ~same, wrong).otherwise(after)
    return placed.filter(after).drop("position")
