"""As-of joins: for each left row, the nearest right row of its group before or after its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import carry_forward


def asof_le(left: DataFrame, right: DataFrame, group: str, time: str, value: str, name: str, run: str = "first") -> DataFrame:
    """Add the value of the last right row at or before the left row's time; null where there is none."""
    return _nearest(left, right, group, time, value, name, run, later=False)


def asof_ge(left: DataFrame, right: DataFrame, group: str, time: str, value: str, name: str, run: str = "first") -> DataFrame:
    """Add the value of the first right row at or after the left row's time; null where there is none."""
    return _nearest(left, right, group, time, value, name, run, later=True)


def _nearest(left: DataFrame, right: DataFrame, group: str, time: str, value: str, name: str, run: str, later: bool) -> DataFrame:
    """Both sides lie in one order, cut into ranges by group and time, and the last value seen is carried on.

    Of a run of right rows with one group and time, the smallest value counts, or the largest with
    run="last".  No row is multiplied, and a group's rows may lie in many ranges: a value carried into
    another group is told by the group that it comes with.
    """
    marks = right.groupBy(group, time).agg((F.max if run == "last" else F.min)(value).alias("v"))
    facts = marks.select(group, time, F.struct(F.col(group).alias("g"), "v").alias("__mark"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__tie"))
    extra = [c for c in left.columns if c not in (group, time)]
    events = left.withColumns({"__side": F.lit(1), "__tie": F.xxhash64(*extra) if extra else F.lit(0).cast("long")})
    when = F.col(time).desc() if later else F.col(time).asc()
    rows = events.unionByName(facts, allowMissingColumns=True)
    carried = carry_forward(rows, [F.col(group), when, F.col("__side"), F.col("__tie")], "__mark", "__found").filter("__side = 1")
    found = F.when(F.col("__found.g") == F.col(group), F.col("__found.v"))
    return carried.withColumn(name, found).select(*left.columns, name)
