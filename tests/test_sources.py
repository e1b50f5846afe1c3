import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordinals import position
from tessera.sources import records
from tessera.streaming import merging


def pairs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("hi"), F.col("l_suppkey").alias("lo"))


@pytest.mark.parametrize("tier", sorted(records.TIERS))
def test_tiers_hold_the_same_records(spark, sf_dir, tmp_path, tier):
    rows = pairs(spark, sf_dir)
    records.write_records(rows, f"{tmp_path}/x", ["hi", "lo"], tier)
    back = records.open_records(spark, f"{tmp_path}/x")
    assert sorted(back.collect()) == sorted(rows.collect())


def test_scan_refuses_what_is_no_record_file(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not a record file")
    assert records.open_records(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(f"{tmp_path}/other")
    assert records.open_records(spark, f"{tmp_path}/other") is None


def test_scan_refuses_other_rows_or_bytes_than_expected(spark, tmp_path):
    records.write_records(spark.range(90).selectExpr("id AS hi", "id AS lo"), f"{tmp_path}/x", ["hi", "lo"])
    size = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/x/*.parquet"))
    assert records.open_records(spark, f"{tmp_path}/x", rows=90, size=size).count() == 90
    assert records.open_records(spark, f"{tmp_path}/x", rows=91) is None and records.open_records(spark, f"{tmp_path}/x", size=size - 1) is None
    os.unlink(glob.glob(f"{tmp_path}/x/*.parquet")[0])
    assert records.open_records(spark, f"{tmp_path}/x", rows=90) is None


def test_levels_are_pruned_and_segments_join(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("level"), (F.col("id") % 2).cast("int").alias("player"), "id")
    records.write_levels(rows, f"{tmp_path}/levels")
    found = records.read_levels(spark, f"{tmp_path}/levels", level=2, player=0)
    assert sorted(r.id for r in found.collect()) == list(range(2, 40, 4))
    assert "PartitionFilters: [isnotnull(level" in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins what is as small as here
    records.write_levels(spark.range(4000).selectExpr("7 AS level", "1 AS player", "id"), f"{tmp_path}/levels")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/levels/level=7/player=1/*.parquet")) > 1  # more than one task
    rows.filter("id < 5").select("id").write.parquet(f"{tmp_path}/a")
    rows.filter("id >= 5").select("id", "level").write.parquet(f"{tmp_path}/b")
    joined = records.concatenate(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("dups", T.LongType())])
    new = records.evolve(joined, schema).collect()
    assert len(new) == 40 and all(r.level == (r.id % 4 if r.id >= 5 else 0) and r.dups == 0 for r in new)


def test_compaction_and_report(spark, sf_dir, tmp_path):
    rows = pairs(spark, sf_dir)
    rows.repartition(20).write.parquet(f"{tmp_path}/small")
    records.compact(spark, f"{tmp_path}/small", f"{tmp_path}/large", ["hi", "lo"])
    assert spark.read.parquet(f"{tmp_path}/large").count() == rows.count()
    records.write_report(spark.createDataFrame([(1, None), (2, 5.5)], "level int, ratio double"), f"{tmp_path}/csv")
    assert open(glob.glob(f"{tmp_path}/csv/*.csv")[0]).read().split() == ["level,ratio", "1,", "2,5.5"]


def test_positions_of_empty_and_single_tables(spark):
    one = spark.createDataFrame([(5, 6)], "hi long, lo long")
    assert [tuple(r) for r in position(one, ["hi", "lo"]).collect()] == [(5, 6, 0)]
    assert position(one.limit(0), ["hi", "lo"]).count() == 0


def test_stream_emits_each_key_once_and_resumes(spark, sf_dir, tmp_path):
    rows = pairs(spark, sf_dir)
    rows.filter("lo % 2 = 0").write.parquet(f"{tmp_path}/in")
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    for more in (None, "lo % 2 = 1"):
        if more:
            rows.filter(f"{more} OR lo = 2").write.mode("append").parquet(f"{tmp_path}/in")
        merging.run_to_table(merging.merged(merging.arriving(spark, f"{tmp_path}/in", rows.schema), ["hi", "lo"]), out, mark)
    got = spark.read.parquet(out)
    assert sorted(got.collect()) == sorted(rows.distinct().collect()) and os.path.exists(mark)
