"""Ordinals, carried values and as-of joins against plain Python, with groups that span many ranges."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators import asof, nested_index, ordinals
from tessera.operators.ordinals import carry_all, carry_forward, exclusive_prefix_sum, first_rows, next_value, previous_value, skip_rows
from tessera.sources import records
from tessera.sources.metadata import footer_summary
from tessera.sources.tables import shared_dir, store, temporary_tables


def test_running_sums_and_carried_values_cross_ranges(spark):
    random.seed(3)
    rows = [(i, random.choice([None, None, None, i * 10])) for i in range(500)]
    frame = spark.createDataFrame(random.sample(rows, 500), "k long, v long")
    last, total, want_last, want_sum = None, 0, {}, {}
    for k, v in rows:
        last = last if v is None else v
        want_last[k], want_sum[k] = last, total
        total += k
    assert {r.k: r.found for r in carry_forward(frame, ["k"], "v", "found").collect()} == want_last
    assert {r.k: r.before for r in exclusive_prefix_sum(frame.drop("v"), ["k"], F.col("k"), "before").collect()} == want_sum
    assert carry_forward(frame.limit(0), ["k"], "v", "found").count() == 0


def test_several_carried_values_and_the_next_one(spark):
    random.seed(4)
    rows = [(i, random.choice([None, i]), random.choice([None, None, -i])) for i in range(300)]
    frame = spark.createDataFrame(random.sample(rows, 300), "k long, v long, w long")
    want, last = {}, [None, None]
    for k, *found in rows:
        last = [a if b is None else b for a, b in zip(last, found, strict=True)]
        want[k] = tuple(last)
    assert {r.k: (r.x, r.y) for r in carry_all(frame, ["k"], {"x": F.col("v"), "y": F.col("w")}).collect()} == want
    assert {r.k: r.after for r in next_value(frame, ["k"], "v", "after").collect()} == {k: rows[k + 1][1] if k + 1 < 300 else None for k in range(300)}
    assert {r.k: r.past for r in previous_value(frame, ["k"], "v", "past").collect()} == {k: rows[k - 1][1] if k else None for k in range(300)}
    assert next_value(frame.limit(0), ["k"], "v", "after").count() == 0


def test_a_task_holds_one_range_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 50, raising=False)
    frame = spark.createDataFrame([(k, k if k % 7 == 0 else None) for k in random.sample(range(2000), 2000)], "k long, v long")
    for told in (carry_forward(frame, ["k"], "v", "x"), next_value(frame, ["k"], "k", "x"), exclusive_prefix_sum(frame.select("k"), ["k"], F.lit(1), "x")):
        rows = told.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == 2000 and max(Counter(r.task for r in rows).values()) <= 150
    assert {r.k: r.x for r in rows} == {k: k for k in range(2000)}


@pytest.mark.parametrize("n", [0, 1, 130, 10_000])
def test_first_rows_of_a_hot_group_and_small_ones(spark, n):
    random.seed(6)
    rows = [(random.choice([1] * 8 + [2, 3, None]), i // 2, i) for i in range(600)]
    frame = spark.createDataFrame(random.sample(rows, 600), "g long, a long, b long")
    got = sorted((tuple(r) for r in first_rows(frame, "g", ["a", "b"], n).collect()), key=str)
    want = [r for g in (1, 2, 3, None) for r in sorted(x for x in rows if x[0] == g and g is not None or x[0] is g)[:n]] if n else []
    assert got == sorted(want, key=str)
    plan = first_rows(frame, "g", ["a", "b"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(g#" not in plan.replace(" ", " ")


@pytest.mark.parametrize("run", ["first", "last"])
def test_nearest_rows_of_hot_and_rare_groups(spark, run):
    random.seed(5)
    group = lambda: random.choice([1] * 6 + [2, 3, None])
    left = [(group(), random.randrange(60), i) for i in range(300)]
    right = [(group(), random.randrange(60), 1000 + i) for i in range(80)]
    a = spark.createDataFrame(left, "g long, t long, id long")
    b = spark.createDataFrame(right, "g long, t long, v long")
    pick = min if run == "first" else max
    for join, least in ((asof.asof_le, lambda t, s: s <= t), (asof.asof_ge, lambda t, s: s >= t)):
        got = {r.id: r.found for r in join(a, b, "g", "t", "v", "found", run).collect()}
        for g, t, i in left:
            times = [s for h, s, _ in right if h == g and g is not None and least(t, s)]
            at = (max if join is asof.asof_le else min)(times) if times else None
            assert got[i] == (pick(v for h, s, v in right if h == g and s == at) if times else None), (g, t, i)
        assert len(got) == len(left)


def test_expanding_a_prefix_with_nearly_all_leaves(spark):
    rows = [(1, k) for k in range(400)] + [(2, 5), (3, 1), (3, 2)]
    frame = spark.createDataFrame(rows, "a long, b long")
    leaves = nested_index.leaf(frame, ["a", "b"])
    got = nested_index.expand(nested_index.level(frame, ["a", "b"], 1), leaves.select("position", "b"), ["a", "b"]).collect()
    assert sorted((r.position, r.a, r.b) for r in got) == [(i, *r) for i, r in enumerate(sorted(rows))]


def test_resuming_behind_another_row_fails(spark):
    frame = spark.createDataFrame([(i, i * i) for i in range(50)], "k long, v long")
    assert sorted(r.k for r in skip_rows(frame, ["k"], 20, {"k": 19, "v": 361}).collect()) == list(range(20, 50))
    with pytest.raises(Exception, match="finished with"):
        skip_rows(frame, ["k"], 20, {"k": 18}).collect()


def test_a_damaged_file_is_refused(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not a record file")
    assert records.open_records(spark, f"{tmp_path}/bad.parquet") is None
    spark.range(10).selectExpr("id AS hi", "id AS lo").repartition(2).write.parquet(f"{tmp_path}/some")
    assert records.open_records(spark, f"{tmp_path}/some").count() == 10
    (tmp_path / "some" / "part-x.parquet").write_bytes(b"PAR1 cut off")
    assert records.open_records(spark, f"{tmp_path}/some") is None


def test_players_of_paths(spark):
    paths = [records.level_path(3, "black"), f"/a/{records.level_path(12, 'white')}/part-0.parquet", "player=red/x", "xplayer=black", None]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in frame.select(records.player_of(F.col("path"))).collect()] == ["black", "white", None, None, None]


def test_turns_equal_a_walk_over_cells(spark):
    random.seed(1)
    values = [random.randrange(-(1 << 63), 1 << 63) for _ in range(50)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for r in frame.select("v", *(bits.rotate(F.col("v"), k).alias(f"t{k}") for k in range(4))).collect():
        cells = {(row, col) for row in range(8) for col in range(8) if (r.v & (2**64 - 1)) >> (63 - 8 * row - col) & 1}
        for k in range(4):
            assert r[f"t{k}"] & (2**64 - 1) == sum(1 << (63 - 8 * row - col) for row, col in cells)
            cells = {(col, 7 - row) for row, col in cells}


def test_threads_leave_the_temporary_tables_of_others_alone(spark):
    begun, ended, found = threading.Barrier(2), threading.Event(), []

    def long():
        with temporary_tables(spark):
            begun.wait(60)
            mine = store(spark.range(7), "mine")
            begun.wait(60)
            ended.wait(60)
            found.append(mine.count())
            with temporary_tables(spark):
                inner = store(spark.range(3), "inner")
                found.append(inner.count())
            found.append(mine.count())

    def short():
        with temporary_tables(spark):
            begun.wait(60)
            store(spark.range(5), "other")
            begun.wait(60)
        ended.set()

    threads = [threading.Thread(target=f) for f in (long, short)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [7, 3, 7]


def test_temporary_tables_go_and_others_stay(spark, tmp_path):
    kept = store(spark.range(3), "kept")
    with temporary_tables(spark):
        gone = store(spark.range(5), "gone")
        files = gone.inputFiles()
    assert kept.count() == 3 and files
    with pytest.raises(Exception, match=r"(?i)path|file"):
        spark.read.parquet(*files).count()


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        master = "spark://host:7077"
        conf = sparkContext = _jsc = property(lambda self: self)

        def get(self, *_):
            return None

        def getConf(self):
            return self

        def sc(self):
            return self

        getCheckpointDir = sc

        def isDefined(self):
            return False

    with pytest.raises(RuntimeError, match="share"):
        shared_dir(Nothing())


def test_footers_are_read_without_touching_the_session(spark, sf_dir):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    found = footer_summary(spark, f"{sf_dir}/orders.parquet", "o_orderkey")
    assert "PushedAggregation" in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().records == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
