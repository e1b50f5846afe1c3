"""An index in files of key ranges: whole results, files that stay, reads that are pruned, damage that is refused."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordinals
from tessera.sources import index_store
from tessera.sources.index_store import DamagedIndex, IndexStore

KEYS = ["a", "b", "c"]


def local(uri):
    return uri[uri.index("/") :] if uri.startswith("file:/") else uri


def made(spark, path, rows, per_file=100, group=8 << 20):
    index = IndexStore(spark, path, KEYS, rows_per_file=per_file, row_group=group)
    index.build(spark.createDataFrame(rows, "a string, b long, c long"))
    return index


def some_rows(seed, n, first="ab"):
    random.seed(seed)
    return [(random.choice(first), random.randrange(8), random.randrange(400)) for _ in range(n)]


def placed(index):
    return {tuple(r[k] for k in KEYS): r.position for r in index.positions().collect()}


def by_prefix(rows):
    out = {}
    for i, (a, b, _) in enumerate(rows):
        out.setdefault((a, b), i)
    return out


def test_positions_and_prefixes_over_many_files(spark, tmp_path):
    rows = some_rows(1, 1500)
    index = made(spark, f"{tmp_path}/x", rows)
    want = sorted(set(rows))
    assert placed(index) == {r: i for i, r in enumerate(want)} and len(index.files()) >= 5
    assert {(r.a, r.b): r.offset for r in index.prefixes().collect()} == by_prefix(want)
    told = index.manifest().orderBy("least").collect()
    assert [r.offset for r in told] == [sum(x.rows for x in told[:i]) for i in range(len(told))]
    index.check(deep=True)


def test_a_merge_leaves_untouched_files_alone(spark, tmp_path):
    rows = some_rows(2, 1500)
    index = made(spark, f"{tmp_path}/x", rows)
    before = {f: os.stat(local(f)) for f in index.files()}
    more = [("a", 0, -5), ("a", 0, -4), *sorted(set(rows))[700:720]]
    did = index.merge(spark.createDataFrame(more, "a string, b long, c long"))
    assert did == {"kept": len(before) - 1, "rewritten": 1} and index.version() == 2
    after = index.files()
    assert len(set(after) & set(before)) == len(before) - 1
    assert all(os.stat(local(f)).st_mtime_ns == before[f].st_mtime_ns for f in set(after) & set(before))
    want = sorted({*rows, *more})
    assert placed(index) == {r: i for i, r in enumerate(want)}
    assert {(r.a, r.b): r.offset for r in index.prefixes().collect()} == by_prefix(want)
    # Keys that are there already rewrite nothing; a merge everywhere still gives the whole.
    assert index.merge(spark.createDataFrame(more, "a string, b long, c long"))["rewritten"] == 0 and index.version() == 2
    many = some_rows(3, 900, "abc")
    index.merge(spark.createDataFrame(many, "a string, b long, c long"))
    assert placed(index) == {r: i for i, r in enumerate(sorted({*want, *many}))}
    assert index.vacuum() >= 1 and index.vacuum() == 0
    index.check(deep=True)


def test_a_search_reads_the_intervals_of_its_prefixes_only(spark, tmp_path):
    rows = [("a", b, c) for b in range(40) for c in range(500)]
    index = made(spark, f"{tmp_path}/x", rows, per_file=20_000, group=4096)
    asked = [("a", 7, 3), ("a", 7, 499), ("a", 8, 1), ("a", 7, 900), ("z", 1, 1), ("", 0, 0)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(asked)], "a string, b long, c long, id int")
    place = {r: i for i, r in enumerate(sorted(rows))}
    assert {r.id: r.position for r in index.lookup(frame).collect()} == {i: place.get(r) for i, r in enumerate(asked)}
    wanted = index._in_files(frame.select(*KEYS).filter("a = 'a'"))
    leaves = index.leaves(wanted, index.files())
    plan = leaves._jdf.queryExecution().executedPlan()
    assert "PushedFilters" in plan.toString() and "GreaterThanOrEqual(ordinal" in plan.toString()
    assert leaves.count() == 1000
    assert 1000 <= rows_scanned(leaves) < 8000  # of 20,000


def rows_scanned(frame):
    """Output rows of the scan below the filter: rows of row groups that statistics did not rule out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
    raise AssertionError("no scan")


@pytest.mark.parametrize("how", ["cut", "missing", "foreign", "exchanged"])
def test_damaged_files_are_refused(spark, tmp_path, how):
    index = made(spark, f"{tmp_path}/x", some_rows(4, 900))
    index.check()
    first, second = (local(f) for f in index.files()[:2])
    for f in (first, second):  # checksums beside the files would notice first
        os.unlink(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    data = open(second, "rb").read()
    if how == "cut":
        open(first, "r+b").truncate(os.path.getsize(first) - 9)
    elif how == "missing":
        os.unlink(first)
    elif how == "foreign":
        open(os.path.join(os.path.dirname(first), "more.parquet"), "wb").write(data)
    else:
        size = os.path.getsize(first)
        open(first, "wb").write(b"PAR1" + b"\0" * (size - 8) + b"PAR1")
    with pytest.raises(DamagedIndex, match={"cut": "another size", "missing": "is missing", "foreign": "not listed", "exchanged": "cannot be read"}[how]):
        index.check()


def test_an_empty_index_grows(spark, tmp_path):
    index = made(spark, f"{tmp_path}/x", [("a", 1, 1)][:0])
    asked = spark.createDataFrame([("a", 1, 1)], "a string, b long, c long")
    assert index.files() == [] and index.lookup(asked).first().position is None
    index.merge(asked)
    assert index.lookup(asked).select(F.col("position")).first().position == 0 and placed(index) == {("a", 1, 1): 0}


def test_a_task_writes_one_file(spark, tmp_path):
    index = made(spark, f"{tmp_path}/x", some_rows(5, 1500))
    index.merge(spark.createDataFrame(some_rows(6, 1500), "a string, b long, c long"))
    new = index.files()
    tasks = {os.path.basename(f)[:10] for f in new}  # part-00007
    assert len(new) >= 12 and len(tasks) >= len(new) // 2  # a task at a border of two old files has one of each
    assert placed(index) == {r: i for i, r in enumerate(sorted({*some_rows(5, 1500), *some_rows(6, 1500)}))}


def test_a_task_of_a_lookup_does_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    for module in (ordinals, index_store):
        monkeypatch.setattr(module, "RANGE_ROWS", 50, raising=False)
    rows = some_rows(7, 1500)
    index = made(spark, f"{tmp_path}/x", rows)
    place = {r: i for i, r in enumerate(sorted(set(rows)))}
    asked = [*rows, *[rows[3]] * 700, ("zz", 1, 1), (None, 1, 1), *[("a", None, 1)] * 300]  # hot keys, one of them with a null
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(asked)], "a string, b long, c long, id int")
    found = index.lookup(frame)
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert {r.id: r.position for r in got} == {i: place.get(r) for i, r in enumerate(asked)} and len(got) == len(asked)
    assert found.columns == [*frame.columns, "position"]
    assert max(Counter(r.task for r in got).values()) < 300  # of 2,502
