"""An index of sorted keys in files of key ranges, which is checked, searched and merged into in place.

Every file holds the distinct keys of its range in order with their ordinals within the file, and the
distinct prefixes (all parts of the key but the last) likewise.  A manifest has a row for each file: rows,
prefixes, bytes, least and greatest key.  The offset of a file is the sum of the rows before it, so new keys
move a file's offset and leave the file as it is.

A merge rewrites only files whose ranges new keys fall into; the others stay untouched.  A search finds the
files by their ranges and the prefixes in them first; their intervals of ordinals are pushed down to the
scan of the leaves, which skips row groups.  Before use, the files are compared with the manifest in
tasks: a file that is missing, was cut or is not listed refuses the index.

Rows name their file by its number in the order of the manifest, which holds for one version: paths are long.
Every task gets about as many rows as a file or as RANGE_ROWS, however many there are; the manifest is broadcast.

Keys hold no nulls.  A manifest is a version of its own, written under its name at once: a merge that was
stopped leaves the version before it, and files that no version lists are deleted by vacuum().
"""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordinals import RANGE_ROWS, carry_forward, ranges
from tessera.sources.tables import store

#: Intervals of ordinals that a scan of the leaves is given at most; neighbours are joined beyond it.
INTERVALS = 64


def _batch_counts(keys: list[str]):
    def counts(batches):
        import pyarrow as pa

        for batch in batches:
            told = pa.Table.from_batches([batch]).group_by(keys).aggregate([([], "count_all")])
            yield from told.select([*keys, "count_all"]).to_batches()

    return counts


class DamagedIndex(ValueError):
    """Files differ from what the manifest says."""


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], rows_per_file: int = 5_000_000, row_group: int = 8 << 20):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.rows_per_file, self.row_group = rows_per_file, row_group

    # --- manifest -----------------------------------------------------------------------------------

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The last committed version, or 0."""
        fs, where = self._fs("manifest")
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(self._fs(f"manifest/{n}/_SUCCESS")[1])), default=0)

    def manifest(self) -> DataFrame:
        """(file, rows, prefixes, bytes, least, greatest, offset, no) of the files, one row each."""
        told = self.spark.read.parquet(f"{self.path}/manifest/v{self.version()}")  # which must be there
        order = Window.orderBy("least")  # one row per file
        return told.withColumns({"offset": F.sum("rows").over(order) - F.col("rows"), "no": F.row_number().over(order) - 1})

    def _key(self, names: list[str] | None = None) -> Column:
        return F.struct(*(F.col(k) for k in names or self.keys))

    def _write(self, rows: DataFrame, n: int, part: Column, kept: DataFrame | None) -> None:
        """Write rows, no file with rows of two parts, and a version of the manifest that lists them and the files kept."""
        where, version = f"{self.path}/data/{uuid.uuid4().hex}", self.version() + 1
        dealt = rows.withColumn("__part", part).repartitionByRange(n, "__part", *self.keys).withColumn("__task", F.spark_partition_id())
        # What one task got of one part is one file, so this window is as large as a file, and no task has more.
        dealt = dealt.repartitionById(n, "__task")
        order = Window.partitionBy("__task", "__part").orderBy(*self.keys)
        prefix = self._key(self.keys[:-1])
        begins = ~F.coalesce(F.lag(prefix).over(order) == prefix, F.lit(False))
        placed = dealt.select(*self.keys, (F.row_number().over(order) - 1).cast("long").alias("ordinal"), begins.alias("begins"), F.concat_ws("-", "__part", "__task").alias("part"))
        placed.sortWithinPartitions("part", *self.keys).write.option("parquet.block.size", self.row_group).partitionBy("part").parquet(where)
        schema = T.StructType([f for f in placed.schema if f.name != "part"])
        new = self._told(self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(where))
        every = new if kept is None else kept.select(*new.columns).unionByName(new)
        every.write.parquet(f"{self.path}/manifest/v{version}")

    def _told(self, rows: DataFrame) -> DataFrame:
        """Manifest rows of files, from what they hold."""
        return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("rows"), F.count_if("begins").alias("prefixes"), F.first("_metadata.file_size").alias("bytes"), F.min(self._key()).alias("least"), F.max(self._key()).alias("greatest")
        )

    def files(self, numbers: DataFrame | None = None) -> list[str]:
        """Paths of the files in key order, or of those with these numbers (no): as many as a scan of them has anyway."""
        told = self.manifest() if numbers is None else self.manifest().join(numbers.select("no").distinct(), "no", "left_semi")
        return [r.file for r in told.orderBy("no").select("file").collect()]

    def _scan(self, files: list[str]) -> DataFrame:
        """(keys, ordinal, begins) of some files."""
        schema = T.StructType([*self.manifest().schema["least"].dataType, T.StructField("ordinal", T.LongType()), T.StructField("begins", T.BooleanType())])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_size")))

    # --- build, read, check -------------------------------------------------------------------------

    def build(self, frame: DataFrame) -> None:
        """The distinct keys of the frame as the first version."""
        rows = store(self._counted(frame).select(*self.keys), "keys")
        self._write(rows, max(1, -(-rows.count() // self.rows_per_file)), F.lit("all"), None)

    def rows(self, files: list[str] | None = None) -> DataFrame:
        """(keys, ordinal, begins, file) of all listed files, or of some."""
        return self._scan(self.files() if files is None else files).select(*self.keys, "ordinal", "begins", F.col("_metadata.file_path").alias("file"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows of files with the number of their file and their place in the whole order, as they are read: paths go no further."""
        told = rows.join(F.broadcast(self.manifest().select("file", "no", "offset")), "file").drop("file")
        return told.withColumn("position", F.col("offset") + F.col("ordinal"))

    def positions(self) -> DataFrame:
        """All keys with their places."""
        return self._placed(self.rows()).select(*self.keys, "position")

    def prefixes(self) -> DataFrame:
        """The level above the keys: distinct prefixes with the place of their first key.

        A prefix that goes on in a further file begins there anew; its least place is the first.
        """
        return self._placed(self.rows().filter("begins")).groupBy(*self.keys[:-1]).agg(F.min("position").alias("offset"))

    def check(self, deep: bool = False) -> None:
        """Refuse the index unless its files are those of the manifest, by size and by the rows that footers tell.

        deep reads the keys as well, and compares prefixes and ranges.
        """
        told, files = self.manifest().drop("offset"), self.files()
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data")
        sizes = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("found_bytes"))
        why = F.when(F.col("rows").isNull(), "is not listed").when(F.col("found_bytes").isNull(), "is missing").when(F.col("found_bytes") != F.col("bytes"), "has another size")
        self._refuse(told.join(sizes, "file", "full").select("file", why.alias("why")).filter("why IS NOT NULL"))
        scan = self._scan(files)
        held = self._told(scan) if deep else scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
        names = [c for c in held.columns if c not in ("file", "bytes")]
        compared = told.join(held.select("file", *(F.col(c).alias(f"found_{c}") for c in names)), "file", "left")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in names])
        try:
            self._refuse(compared.filter(~same).select("file", F.lit("holds other rows").alias("why")))
        except (Py4JJavaError, CapturedException) as unreadable:
            raise DamagedIndex(f"a file cannot be read: {unreadable}") from unreadable

    def _refuse(self, wrong: DataFrame) -> None:
        if some := wrong.limit(10).collect():
            raise DamagedIndex("; ".join(f"{r.file} {r.why}" for r in some))

    # --- search and merge ---------------------------------------------------------------------------

    def _counted(self, frame: DataFrame) -> DataFrame:
        """(keys, __rows) of the distinct keys: counted batch by batch first, so a hot key is a few rows of its task."""
        asked = frame.select(*self.keys)
        told = asked.mapInArrow(_batch_counts(self.keys), T.StructType([*asked.schema, T.StructField("count_all", T.LongType())]))
        return told.repartition(ranges(self.spark, asked.count()), *self.keys).groupBy(*self.keys).agg(F.sum("count_all").alias("__rows"))

    def _in_files(self, frame: DataFrame) -> DataFrame:
        """Rows with the number of the file whose range their keys fall into: the last one that begins at or before them, or the first.

        The files' beginnings and the keys lie in one order, and the file is carried on.
        """
        told = self.manifest()
        marks = told.select(*(F.col(f"least.{k}").alias(k) for k in self.keys), F.col("no").alias("__no"), F.lit(0).alias("__side"))
        both = marks.unionByName(frame.withColumn("__side", F.lit(1)), allowMissingColumns=True)
        carried = carry_forward(both, [*self.keys, "__side"], "__no", "__found").filter("__side = 1")
        return carried.select(*frame.columns, F.coalesce("__found", F.lit(0)).alias("no"))

    def lookup(self, frame: DataFrame) -> DataFrame:
        """Rows of the frame with the position of their key; null where it is not in the index.

        Tasks hold the index's keys as a hash table and the frame's rows pass by, unsorted.  A key of more than
        RANGE_ROWS rows is dealt to as many tasks as it needs: there are fewer such keys than tasks.
        """
        wanted = store(self._in_files(self._counted(frame)), "wanted")
        found = self._placed(self.leaves(wanted.drop("__rows"), self.files(wanted))).select(*self.keys, "position")
        n = ranges(self.spark, frame.count())
        hot = wanted.filter(F.col("__rows") > RANGE_ROWS).select(F.struct(*self.keys).alias("__hot"), F.ceil(F.col("__rows") / RANGE_ROWS).cast("int").alias("__tasks"))

        def shared(rows: DataFrame, share: Column) -> DataFrame:
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__hot.{k}")) for k in self.keys])
            told = rows.join(F.broadcast(hot), same, "left").withColumn("__tasks", F.coalesce("__tasks", F.lit(1)))
            return told.withColumn("__share", share).drop("__hot", "__tasks").repartition(n, *self.keys, "__share")

        left = shared(frame, (F.monotonically_increasing_id() % F.col("__tasks")).cast("int"))
        right = shared(found, F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1)))
        return left.join(right.hint("shuffle_hash"), [*self.keys, "__share"], "left").select(*frame.columns, "position")

    def leaves(self, wanted: DataFrame, files: list[str]) -> DataFrame:
        """(keys, ordinal, file) of the leaves that may be wanted (keys, no), in these files.

        The prefixes are found first; the leaves between each and the next one are an interval of ordinals.
        Of all intervals, those that begin in one of INTERVALS equal parts of a file are read as one.
        """
        rows, above = self.rows(files), self.keys[:-1]
        prefixes = self.manifest().agg(F.sum("prefixes")).first()[0] or 0
        dealt = self._placed(rows.filter("begins")).select(*above, "ordinal", "no").repartition(ranges(self.spark, prefixes), "no")
        ends = dealt.withColumn("until", F.lead("ordinal").over(Window.partitionBy("no").orderBy("ordinal")))
        inside = ends.join(wanted.select("no", *above).distinct(), ["no", *above], "left_semi")
        part = F.least(F.lit(INTERVALS - 1), F.floor(F.col("ordinal") * INTERVALS / self.rows_per_file))
        spans = inside.groupBy(part.alias("part")).agg(F.min("ordinal").alias("low"), F.max(F.coalesce("until", F.lit(1 << 62))).alias("high")).collect()
        pushed = reduce(Column.__or__, [(F.col("ordinal") >= r.low) & (F.col("ordinal") < r.high) for r in spans], F.lit(False))
        return rows.filter(pushed).select(*self.keys, "ordinal", "file")

    def merge(self, frame: DataFrame) -> dict:
        """Add keys; only files whose ranges new ones fall into are written again.  How many files stayed and went."""
        given = store(self._in_files(self._counted(frame).select(*self.keys)), "given")
        told, asked = self.manifest(), given.count()
        if not (held := told.agg(F.sum("rows")).first()[0]):
            if asked:
                self._write(given.select(*self.keys), max(1, -(-asked // self.rows_per_file)), F.lit("all"), None)
            return {"kept": 0, "rewritten": 0}
        # Both sides have each key once; the hash tables are of the index's keys.
        n = ranges(self.spark, asked + held)
        there = self.rows(self.files(given)).select(*self.keys).repartition(n, *self.keys).hint("shuffle_hash")
        new = store(given.repartition(n, *self.keys).join(there, self.keys, "left_anti"), "new")
        went, gone = self.files(new), new.select("no").distinct()
        if went:
            every = store(self._placed(self.rows(went)).select(*self.keys, "no").unionByName(new.select(*self.keys, "no")), "every")
            self._write(every, max(len(went), -(-every.count() // self.rows_per_file)), F.col("no"), told.join(gone, "no", "left_anti"))
        return {"kept": told.count() - len(went), "rewritten": len(went)}

    def vacuum(self) -> int:
        """Delete files that the last version does not list; how many."""
        context = self.spark._jvm.org.apache.hadoop.fs
        keep = {context.Path(f).toUri().getPath() for f in self.files()}
        fs, where = self._fs("data")
        found, gone = fs.listFiles(where, True), 0
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet") and path.toUri().getPath() not in keep:
                gone += bool(fs.delete(path, False))
        return gone
