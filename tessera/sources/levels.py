"""A store of levels: one Parquet folder each, committed by a manifest that is written last.

A level whose manifest is missing was not finished and is written again; a finished one is never
touched, so a run that was stopped goes on where it was.  A level may be bucketed by its key: a join on
the key then reads it as it lies, without a shuffle, and its buckets can be read a few at a time.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

BUCKET = re.compile(r".*_(\d+)(\.[^_]*)?$")


class LevelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self, name: str) -> bool:
        fs, where = self._fs(f"manifest/{name}.json")
        return fs.exists(where)

    def _commit(self, name: str, told: dict) -> None:
        """The manifest appears under its name at once or not at all."""
        fs, where = self._fs(f"manifest/{name}.json")
        _, begun = self._fs(f"manifest/{name}.begun")
        out = fs.create(begun, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not fs.rename(begun, where):
            raise OSError(f"the manifest of {name} could not be written")

    def write(self, name: str, frame: DataFrame, stats, keys: list[str] | None = None) -> dict:
        """Write the rows, then the manifest that makes them count; stats maps the stored rows to a dict.

        With keys the rows are bucketed by them, into as many buckets as a shuffle has partitions, so that the
        rows of an aggregation by these keys are written without another shuffle.
        """
        self.drop(name)
        layout = {"keys": keys, "buckets": int(self.spark.conf.get("spark.sql.shuffle.partitions"))} if keys else {}
        if keys:
            writer = frame.write.format("parquet").mode("overwrite").option("path", f"{self.path}/data/{name}")
            writer.bucketBy(layout["buckets"], *keys).sortBy(*keys).saveAsTable(self._table(name))
        else:
            frame.write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        found = stats(self._read(name, layout)) | layout
        self._commit(name, found)
        return found

    def _table(self, name: str) -> str:
        return "level_" + hashlib.sha256(f"{self.path}/{name}".encode()).hexdigest()[:24]

    def _read(self, name: str, layout: dict) -> DataFrame:
        where = f"{self.path}/data/{name}"
        if not layout.get("keys"):
            return self.spark.read.parquet(where)
        table = self._table(name)
        if not self.spark.catalog.tableExists(table):  # a new session: the files are there, their layout is in the manifest
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(where).schema)
            by = ", ".join(f"`{k}`" for k in layout["keys"])
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {layout['buckets']} BUCKETS LOCATION '{where}'")
        return self.spark.table(table)

    def read(self, name: str) -> DataFrame:
        return self._read(name, self.stats(name))

    def read_share(self, name: str, share: int, of: int) -> DataFrame:
        """The rows of every of-th bucket of a bucketed level; no other file is opened."""
        fs, where = self._fs(f"data/{name}")
        files = [str(f.getPath()) for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", "."))]
        mine = [f for f in files if (found := BUCKET.match(f)) and int(found[1]) % of == share]
        whole = self.spark.read.parquet(f"{self.path}/data/{name}")
        return self.spark.read.schema(whole.schema).parquet(*mine) if mine else whole.limit(0)

    def drop(self, name: str) -> None:
        """Delete a level, its manifest first."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        for part in (f"manifest/{name}.json", f"data/{name}"):
            fs, where = self._fs(part)
            fs.delete(where, True)

    def stats(self, name: str) -> dict:
        fs, where = self._fs(f"manifest/{name}.json")
        told = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(told, "UTF-8"))
        finally:
            told.close()

    def bytes(self, name: str) -> int:
        fs, where = self._fs(f"data/{name}")
        return fs.getContentSummary(where).getLength()

    def deepest(self, prefix: str) -> int:
        """The last committed level without a gap before it, or -1."""
        level = -1
        while self.committed(f"{prefix}-{level + 1}"):
            level += 1
        return level
