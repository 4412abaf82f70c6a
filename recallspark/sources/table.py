"""Tables that are kept: hash buckets, copied on write, under a manifest.

A table is a folder of Parquet files, a folder for each bucket and version, and
manifests ``manifest-N`` of one JSON line: which version each bucket stands in, how
many rows it has, and marks of the writes that are in it. A write touches the buckets
of its keys only: each is read, changed and written anew, and a new manifest names
them with the untouched ones as they were. A reader opens one manifest, so it sees
a whole version or the one before; the last two manifests and their buckets are
kept. A write under a mark that the manifest has is not done again.

Paths are read and written by Spark's own file systems, so a table can stand in any
store that Spark reads. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions that are kept, and marks of writes.
KEEP, MARKS = 2, 1000


class Folder:
    """A folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark._jvm
        self.jvm, self.path = jvm, path.rstrip("/")
        self.fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        return [x.getPath().getName() for x in self.fs.listStatus(root)] if self.fs.exists(root) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so that no reader meets a part of it."""
        stream = self.fs.create(self.at(f"_{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.at(f"_{name}"), self.at(name)):
            raise RuntimeError(f"{name} is there already")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Versions:
    """A small table that is written whole: version N below ``path``, two kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def read(self, number: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder.path}/v{number}") if number >= 0 and f"v{number}" in self.folder.names() else None

    def write(self, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder.path}/v{number}")
        for name in self.folder.names():
            if name[1:].isdigit() and int(name[1:]) <= number - KEEP:
                self.folder.delete(name)


class Table:
    """A table of rows with a key, in hash buckets."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.folder, self.manifest = spark, Folder(spark, path), manifest

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, buckets: int, schema: StructType) -> Table:
        """The table at ``path``, which is made, empty, if it is not there: get or
        create. One that is there keeps its own number of buckets and its columns."""
        folder = Folder(spark, path)
        found = [int(n.removeprefix("manifest-")) for n in folder.names() if n.startswith("manifest-")]
        if found:
            return cls(spark, path, json.loads(folder.read(f"manifest-{max(found)}")))
        manifest = {"version": 0, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "parts": {}, "marks": []}
        folder.write("manifest-0", json.dumps(manifest))
        return cls(spark, path, manifest)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.manifest["buckets"])).cast("int")

    def _paths(self, buckets: list[str] | None = None) -> list[str]:
        return [f"{self.folder.path}/v{p['version']}/bucket={b}" for b, p in self.manifest["parts"].items() if p["rows"] and (buckets is None or b in buckets)]

    def _read(self, buckets: list[str] | None = None) -> DataFrame:
        paths = self._paths(buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows, as of the version that was opened or last written."""
        return self._read()

    def get(self, *keys: object) -> DataFrame:
        """The rows of a few keys; only their buckets are read."""
        own = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.manifest["key"]]]))
        name = self.manifest["key"]
        buckets = [str(r[0]) for r in own.select(self.bucket_of(F.col(name))).distinct().collect()]
        return self._read(buckets).where(F.col(name).isin(*keys))

    def count(self) -> int:
        """The number of rows, from the manifest."""
        return sum(p["rows"] for p in self.manifest["parts"].values())

    def _changed(self, touched: list[int], change: Callable[[DataFrame], DataFrame], done: str | None) -> None:
        """Writes the touched buckets anew and then the manifest that names them."""
        version = self.manifest["version"] + 1
        rows = change(self._read([str(b) for b in touched])).select(*self.schema.fieldNames())
        out = f"{self.folder.path}/v{version}"
        bucketed = rows.withColumn("bucket", self.bucket_of(F.col(self.manifest["key"]))).repartition(max(1, len(touched)), "bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(out)
        sizes = {r[0]: r[1] for r in self.spark.read.parquet(out).groupBy("bucket").count().collect()} if touched and any(n.startswith("bucket=") for n in Folder(self.spark, out).names()) else {}
        parts = dict(self.manifest["parts"]) | {str(b): {"version": version, "rows": sizes.get(b, 0)} for b in touched}
        marks = [*self.manifest["marks"], *([done] if done else [])][-MARKS:]
        new = self.manifest | {"version": version, "parts": parts, "marks": marks}
        self.folder.write(f"manifest-{version}", json.dumps(new))
        self.manifest = new
        self._clean()

    def _clean(self) -> None:
        """Drops manifests but the last two, and buckets that neither names."""
        old = sorted(int(n.removeprefix("manifest-")) for n in self.folder.names() if n.startswith("manifest-"))
        for n in old[:-KEEP]:
            self.folder.delete(f"manifest-{n}")
        used = {(p["version"], b) for n in old[-KEEP:] for b, p in json.loads(self.folder.read(f"manifest-{n}"))["parts"].items()}
        for name in self.folder.names():
            if name[:1] == "v" and name[1:].isdigit():
                inside = Folder(self.spark, f"{self.folder.path}/{name}")
                own = [b.removeprefix("bucket=") for b in inside.names() if b.startswith("bucket=")]
                for b in own:
                    if (int(name[1:]), b) not in used:
                        inside.delete(f"bucket={b}")
                if not any((int(name[1:]), b) in used for b in own):
                    self.folder.delete(name)

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: as many numbers as there are buckets, at most."""
        return sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.manifest["key"]))).distinct().collect())

    def upsert(self, rows: DataFrame, order: str, done: str | None = None) -> None:
        """``rows`` take the place of those of their keys; of rows of one key, stored
        ones too, the last in ``order`` stays. ``done`` marks the write: under a
        mark that the table has, nothing is done."""
        if done in self.manifest["marks"]:
            return
        key = self.manifest["key"]
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        merged = lambda old: old.unionByName(rows.select(*self.schema.fieldNames())).withColumn("__n", last).where("__n = 1").drop("__n")
        self._changed(self._touched(rows), merged, done)

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows of ``keys`` (a column named as the table's key); their number."""
        touched, before, own = self._touched(keys), self.count(), keys.select(self.manifest["key"]).distinct()
        self._changed(touched, lambda old: old.join(own, self.manifest["key"], "left_anti"), None)
        return before - self.count()

    def delete_where(self, condition: Column) -> int:
        """Deletes the rows for which ``condition`` holds; their number. Buckets
        without such rows are left as they are."""
        key = self.manifest["key"]
        return self.delete(self.read().where(condition).select(key))
