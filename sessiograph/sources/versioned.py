"""A table in hash buckets of a key, with versions: an upsert rewrites the buckets it touches and no others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import upsert_by_session

BUCKETS = 64


class BucketedTable:
    """Folders ``v=<version>/bucket=<n>`` and one small file per version that says which version holds each bucket.

    A version exists once its file does, so a reader never sees half an upsert, and an upsert that is repeated under the
    same number replaces its own folders. Only the files of versions (BUCKETS numbers each) are read by the driver.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []

    def _held(self, version: int) -> dict[str, int]:
        """Version in which each bucket that has rows was last written."""
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}").first()[0])

    def _commit(self, version: int, held: dict[str, int]) -> None:
        text = self.spark.createDataFrame([(json.dumps(held),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/next-{version}")
        (source, fs), (target, _) = self._fs(f"{self.path}/next-{version}"), self._fs(f"{self.path}/versions/{version}")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            fs.delete(target, True)
        fs.rename(source, target)

    def _write(self, rows: DataFrame, version: int) -> list[str]:
        """Write rows (with ``bucket``) as folders of this version and return the buckets that have any."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        where, fs = self._fs(f"{self.path}/v={version}")
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame, version: int = -1) -> None:
        self._commit(version, {b: version for b in self._write(self._bucketed(rows), version)})

    def _read(self, held: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._held(self.versions()[-1] if version is None else version))

    def upsert(self, new: DataFrame, version: int) -> None:
        """The rows of the keys in ``new`` are replaced; read and written are the buckets of these keys alone."""
        before = [v for v in self.versions() if v < version]
        held = self._held(before[-1]) if before else {}
        new = self._bucketed(new)
        touched = {str(r.bucket) for r in new.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        old = self._bucketed(self._read({b: v for b, v in held.items() if b in touched}))
        written = self._write(upsert_by_session(old, new, self.key), version) if touched else []
        self._commit(version, {**{b: v for b, v in held.items() if b not in touched}, **{b: version for b in written}})

    def vacuum(self) -> None:
        """Delete all versions but the last, and every bucket folder that the last one does not use."""
        *old, last = self.versions()
        held = self._held(last)
        for v in old:
            where, fs = self._fs(f"{self.path}/versions/{v}")
            fs.delete(where, True)
        where, fs = self._fs(self.path)
        for folder in [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("v=")]:
            version = int(folder.getName()[2:])
            for bucket in [s.getPath() for s in fs.listStatus(folder)]:
                if held.get(bucket.getName().removeprefix("bucket=")) != version:
                    fs.delete(bucket, True)
