"""A keyed table in hash buckets, kept up to date by batches.

A batch reads and writes only the buckets that its keys fall into. A manifest per version
names the folder of every bucket; writing it, by a rename, is what makes a version: a batch
that ends before leaves the old version, one that runs again changes nothing. Folders that
neither the last two versions name are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

BUCKETS = 64


class KeyedSnapshot:
    """``merge`` makes one row per key of old and new rows together; it must not mind repeated rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: ST.StructType, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.merge, self.buckets = spark, path.rstrip("/"), key, schema, merge, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of the versions whose manifests are there, in order."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folder of every bucket that has rows, in a version (the last one)."""
        known = self.versions()
        if not known:
            return {}
        stream = self._fs.open(self._at(f"manifests/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._rows(sorted(self.manifest().values()))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, version: int) -> list[int]:
        """Merge a batch as the given version; the buckets that were written (none if it is there)."""
        if version in self.versions():
            return []
        now = self.manifest()
        rows = batch.select(*[f.name for f in self.schema])
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most one row per bucket
        held = self._rows([now[str(b)] for b in touched if str(b) in now])
        data = f"data/{version}"
        merged = self.merge(held.unionByName(rows)).select(*[f.name for f in self.schema], self.bucket().alias("_bucket"))
        merged.repartition(len(touched) or 1, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{data}")
        self._switch(version, now | {str(b): f"{data}/_bucket={b}" for b in touched})
        return touched

    def _switch(self, version: int, manifest: dict[str, str]) -> None:
        draft, final = self._at(f"manifests/{version}.draft"), self._at(f"manifests/{version}.json")
        out = self._fs.create(draft, True)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {version} could not be switched to")
        kept = self.versions()
        named = set(manifest.values()) | set(self.manifest(kept[-2]).values() if len(kept) > 1 else ())
        for folder in self._fs.listStatus(self._at("data")):
            for part in self._fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named and int(folder.getPath().getName()) <= version:
                    self._fs.delete(part.getPath(), True)
        for old in kept[:-2]:
            self._fs.delete(self._at(f"manifests/{old}.json"), False)
