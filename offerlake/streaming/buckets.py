"""A keyed table that batches are merged into, bucket by bucket.

Keys are dealt to buckets by hash. A batch rewrites only the buckets that its keys are in, each as a new version, and then writes a manifest that
names the version of every bucket: the table after that batch. A batch tried again after a failure starts from the manifest before it and
writes the same versions, so nothing is merged twice. Files that neither the newest manifest nor the one before it names are dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketLog:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, list(key), buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _listed(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        """The batches whose manifests are whole."""
        return sorted(int(n[8:]) for n in self._listed(f"{self.path}/manifest") if n.startswith("version=") and "_SUCCESS" in self._listed(f"{self.path}/manifest/{n}"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket, of the newest manifest or the newest one before a batch. It has a row for each bucket."""
        some = [v for v in self.versions() if before is None or v < before]
        if not some:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version bigint").json(f"{self.path}/manifest/version={some[-1]}").collect()}

    def table(self, manifest: dict[int, int] | None = None) -> DataFrame:
        """The table's rows, or those of the buckets of a manifest."""
        held = self.manifest() if manifest is None else manifest
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())])

    def merge(self, batch: DataFrame, number: int, into: Callable[[DataFrame, DataFrame], DataFrame], dealt_by: Sequence[str] | None = None) -> None:
        """Merge a batch: `into(stored, batch)` gives the new rows of the buckets that the batch's keys are in, from their stored rows."""
        bucket = F.pmod(F.xxhash64(*(dealt_by or self.key)), F.lit(self.buckets)).cast("int")
        before = self.manifest(number)
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]          # at most as many as there are buckets
        if touched:
            after = into(self.table({b: before[b] for b in touched if b in before}), batch).select(*self.schema.names)
            rows = after.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={number}")
        written = {int(n[7:]) for n in self._listed(f"{self.path}/data/version={number}") if n.startswith("bucket=")} if touched else set()
        held = {b: v for b, v in before.items() if b not in touched} | {b: number for b in written}
        manifest = self.spark.createDataFrame(sorted(held.items()), "bucket int, version bigint")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={number}")
        self._prune(number, before, held)

    def _prune(self, number: int, before: dict[int, int], held: dict[int, int]) -> None:
        """Drop what no retry of this batch and no reader of its table can ask for."""
        known = [v for v in self.versions() if v <= number]
        for v in known[:-2]:
            fs, p = self._fs(f"{self.path}/manifest/version={v}")
            fs.delete(p, True)
        named = {*before.items(), *held.items()}
        for n in self._listed(f"{self.path}/data"):
            v = int(n[8:])
            if v > number:
                continue
            for b in self._listed(f"{self.path}/data/{n}"):
                if b.startswith("bucket=") and (int(b[7:]), v) not in named:
                    fs, p = self._fs(f"{self.path}/data/{n}/{b}")
                    fs.delete(p, True)
