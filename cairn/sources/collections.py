"""Collections as folders of Parquet under one root, each with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "collection string, model_hash string, dimension int, profile string, required_scopes array<string>, tenants array<string>"


class Collections:
    """Listing, existence and writing go through Spark's own file system, so that any store it reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        root = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()) if self._fs.exists(root) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}/points"))

    def points(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/points")

    def schema(self, name: str) -> StructType:
        return self.points(name).schema

    def ensure(self, name: str, empty: DataFrame, manifest: DataFrame) -> None:
        """Create it with a schema and a manifest, unless it is there."""
        if not self.exists(name):
            empty.limit(0).write.parquet(f"{self.root}/{name}/points")
            self.put_manifest(name, manifest)

    def recreate(self, name: str, empty: DataFrame, manifest: DataFrame) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
        self.ensure(name, empty, manifest)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write the new points beside the old and change over, since they are mostly made from the old."""
        fresh, now = f"{self.root}/{name}/points_new", f"{self.root}/{name}/points"
        rows.write.mode("overwrite").parquet(fresh)
        self._fs.delete(self._path(now), True)
        self._fs.rename(self._path(fresh), self._path(now))

    def put_manifest(self, name: str, manifest: DataFrame) -> None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/{name}/manifest")

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/{name}/manifest")

    def manifests(self) -> DataFrame:
        """All of them, by listing once."""
        found = [f"{self.root}/{n}/manifest" for n in self.names()]
        return self.spark.read.schema(MANIFEST).json(found) if found else self.spark.createDataFrame([], MANIFEST)

    def pending(self, name: str, flag: str = "summary_pending") -> int:
        return self.points(name).where(F.col(flag)).count()
