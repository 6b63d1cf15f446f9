"""A log of micro-batches that a sink writes and readers see whole: one folder a batch, and a base that replaces old ones.

A batch that runs twice writes the same folder again.  A folder counts once its
writer has finished it (its ``_SUCCESS`` file), so a write that dies is not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class BatchLog:
    """Batches under ``path``, as ``batch=<id>`` and ``base=<id>`` (all batches up to that id)."""

    path: str
    schema: StructType

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def finished(self, spark: SparkSession, kind: str) -> list[int]:
        """Ids of the finished folders of a kind, in order."""
        fs, path = self._files(spark)
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if p.getName().startswith(f"{kind}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write a batch; writing it again replaces it."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _parts(self, spark: SparkSession) -> list[str]:
        base = self.finished(spark, "base")[-1:]
        return [f"base={b}" for b in base] + [f"batch={b}" for b in self.finished(spark, "batch") if not base or b > base[0]]

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows: those of the base and of the batches after it."""
        return self._read(spark, self._parts(spark))

    def newest(self, spark: SparkSession) -> DataFrame:
        """The rows of the last batch alone."""
        return self._read(spark, [f"batch={b}" for b in self.finished(spark, "batch")[-1:]])

    def last(self, spark: SparkSession, keys: list[str], version: str) -> DataFrame:
        """The row of each key with the greatest `version`."""
        rest = [f.name for f in self.schema if f.name not in keys]
        best = self.rows(spark).groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("last"))
        return best.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])

    def forget(self, spark: SparkSession, before: int) -> None:
        """Delete the batches before an id, and bases before the last one."""
        fs, path = self._files(spark)
        old = [f"batch={b}" for b in self.finished(spark, "batch") if b < before] + [f"base={b}" for b in self.finished(spark, "base")[:-1]]
        for name in old:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)

    def compact(self, spark: SparkSession, keys: list[str], version: str) -> None:
        """Put a base of the last versions in the place of all batches; readers see the old or the new rows, never part of them."""
        batches = self.finished(spark, "batch")
        if batches:
            self.last(spark, keys, version).write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")
            self.forget(spark, batches[-1] + 1)
