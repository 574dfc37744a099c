"""Where a program keeps state between steps: Parquet in a folder that all executors share."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.errors import StrataError


class Storage:
    """write() cuts lineage: the result is read from files, so a lost executor costs no rework of earlier steps."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise StrataError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file:///tmp/strata-state"  # one machine: its folder is shared
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.folder, self._next = spark, f"{base.rstrip('/')}/program-{uuid.uuid4().hex}", itertools.count()

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.counted(df, name)[0]

    def counted(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
        """write(), and the number of rows, which the same job counts. Threads may write at once."""
        return self.counted_at(df, f"{self.folder}/{next(self._next):06}-{name.replace('.', '-')}")

    def counted_at(self, df: DataFrame, path: str) -> tuple[DataFrame, int]:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def dealt(self, df: DataFrame, by: str, name: str = "t") -> dict[str, DataFrame]:
        """df written once, in a folder for each value of a string column; a frame for each value that occurs. Values must be few."""
        path = f"{self.folder}/{next(self._next):06}-{name.replace('.', '-')}"
        df.withColumn("_by", F.col(by)).write.partitionBy("_by").parquet(path)
        found = self.spark.read.schema(df.schema.add("_by", "string")).parquet(path)
        return {r[0]: found.where(F.col("_by") == r[0]).drop("_by") for r in found.select("_by").distinct().collect()}

    def drop(self) -> None:
        """Deletes all files that write() made; frames read from them can't be read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
