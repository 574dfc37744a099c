"""Tables that outlive a program: a folder of numbered snapshots. A snapshot counts once Spark has committed it (_SUCCESS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numbers(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    good = [f.getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in good if n.startswith("v="))


def latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    numbers = _numbers(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={numbers[-1]}") if numbers else None


def commit(df: DataFrame, path: str, keep: int = 2) -> None:
    """A new snapshot; all but the last few go."""
    spark = df.sparkSession
    numbers = _numbers(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/v={(numbers[-1] if numbers else 0) + 1}")
    for n in numbers[: -keep + 1] if keep > 1 else numbers:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def commit_manifest(spark: SparkSession, folder: str, frames: list[tuple[str, str, DataFrame]], numbers: dict[str, int], keep: int = 2) -> None:
    """A new version of some frames and numbers: the frames first, then the list of them, whose commit makes the version count."""
    versions = _numbers(spark, f"{folder}/manifest")
    n = (versions[-1] if versions else 0) + 1
    rows = [("number", k, "", int(v)) for k, v in numbers.items()]
    for i, (kind, name, df) in enumerate(frames):
        path = f"{folder}/frames/v={n}/{i:04}-{name.replace('.', '-')}"
        df.write.mode("overwrite").parquet(path)
        rows.append((kind, name, path, 0))
    spark.createDataFrame(rows, "kind string, name string, path string, n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={n}")
    for old in versions[: -keep + 1] if keep > 1 else versions:
        clear(spark, f"{folder}/manifest/v={old}")
        clear(spark, f"{folder}/frames/v={old}")


def read_manifest(spark: SparkSession, folder: str) -> tuple[list[tuple[str, str, str]], dict[str, int]] | None:
    """(kind, name, path) of the last version's frames, and its numbers."""
    versions = _numbers(spark, f"{folder}/manifest")
    if not versions:
        return None
    rows = spark.read.parquet(f"{folder}/manifest/v={versions[-1]}").orderBy("path").collect()  # a row for each collection
    return [(r.kind, r.name, r.path) for r in rows if r.kind != "number"], {r.name: r.n for r in rows if r.kind == "number"}


def clear(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def watch(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder as rows (name, value), none where there is no folder: a stand-in for a mirror of a coordination service's
    nodes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "name string, value string")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("value"))
