"""What a program's steps did: cardinalities, times, and scan counts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans.program import Program


def cardinalities(p: Program) -> DataFrame:
    """step, collection and rows, of a program made with trace=True."""
    return p.spark.createDataFrame(p.trace_log or [], "tick long, table_name string, n long")


def contents(p: Program, name: str) -> DataFrame:
    """A collection's rows in every step so far, with the step first, of a program made with trace=True."""
    each = [df[name].select(F.lit(k).cast("long").alias("tick"), *df[name].columns) for k, df in p.trace_states if name in df]
    return reduce(lambda a, b: a.unionByName(b), each)


def messages(p: Program, kind: str) -> DataFrame:
    """What was `sent` or `received`: pred, tuple (as JSON), time and step of each row; of a program made with trace=True."""
    frames = [df.select(F.lit(name).alias("pred"), F.to_json(F.struct(*df.columns)).alias("tuple"), F.lit(at).alias("time"), F.lit(k).cast("long").alias("tick")) for what, k, name, df, at in p.message_log if what == kind]
    return reduce(lambda a, b: a.unionByName(b), frames, p.spark.createDataFrame([], "pred string, tuple string, time double, tick long"))


def sleeps(p: Program) -> DataFrame:
    """When the program, in the background, found nothing to do."""
    return p.spark.createDataFrame([(at, k) for what, k, _, _, at in p.message_log if what == "slept"], "time double, tick long")


def load(spark, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cardinalities, and each collection's rows by step (column tick), as a program made with trace_folder left them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/contents")
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.read.parquet(f"{folder}/cardinalities"), {n: spark.read.parquet(f"{folder}/contents/{n}") for n in sorted(names)}


def metrics(p: Program) -> dict[str, float]:
    """count, mean and standard deviation of step times, and how many rules read each collection."""
    n, mean, m2 = 0, 0.0, 0.0
    for x in p.tick_times:
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
    scans: dict[str, int] = {}
    for d in p.depends():
        scans[f"scan:{d.body}"] = scans.get(f"scan:{d.body}", 0) + 1
    return {"count": n, "mean": mean, "stddev": math.sqrt(m2 / (n - 1)) if n > 1 else 0.0, **scans}


def print_metrics(p: Program, out=print) -> None:
    for k, v in metrics(p).items():
        out(f"{k},{v}")
