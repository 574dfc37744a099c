"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """lineno (from 0) and text (stripped) of one file.

    Splits of the file are read by as many tasks; a line's number is its place in its split plus the lines of all splits before, of
    which there is one row each."""
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = counts.select("split", (F.sum("n").over(Window.orderBy("split")) - F.col("n") - F.col("first")).alias("before"))
    text = F.trim(F.regexp_replace("value", r"\r$", ""))
    return lines.join(F.broadcast(before), "split").select((F.col("before") + F.col("at")).alias("lineno"), text.alias("text"))
