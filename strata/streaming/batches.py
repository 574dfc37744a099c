"""Structured Streaming: a micro-batch is a step of a program; event-time windows, deduplication and last-seen state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drive(program, inputs: dict[str, DataFrame], checkpoint: str, trigger: dict | None = None) -> list[StreamingQuery]:
    """Starts a query for each stream: each micro-batch is delivered to its channel, or inserted, and followed by a step.

    Streams take turns: a batch and its step exclude those of other streams. After each step the program's state is committed with the
    numbers of the batches in it, so a program that resumes from the checkpoint takes that state, and a batch that is delivered
    again after a failure is left out."""
    folder, done = f"{checkpoint}/_program", {}
    if (marks := program.restore(folder)) is not None:
        done.update(marks)

    def step(name: str):
        def run(batch: DataFrame, number: int) -> None:
            with program._lock:
                if program.stopped or number <= done.get(name, -1):
                    return
                if program._decls[name].kind in ("channel", "loopback"):
                    program.deliver(name, batch)
                else:
                    program.insert(name, batch)
                program.tick()
                done[name] = number
                program.snapshot(folder, done)

        return run

    return [df.writeStream.foreachBatch(step(name)).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"availableNow": True})).start() for name, df in inputs.items()]


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], *aggs, late: str | None = None) -> DataFrame:
    """Aggregates by window and keys; late: how long rows may come late (for streams)."""
    df = _timed(df, time, late)
    return df.groupBy(F.window(time, width), *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *(c for c in _names(aggs)))


def sliding(df: DataFrame, time: str, width: str, slide: str, keys: list[str], *aggs, late: str | None = None) -> DataFrame:
    df = _timed(df, time, late)
    return df.groupBy(F.window(time, width, slide), *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *(c for c in _names(aggs)))


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggs, late: str | None = None) -> DataFrame:
    df = _timed(df, time, late)
    return df.groupBy(F.session_window(time, gap), *keys).agg(*aggs).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *(c for c in _names(aggs)))


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """df with a watermark, which needs a time with a zone; without one, as it is."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df


def _names(aggs) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def first_seen(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, over the whole stream within the watermark."""
    return _timed(df, time, late).dropDuplicatesWithinWatermark(keys)


def last_seen(df: DataFrame, key: str, time: str) -> DataFrame:
    """The latest time of each key so far: a streaming maximum, of which Spark keeps one value for each key."""
    return df.groupBy(key).agg(F.max(time).alias(time))
