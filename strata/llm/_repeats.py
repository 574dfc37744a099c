"""Which hashes occur more than once in the whole corpus, without sending where they occur.

Documents are dealt to parts of bounded size by their key. Each part sends its distinct 64-bit hashes to buckets by their
high bits, as sorted 32-bit rests (with two flags) of which a column of bytes compresses well; each bucket answers every part
with those of its hashes that also occur elsewhere. A hash that a part holds many times is sent once, so no hash is hot. Two
different hashes with equal bucket and rest may count as one: callers verify what they get.

The exchange of documents by part is the same in all steps of a plan, so Spark makes it once."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._common import U64, parts_for, planes, text_bytes, unplanes

#: Bytes of text of a part, at least and at most. An exchange has a row for each part and bucket, and as many buckets as parts; parts
#: grow with the root of the corpus from 94 GB on, so that a row holds 64 hashes (30 at 100 TB) instead of fewer and fewer.
PART_BYTES, LARGEST_PART, ROW_HASHES = 6 << 20, 128 << 20, 64


def part_bytes(total: int) -> int:
    """Of a corpus of so many bytes; a word and so a hash for each six."""
    return max(PART_BYTES, min(LARGEST_PART, math.isqrt(6 * ROW_HASHES * total)))


#: Flags: the hash is a reference (of an index) somewhere in the part; it occurs twice or more in the part.
REFERENCE, TWICE = 1, 2


def by_part(docs: DataFrame, key: str, text: str, *more: str) -> tuple[DataFrame, int]:
    """docs as part, key (long) and text, and the number of parts."""
    total = text_bytes(docs.select(docs[text].alias("text")))
    n = parts_for(docs.sparkSession, total, part_bytes(total))
    number = docs[key].cast("long")
    spread = F.when(number.isNull(), F.xxhash64(docs[text].cast("string"))).otherwise(F.xxhash64(number))  # null keys have no part of their own
    return docs.select(F.pmod(spread, F.lit(n)).cast("int").alias("part"), docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"), *more), n


def marks(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket (high half) and rest (low half) of each hash."""
    return ((hashes >> U64(32)) * U64(n_buckets) >> U64(32)) << U64(32) | (hashes & U64(0xFFFFFFFF))


def send(part: int, hashes: np.ndarray, reference: np.ndarray | None, n_buckets: int) -> pa.Table:
    """A row for each bucket with the part's distinct hashes in it."""
    own = marks(hashes, n_buckets)
    if reference is None:
        found, n = np.unique(own, return_counts=True)
        flags = np.full(len(found), REFERENCE, np.uint8)
    else:
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.ones(len(own), bool)
        first[1:] = own[1:] != own[:-1]
        at = np.flatnonzero(first)
        found, n = own[at], np.diff(np.append(at, len(own)))
        flags = np.maximum.reduceat(reference[order].astype(np.uint8), at) * np.uint8(REFERENCE) if len(at) else np.zeros(0, np.uint8)
    flags = flags | (n > 1) * np.uint8(TWICE)
    bucket = (found >> U64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(found)).tolist()
    spans = list(zip(edges, edges[1:]))
    return pa.table({
        "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
        "part": pa.array([part] * len(spans), pa.int32()),
        "rests": pa.array([planes((found[a:b] & U64(0xFFFFFFFF)).astype(np.uint32)) for a, b in spans], pa.binary()),
        "flags": pa.array([flags[a:b].tobytes() for a, b in spans], pa.binary()),
    })


SENT = "bucket int, part int, rests binary, flags binary"
ANSWER = "part int, bucket int, rests binary"


def answer(sent: DataFrame) -> DataFrame:
    """part, bucket and rests: the hashes of each part that occur twice or more in all, and at least once as a reference."""

    def run(t: pa.Table) -> pa.Table:
        parts, blobs, flag_blobs = t.column("part").to_numpy(), t.column("rests").to_pylist(), t.column("flags").to_pylist()
        sizes = np.array([len(x) for x in flag_blobs])
        rests, flags = np.concatenate([unplanes(x) for x in blobs]), np.frombuffer(b"".join(flag_blobs), np.uint8)
        order = np.argsort(rests, kind="stable")
        ordered = rests[order]
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(ordered)))
        both = np.bitwise_or.reduceat(flags[order], at)
        good = ((n > 1) | (both & TWICE > 0)) & (both & REFERENCE > 0)
        hit = np.zeros(len(rests), bool)
        hit[order] = np.repeat(good, n)
        ends = np.cumsum(sizes)
        out = [(p, r[h]) for p, r, h in zip(parts.tolist(), np.split(rests, ends[:-1]), np.split(hit, ends[:-1])) if h.any()]
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "bucket": pa.array([t.column("bucket")[0].as_py()] * len(out), pa.int32()), "rests": pa.array([planes(r) for _, r in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def answered(t: pa.Table) -> np.ndarray:
    """The sorted marks of a part's answers."""
    if not t.num_rows:
        return np.zeros(0, U64)
    return np.sort(np.concatenate([(U64(b) << U64(32)) | unplanes(r).astype(U64) for b, r in zip(t.column("bucket").to_pylist(), t.column("rests").to_pylist())]))


def within(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of values are in found, which is sorted."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def cogroup(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run() over the rows of each part of both sides."""
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, schema)
