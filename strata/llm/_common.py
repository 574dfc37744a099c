"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/strata-checkpoints"  # one machine: its folder is shared
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/strata-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this share of the rows is heavy: there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000


def join_by_key(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """left joined with right, which has one row for each key and, in `weight`, how many of the `total` rows of left it meets.

    The fewer than 1 / HEAVY rows of right whose keys are heavy are broadcast, so no task gets the rows of a heavy key; all others
    meet by shuffle."""
    heavy = F.col(weight) > int(total * HEAVY)
    few = right.where(heavy)
    by_shuffle = left.join(F.broadcast(few.select(*on)), on, "left_anti").join(right.where(~heavy), on)
    return left.join(F.broadcast(few), on).unionByName(by_shuffle).drop(weight)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the whole text column: one scan of that column, summed in the JVM."""
    return docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def parts_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions so that one holds about `each` bytes, and never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, end to end, and the n + 1 offsets of the rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks() of no chunks, or of more than 2 GB
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bytes 0x20 and 0x09 to 0x0D end a word.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: One random 64-bit value for each byte, for rolling hashes that only choose where texts are cut.
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Words of up to so many bytes are hashed eight bytes at a time, all words at once; longer ones by a keyed hash of their own.
_SHORT_WORD = 64
_KEY = b"words of documents"
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z of UTF-8 bytes in lower case; all other bytes stay."""
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of non-separators, and the n + 1 offsets of each row's first word.

    A word never crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes after eight are mixed into the state by steps that aren't linear, so that no
    regular pattern of letters collides. Blocks of words bound the work memory."""
    out = np.empty(len(starts), U64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))  # the eight bytes from each byte on
    for at in range(0, len(starts), block):
        s = starts[at : at + block]
        left = ends[at : at + block] - s
        h = left.astype(U64) * U64(0x9E3779B97F4A7C15)
        own, step = np.arange(len(s)), 0
        while len(own):
            n = left[own] - step
            h[own] = mix64(h[own] * U64(0xD6E8FEB86659FD93) ^ (eight[s[own] + step] & _MASK[np.minimum(n, 8)]))
            step += 8
            own = own[(n > 8) & (left[own] <= _SHORT_WORD)]
        out[at : at + block] = h
    for i in np.flatnonzero(ends - starts > _SHORT_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=_KEY).digest(), "little")
    return out


def _fold(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes, in that order: multiplications and shifts by turns, so not linear."""
    out = left * U64(0xE7037ED1A0B428DB)
    out ^= out >> U64(32)
    out += right
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(29)
    return out


def rolling(values: np.ndarray, k: int, seed: int = 1, block: int = 1 << 14) -> np.ndarray:
    """A 64-bit hash of each k consecutive values; one entry for each start with k values after it.

    Hashes of runs of 1, 2, 4, ... values are folded in pairs, so the work grows with the logarithm of k; blocks stay in cache."""
    n = len(values) - k + 1
    out = np.empty(max(n, 0), U64)
    salt = mix64(np.array([seed], U64))
    for at in range(0, n, block):
        m = min(block, n - at)
        power, size, own, done = values[at : at + m + k - 1] ^ salt, 1, None, 0
        while done < k:
            if k & size:
                tail = power[done : done + m]
                own = tail if own is None else _fold(own, tail)
                done += size
            if done < k:
                power = _fold(power[:-size], power[size:])
                size *= 2
        out[at : at + m] = mix64(own)
    return out


def row_of(first_word: np.ndarray) -> np.ndarray:
    """The row of each word, from the offsets that words() gives."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))


def planes(values: np.ndarray) -> bytes:
    """32-bit values with all first bytes first, then all second bytes, and so on: sorted values then compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def by_task(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in `names`, from batches that are sorted by these whole-number columns."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in names]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            null, value = c.is_null().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)
            change[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            mark = tuple(c[a].as_py() for c in columns)
            if open_ and mark != last:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
            last = mark
    if open_:
        yield pa.Table.from_batches(open_)
