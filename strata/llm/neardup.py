"""Near-duplicate embeddings by randomised-rotation binary codes.

Each distinct vector is scaled to length one and turned by random rotations that depend on the number of components alone.
The signs after the first rotation are its binary code. With it are stored the correction factor (the inner product of the
vector with its code's unit vector), the error that follows from it, and the turned vector in steps of eight bits. For a pair, the
code of one and the turned vector of the other give an unbiased estimate of the cosine (up to the steps, whose part is bounded), and
the correction factors give a bound on its error that holds but for a negligible chance. Only pairs whose upper bound reaches the
threshold are computed again, in double precision, and only those that reach it are links (after Gao and Long, 2024).

Candidates are pairs that agree in one of several tables of bits of further rotations: the number of bits grows with the logarithm
of the number of vectors, and the number of tables follows from it so that a pair exactly at the threshold is found with chance
RECALL (closer pairs with more). A pair is judged in the first table in which it agrees, so each link counts once.

Equal vectors are one row with a count from the start. What is dealt to the buckets of all tables is the codes; the vectors
themselves go only to buckets where the bounds have left a pair open, for the rows of such pairs alone. A bucket of many rows is split
into blocks, and pairs of blocks are separate tasks; a task returns link counts and a spanning forest, never its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different length
don't link. A row with a null id links with nothing, has a null component and is kept. Rows that repeat an id are vectors of their
own: each has its own links and component, and the id joins nothing. An empty table gives an empty result."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._common import by_task, join_by_key, stored
from strata.llm.connected import UnionFind, components
from strata.llm.topk import usable

THRESHOLD = 0.95
RECALL = 0.99
#: Vectors of a bucket on average; rows of a block: a 64th of the bucket within these bounds.
BUCKET, BLOCK, LARGEST_BLOCK = 32, 1024, 1 << 14
#: Errors that the bound allows for, in standard deviations of the estimate.
DEVIATIONS = 6.0


@functools.lru_cache(64)
def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    g = np.random.default_rng([d, number, 20240521]).standard_normal((d, d))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's key, and tables, for n distinct vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET)))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def table_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each row in each table: the signs of `bits` directions of random rotations."""
    n, d = unit.shape
    need, turned = bits * tables, []
    for number in range(1, 1 + -(-need // d)):
        turned.append(unit @ rotation(d, number).T > 0)
    signs = np.concatenate(turned, 1)[:, :need].reshape(n, tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


class Codes:
    """Binary codes of some unit vectors, with correction factors and the turned vectors."""

    def __init__(self, unit: np.ndarray) -> None:
        d = unit.shape[1]
        self.turned = (unit @ rotation(d, 0).T).astype(np.float32)
        self.signs = _signs(self.turned > 0)
        self.factor = np.maximum((self.turned * self.signs).sum(1), np.float32(1e-6))
        self.error = (DEVIATIONS * np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(d - 1, 1)) + 1e-4).astype(np.float32)
        #: By how much the steps of a stored turned vector can move its inner product with a code's unit vector.
        self.rounding = np.zeros(len(unit), np.float32)

    def packed(self) -> list[bytes]:
        d = self.turned.shape[1]
        out = np.zeros(len(self.turned), layout(d))
        out["step"] = np.maximum(np.abs(self.turned).max(1), np.float32(1e-30)) / np.float32(127)
        out["turned"] = np.rint(self.turned / out["step"][:, None])
        out["bits"], out["factor"], out["error"] = np.packbits(self.signs > 0, axis=1), self.factor, self.error
        return [x.tobytes() for x in out]

    @classmethod
    def unpacked(cls, blobs: list[bytes], d: int) -> Codes:
        stored_, out = np.frombuffer(b"".join(blobs), layout(d)), cls.__new__(cls)
        out.signs = _signs(np.unpackbits(stored_["bits"], axis=1, count=d).astype(bool))
        out.turned = stored_["turned"].astype(np.float32) * stored_["step"][:, None]
        out.factor, out.error = stored_["factor"], stored_["error"]
        out.rounding = stored_["step"] * np.float32(0.5001 * math.sqrt(d))
        return out

    def estimate(self, other: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products of the coded vectors (rows) with others (columns), turned alike."""
        return (self.signs @ other.T) / self.factor[:, None]

    def may_reach(self, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the upper bound of each pair of rows and columns reaches the threshold."""
        estimates = (self.signs[rows] @ self.turned[columns].T + self.rounding[columns][None, :]) / self.factor[rows][:, None]
        return estimates + self.error[rows][:, None] >= threshold


def _signs(positive: np.ndarray) -> np.ndarray:
    return np.where(positive, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(positive.shape[1]))


def layout(d: int) -> np.dtype:
    """A stored code of d components."""
    return np.dtype([("bits", "u1", (-(-d // 8),)), ("factor", "<f4"), ("error", "<f4"), ("step", "<f4"), ("turned", "i1", (d,))])


def open_pairs(codes: Codes, keys: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right), i before j where both are the same rows, whose bounds leave open that they reach the threshold and
    that agree in no table before this one; in runs of bounded size."""
    same = left is right
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        maybe = codes.may_reach(rows, right, threshold)
        if same:
            maybe &= rows[:, None] < right[None, :]
        i, j = np.nonzero(maybe)
        for k in range(0, len(i), 1 << 16):
            a, b = rows[i[k : k + (1 << 16)]], right[j[k : k + (1 << 16)]]
            if table:
                new = ~(keys[a, :table] == keys[b, :table]).any(1)
                a, b = a[new], b[new]
            if len(a):
                yield a, b


def unit_rows(column: pa.Array, d: int, kind: str) -> np.ndarray:
    """Vectors of length one, in doubles, from stored bytes."""
    out = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d).astype(np.float64)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors."""
    spark = vectors.sparkSession
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if floats else "<f8"  # bytes of a component, in which nothing is lost
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if floats else "array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    classes = stored(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("id", F.monotonically_increasing_id()), "classes")
    n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits, tables = plan(n_classes, threshold, recall)
    key_type, key_kind = ("int", pa.int32()) if bits < 32 else ("long", pa.int64())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                sizes = np.diff(batch.column(0).offsets.to_numpy())
                for d in np.unique(sizes):
                    own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                    raw = [x.tobytes() for x in np.array(own.column(0).to_pylist(), kind)]
                    unit = unit_rows(pa.array(raw, pa.binary()), int(d), kind)
                    keys = table_keys(unit, bits, tables).astype(key_kind.to_pandas_dtype())
                    yield pa.record_batch(
                        [pa.array(np.full(len(unit), d, np.int32)), own.column(1), own.column(2), own.column(3), pa.array(list(keys), pa.list_(key_kind)), pa.array(Codes(unit).packed(), pa.binary()), pa.array(raw, pa.binary())],
                        names=["d", "rep", "copies", "id", "keys", "code", "raw"],
                    )

    coded = stored(classes.select("v", "rep", "copies", "id").mapInArrow(encode, f"d int, rep long, copies long, id long, keys array<{key_type}>, code binary, raw binary"), "codes")
    slim = coded.select("id", "d", F.posexplode("keys").alias("t", "k"))
    bucket = ["d", "t", "k"]
    # Buckets of one row hold no pair; large ones are split into blocks.
    sizes = slim.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.ceil(F.col("n") / 64)))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    blocks = F.col("blocks")
    task = [*bucket, "low", "high"]
    tasks = (
        join_by_key(slim, sizes, bucket, "n", n_classes * tables)
        .withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("id", *bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    )
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(slim_tasks: DataFrame, *columns: str) -> DataFrame:
        """The rows of tasks with what is stored of each, task after task."""
        full = slim_tasks.join(coded.select("id", "keys", *columns), "id")
        return full.select(*task, "own", "id", F.col("keys"), *columns).repartition(n_parts, *task).sortWithinPartitions(*task, "id")

    def sides(t: pa.Table) -> tuple[int, int, np.ndarray, Codes, np.ndarray, np.ndarray]:
        d, table, low, high = (t.column(c)[0].as_py() for c in ("d", "t", "low", "high"))
        own, keys = t.column("own").to_numpy(), t.column("keys").combine_chunks()
        keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten().to_numpy().reshape(-1, tables)
        left = np.flatnonzero(own == low)
        return d, table, keys, Codes.unpacked(t.column("code").to_pylist(), d), left, left if low == high else np.flatnonzero(own == high)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each task that have an open pair there."""
        for t in by_task(batches, task):
            if t.num_rows > 1:
                _, table, keys, codes, left, right = sides(t)
                is_open = np.zeros(t.num_rows, bool)
                for i, j in open_pairs(codes, keys, table, left, right, threshold):
                    is_open[i] = is_open[j] = True
                if is_open.any():
                    yield from t.select([*task, "own", "id"]).filter(pa.array(is_open)).combine_chunks().to_batches()

    left_open = stored(dealt(tasks, "code").mapInArrow(judge, f"d int, t int, k {key_type}, low int, high int, own int, id long"), "open")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact cosines of the open pairs: link counts and a spanning forest."""
        for t in by_task(batches, task):
            d, table, keys, codes, left, right = sides(t)
            unit, copies = unit_rows(t.column("raw"), d, kind), t.column("copies").to_numpy()
            count, forest, joined = np.zeros(t.num_rows, np.int64), [], UnionFind(t.num_rows)
            for i, j in open_pairs(codes, keys, table, left, right, threshold):
                close = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[close], j[close]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                forest += joined.forest(i, j)
            linked, edge = np.flatnonzero(count), np.array(forest, np.int64).reshape(-1, 2)
            a, b = np.concatenate([linked, edge[:, 0]]), np.concatenate([linked, edge[:, 1]])
            n = np.concatenate([count[linked], np.full(len(edge), -1)])
            rep, id_ = t.column("rep").to_numpy(), t.column("id").to_numpy()
            yield pa.record_batch([*(pa.array(x[at]) for at in (a, b) for x in (rep, id_)), pa.array(n)], names=["rep_a", "a", "rep_b", "b", "n"])

    found = stored(dealt(left_open, "code", "raw", "rep", "copies").mapInArrow(compute, "rep_a long, a long, rep_b long, b long, n long"), "links")
    counts = found.where("n >= 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    # A node is (least id of the vector's rows, its own number): the least node of a component has its least id.
    ends = components(found.where("n < 0").select(F.struct(F.col("rep_a").alias("rep"), F.col("a").alias("id")).alias("a"), F.struct(F.col("rep_b").alias("rep"), F.col("b").alias("id")).alias("b")))
    ends = ends.select(F.col("node.id").alias("id"), F.col("component_id.rep").alias("c"))
    about = classes.join(counts, "id", "left").join(ends, "id", "left").select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
    linked = join_by_key(rows.where(good), about, ["v"], "copies", n_rows).select("vec_id", "n_links", "component_id")
    others = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
