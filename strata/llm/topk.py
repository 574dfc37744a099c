"""Exact top-k inner products by MaxScore, over a grid of row blocks and query blocks.

The components of a query are its terms, and a term's postings are the rows of a shard in which that component isn't zero (kept as
one column where most rows have it). Within a shard each term has bounds on what it can add to a score: its largest and smallest
component in the shard times the query's. Terms whose upper bounds together can't lift a row over the k-th best score so far are
non-essential: a row in none of the other, essential, postings can be left out. The essential postings are traversed; a row that
they reach stays a candidate only while its partial score plus the bounds of what is still open reaches the k-th best score, and
non-essential terms are probed for candidates alone, the largest bounds first. Each shard gives its k best of each query, and
these are merged.

Scores and ranks are exact for every finite component: sums go in doubles or longs where these hold them, else in whole numbers of
any length. A score beyond a long is given as the largest or smallest long; its rank is that of the exact score.

Shorter vectors count as padded with zeros. Null vectors, and those with null or non-finite components, take no part, and rows with
a null id neither. Each row is a query (if `is_query` holds) and a candidate on its own, also if it repeats another row or its id: a
query's candidates are all rows but itself. Ties go to the smaller id. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._common import stored

#: Scaled components up to this size travel as 32-bit integers, others as doubles.
NARROW = 1 << 24
#: Rows of a block and queries of a block of the grid; rows that are traversed together, and queries that are.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK_ROWS, QUERY_ROWS = 1 << 16, 1 << 17, 2048, 256
#: Rows of a block at least, where there are more tasks than blocks.
LEAST_ROWS = 1024
_LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly, as Python integers; a product that no double holds is taken in whole numbers."""
    with np.errstate(over="ignore"):
        product = np.floor(values * float(scale))
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(p) if math.isfinite(p) else int(x) * scale for p, x in zip(product.ravel().tolist(), values.ravel().tolist())]
    return out


def _kind(d: int, row: int, query: int) -> type:
    """Numbers that hold every sum of d products exactly."""
    return np.float64 if d * row * query < 1 << 52 else np.int64 if d * row * query < 1 << 62 else object


class Best:
    """The k best (score, id) of each of some queries, so far."""

    def __init__(self, n: int, k: int, kind: type) -> None:
        self.k, self.kind, self.none = k, kind, -(1 << 5000) if kind is object else int(_LONG.min)
        self.scores = np.full((n, k), self.none, object if kind is object else np.int64)
        self.ids = np.full((n, k), _LONG.max)

    def bar(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores.astype(self.scores.dtype)]), np.concatenate([self.ids[q], ids])
        order = sorted(range(len(s)), key=lambda x: (-s[x], i[x]))[: self.k] if self.kind is object else np.lexsort((i, ~s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]


class Chunk:
    """The postings of some rows: of each term, the rows that have it. Terms that most rows have are whole columns."""

    def __init__(self, rows: np.ndarray) -> None:
        held = rows != 0
        share = held.sum(0)
        self.rows = rows
        self.broad = np.flatnonzero(share * 2 > len(rows))
        self.columns = np.ascontiguousarray(rows[:, self.broad])
        self.lists = {int(j): np.flatnonzero(held[:, j]) for j in np.flatnonzero((share > 0) & (share * 2 <= len(rows)))}

    def traverse(self, q: np.ndarray, essential: np.ndarray, all_rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """Partial scores of essential terms, and for each query the rows that its essential postings reach (None: all)."""
        partial = (q[:, self.broad] * essential[:, self.broad]) @ self.columns.T if len(self.broad) else np.zeros((len(q), len(self.rows)), q.dtype)
        whole = all_rows | (essential[:, self.broad] & (q[:, self.broad] != 0)).any(1)
        reached: list = [None if w else [] for w in whole]
        for j, own in self.lists.items():
            for i in np.flatnonzero(essential[:, j] & (q[:, j] != 0)):
                partial[i, own] += q[i, j] * self.rows[own, j]
                if reached[i] is not None:
                    reached[i].append(own)
        return partial, [r if r is None else np.unique(np.concatenate(r)) if r else np.zeros(0, np.int64) for r in reached]


class Shard:
    """Rows as postings in chunks, with the bounds of each term. rows: integers, or doubles that are scaled chunk by chunk."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, scale: int | None = None) -> None:
        self.rows, self.ids, self.own, self.scale = rows, ids, own, scale
        exact = (lambda x: whole_numbers(x, scale)) if scale else (lambda x: x.astype(np.int64).astype(object))
        d = rows.shape[1]
        self.most, self.least = (exact(rows.max(0)), exact(rows.min(0))) if len(rows) else (np.zeros(d, object), np.zeros(d, object))
        self.size = max([1, *map(abs, self.most), *map(abs, self.least)])
        self.made: dict[tuple[type, int], Chunk] = {}

    def chunk(self, at: int, kind: type) -> Chunk:
        """Chunks of numbers of fixed size are kept for the next queries; long ones are made anew."""
        if (kind, at) in self.made:
            return self.made[kind, at]
        rows = self.rows[at : at + CHUNK_ROWS]
        out = Chunk(whole_numbers(rows, self.scale) if self.scale else rows.astype(kind))
        if kind is not object:
            self.made[kind, at] = out
        return out


def search(queries: np.ndarray, query_own: np.ndarray, shard: Shard, k: int, stats: dict | None = None) -> Best:
    """MaxScore of some queries (whole numbers) over one shard. query_own: the row of each query, which is no candidate of it."""
    n, d = queries.shape
    kind = _kind(d, shard.size, max([1, *map(abs, (int(queries.max(initial=0)), int(queries.min(initial=0))))]))
    best = Best(n, k, kind)
    if not len(shard.rows) or not n:
        return best
    q, most, least = queries.astype(kind), shard.most.astype(kind), shard.least.astype(kind)
    high = np.maximum(q * most, q * least)  # upper bound of each term for each query
    zero = high * 0
    order = np.argsort(high - np.minimum(q * most, q * least), axis=1, kind="stable")  # least spread first
    by_spread = np.cumsum(np.take_along_axis(np.maximum(high, zero), order, 1), 1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(d)[None, :].repeat(n, 0), 1)
    for at in range(0, len(shard.rows), CHUNK_ROWS):
        chunk, ids, own_rows = shard.chunk(at, kind), shard.ids[at : at + CHUNK_ROWS], shard.own[at : at + CHUNK_ROWS]
        bar = best.bar()
        # The longest run of terms of least spread whose bounds stay under the bar are non-essential.
        n_open = np.where((bar > 0).astype(bool), (by_spread < bar[:, None]).astype(bool).sum(1), 0)
        essential = rank >= n_open[:, None]
        partial, reached = chunk.traverse(q, essential, (bar <= 0).astype(bool))
        rest = (high * ~essential).sum(1)
        whole = np.array([i for i in range(n) if reached[i] is None], np.int64)
        able = whole[(partial[whole] + rest[whole, None] >= bar[whole, None]).astype(bool).any(1)]
        for i in sorted([*able.tolist(), *(i for i in range(n) if reached[i] is not None and len(reached[i]))]):
            rows_left = np.arange(len(ids)) if reached[i] is None else reached[i]
            stay = (partial[i, rows_left] + rest[i] >= bar[i]).astype(bool) & (own_rows[rows_left] != query_own[i])
            rows_left = rows_left[stay]
            scores, open_bound = partial[i, rows_left], rest[i]
            terms = order[i, : n_open[i]][np.argsort(-high[i, order[i, : n_open[i]]], kind="stable")]
            for j in range(0, len(terms), 8):  # probe while competitive
                if not len(rows_left):
                    break
                own = terms[j : j + 8]
                scores = scores + chunk.rows[np.ix_(rows_left, own)] @ q[i, own]
                open_bound = open_bound - high[i, own].sum()
                stay = (scores + open_bound >= bar[i]).astype(bool)
                rows_left, scores = rows_left[stay], scores[stay]
            if stats is not None:
                stats["scored"] = stats.get("scored", 0) + len(rows_left)
            if len(rows_left):
                best.add(i, scores, ids[rows_left])
    return best


def ordered_bytes(n: int) -> bytes:
    """A whole number as bytes that sort like it."""
    m = abs(n)
    body = m.bit_length().to_bytes(4, "big") + m.to_bytes((m.bit_length() + 7) // 8, "big")
    return b"\1" + body if n >= 0 else b"\0" + bytes(255 - b for b in body) + b"\xff"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Lists as rows of one width; null lists are empty."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), lengths.max(initial=0)), kind)
    if len(lengths) and (lengths == lengths[0]).all():
        out[:] = values[offsets[0] : offsets[-1]].reshape(out.shape)
    else:
        for i, n in enumerate(lengths):
            out[i, :n] = values[offsets[i] : offsets[i] + n]
    return out


def _wide(parts: list[np.ndarray], width: int, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros((0, width), kind), *(np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts)])


class _Lane:
    """One row block as it comes in, then as shards: rows of small components and rows of large ones."""

    def __init__(self, scale: int) -> None:
        self.scale, self.parts, self.shards, self.width = scale, {"v": [], "w": []}, [], -1

    def take(self, batch: pa.RecordBatch) -> None:
        for name, kind in (("v", np.int32), ("w", np.float64)):
            part = batch.filter(batch.column(name).is_valid())
            if part.num_rows:
                self.parts[name].append((_matrix(part.column(name), kind), part.column("id").to_numpy(), part.column("own").to_numpy()))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[Best]:
        width = max([queries.shape[1], *(p[0].shape[1] for parts in self.parts.values() for p in parts)])
        if width != self.width:
            self.width, self.shards = width, []
            for name, kind, scale in (("v", np.int32, None), ("w", np.float64, self.scale)):
                if parts := self.parts[name]:
                    self.shards.append(Shard(_wide([p[0] for p in parts], width, kind), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), scale))
        padded = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        yield from (search(padded, own, shard, k) for shard in self.shards)


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows.

    A lane is one row block and one query block, so that a task's work and memory don't grow with the table; rows are dealt to blocks by
    the hash of their number, so equal vectors and ids spread over all of them."""
    spark = vectors.sparkSession
    small = F.forall("x", lambda x: F.abs(x) * scale < NARROW)
    taken = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    parts = {"v": F.when(small, F.transform("x", lambda x: F.floor(x * scale).cast("int"))), "w": F.when(~small, F.col("x"))}
    good = stored(taken.select("id", "q", *(x.alias(n) for n, x in parts.items())).withColumn("own", F.monotonically_increasing_id()), "rows")
    n_rows, n_queries = good.agg(F.count(F.lit(1)), F.count_if("q")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-n_rows // block_rows), min(tasks, -(-n_rows // LEAST_ROWS)))
    down = max(1, -(-n_queries // block_queries))
    hashed = F.xxhash64("own")
    row_block, query_block = F.pmod(hashed, F.lit(across)).cast("int"), F.pmod(F.shiftright(hashed, 32), F.lit(down)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = good.select(row_block.alias("a"), every(down).alias("b"), F.lit(0).alias("kind"), "own", "id", "v", "w")
    queries = good.where("q").select(every(across).alias("a"), query_block.alias("b"), F.lit(1).alias("kind"), "own", "id", "v", "w")
    n_parts = max(tasks, min(across * down, 1 << 16))
    dealt = rows.unionByName(queries).repartition(n_parts, "a", "b").sortWithinPartitions("a", "b", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, lane = None, _Lane(scale)
        for whole in batches:
            for begin in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(begin, QUERY_ROWS)
                a, b, kind = (batch.column(i).to_numpy() for i in range(3))
                edges = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(kind) != 0)) + 1
                for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                    part = batch.slice(lo, hi - lo)
                    if (a[lo], b[lo]) != mark:
                        mark, lane = (a[lo], b[lo]), _Lane(scale)
                    if kind[lo] == 0:
                        lane.take(part)
                        continue
                    for name, number in (("v", np.int32), ("w", np.float64)):
                        asked = part.filter(part.column(name).is_valid())
                        if not asked.num_rows:
                            continue
                        matrix, own, ids = _matrix(asked.column(name), number), asked.column("own").to_numpy(), asked.column("id").to_numpy()
                        for best in lane.best(matrix.astype(np.int64) if name == "v" else whole_numbers(matrix, scale), own, k):
                            got = best.scores > best.none
                            exact = best.scores[got].tolist()
                            yield pa.record_batch(
                                [pa.array(np.repeat(own, got.sum(1))), pa.array(np.repeat(ids, got.sum(1))), pa.array(best.ids[got]), pa.array([max(_LONG.min, min(_LONG.max, x)) for x in exact], pa.int64()), pa.array([None if abs(x) < 1 << 62 else ordered_bytes(x) for x in exact], pa.binary())],
                                names=["own", "query_id", "vec_id", "score", "exact"],
                            )

    found = dealt.mapInArrow(run, "own long, query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH good AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.own, q.vec_id AS query_id, r.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, r.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM good q JOIN good r ON q.own <> r.own
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
