"""Token-id shards with minimal perfect hash indexes.

Documents are range-partitioned by key, encoded, and written as shard files in ascending key order. A shard holds the raw
ids of consecutive documents, end to end (little-endian unsigned 16-bit where the vocabulary allows, else 32-bit), the keys
in order, and an index: a hash-and-displace minimal perfect hash from key to slot, with one slot for each document that
stores a 32-bit fingerprint, the document's first id and its number of ids.

The directory over all shards is cut into buckets by the key's hash; a bucket is a minimal perfect hash of the same kind whose slots
store a fingerprint and the key's part and shard. A lookup reads the one file of its bucket, computes one slot, reads the one file of
the shard, computes one slot there and takes one slice, whatever the size of the corpus. A fingerprint that differs means that the
key is not there, but for one in 2**32; get() compares the keys of the shard too.

The files are Parquet files in folders by part and by bucket, so any store that Spark reaches can hold them, and a lost executor's
files are written again by Spark's output committer. Null text counts as empty and gets the end id alone. Rows that repeat a key are
told apart by their number among equal keys, in order of text; null keys come first. An empty table gives no shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm._common import U64, mix64, parts_for, text_bytes
from strata.llm.tokens import byte_encoder

#: Ids of a shard; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
#: Keys of a bucket of the perfect hash, on average.
BUCKET = 4
#: Keys of a bucket of the directory, on average.
INDEX_KEYS = 1 << 16
SCHEMA = "part int, shard int, ids_before long, n_docs int, n_ids long, width int, keys binary, nulls binary, occurrences binary, seed int, pilots binary, slots binary, payload binary"
DIRECTORY = "bucket int, n_buckets int, n_keys int, seed int, pilots binary, slots binary"
#: Slots of a shard and of the directory.
SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("first", "<u8")])
PLACE = np.dtype([("fingerprint", "<u4"), ("part", "<u4"), ("shard", "<u4")])


def key_hashes(keys: np.ndarray, nulls: np.ndarray, occurrences: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(keys.astype(U64) + U64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64))) + occurrences.astype(U64) * U64(0xD6E8FEB86659FD93) + nulls.astype(U64) * U64(0xA0761D6478BD642F))


def _slot(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(hashes ^ (pilots.astype(U64) + U64(1)) * U64(0x9FB21C651E98DF25)) % U64(n)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """A pilot for each bucket such that slot_of() maps the n distinct hashes onto 0 .. n - 1 without collision."""
    n = len(hashes)
    n_buckets = max(1, -(-n // BUCKET))
    bucket = (hashes >> U64(33)) % U64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U64))
    pilots, taken = np.zeros(n_buckets, np.uint32), np.zeros(n, bool)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        own = hashes[order[starts[b] : starts[b + 1]]]
        if not len(own):
            break
        base, step = 0, 16
        while True:
            tries = np.arange(base, base + step, dtype=np.uint32)
            slots = _slot(own[None, :], tries[:, None], n)
            good = ~taken[slots].any(1)
            if len(own) > 1:
                s = np.sort(slots, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                k = int(good.argmax())
                pilots[b] = tries[k]
                taken[slots[k]] = True
                break
            base, step = base + step, min(step * 2, 4096)
    return pilots


def slot_of(hashes: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return _slot(hashes, pilots[((hashes >> U64(33)) % U64(len(pilots))).astype(np.int64)], n)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ U64(0xE7037ED1A0B428DB)) >> U64(32)).astype("<u4")


class Index:
    """A minimal perfect hash with stored slots; find() takes constant time for each key."""

    def __init__(self, row: dict, kind: np.dtype) -> None:
        self.seed, self.pilots, self.slots = row["seed"], np.frombuffer(row["pilots"], "<u4"), np.frombuffer(row["slots"], kind)

    @staticmethod
    def build(keys: np.ndarray, nulls: np.ndarray, occurrences: np.ndarray, values: np.ndarray) -> dict:
        """values: slots but for the fingerprints, in order of keys. The keys differ, so some seed gives them different hashes."""
        seed = 0
        while len(np.unique(hashes := key_hashes(keys, nulls, occurrences, seed))) < len(keys):
            seed += 1
        pilots, slots = perfect_hash(hashes), np.zeros(len(keys), values.dtype)
        at = slot_of(hashes, pilots, len(keys))
        slots[at] = values
        slots["fingerprint"][at] = fingerprint(hashes)
        return {"seed": seed, "pilots": pilots.astype("<u4").tobytes(), "slots": slots.tobytes()}

    def find(self, keys: np.ndarray, nulls: np.ndarray | None = None, occurrences: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key, or -1."""
        keys = np.asarray(keys, np.int64)
        hashes = key_hashes(keys, np.zeros(len(keys), bool) if nulls is None else nulls, np.zeros(len(keys), np.uint32) if occurrences is None else occurrences, self.seed)
        at = slot_of(hashes, self.pilots, len(self.slots))
        return np.where(self.slots["fingerprint"][at] == fingerprint(hashes), at, -1)


class Shard(Index):
    """One shard row."""

    def __init__(self, row: dict) -> None:
        super().__init__(row, SLOT)
        self.keys, self.nulls, self.occurrences = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["nulls"], bool), np.frombuffer(row["occurrences"], "<u4")
        self.part, self.shard = row["part"], row["shard"]
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")

    def _holds(self, key: int | None, occurrence: int) -> bool:
        """Keys are in order, null ones first."""
        n_null = int(self.nulls.sum())
        lo, hi = (0, n_null) if key is None else n_null + np.searchsorted(self.keys[n_null:], [key, key + 1])
        return bool((self.occurrences[lo:hi] == occurrence).any())

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        at = self.find(np.array([key or 0]), np.array([key is None]), np.array([occurrence], np.uint32))[0]
        if at < 0 or not self._holds(key, occurrence):
            return None
        first, count = int(self.slots["first"][at]), int(self.slots["count"][at])
        return self.ids[first : first + count]


def bucket_of(keys: np.ndarray, nulls: np.ndarray, occurrences: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix64(key_hashes(keys, nulls, occurrences) ^ U64(0x8EBC6AF09C88C6E3)) % U64(n_buckets)).astype(np.int32)


def _row(part: int, shard: int, before: int, width: int, docs: list[tuple[int | None, int, bytes]]) -> dict:
    nulls = np.array([k is None for k, _, _ in docs])
    keys, occurrences = np.array([k or 0 for k, _, _ in docs], "<i8"), np.array([o for _, o, _ in docs], "<u4")
    slots = np.zeros(len(docs), SLOT)
    slots["count"] = [len(x) // 4 for _, _, x in docs]
    slots["first"] = np.cumsum(slots["count"], dtype=np.int64) - slots["count"]
    payload = np.frombuffer(b"".join(x for _, _, x in docs), "<u4").astype(f"<u{width}").tobytes()
    return {"part": part, "shard": shard, "ids_before": before, "n_docs": len(docs), "n_ids": int(slots["count"].sum(dtype=np.int64)), "width": width, "keys": keys.tobytes(), "nulls": nulls.tobytes(), "occurrences": occurrences.tobytes(), **Index.build(keys, nulls, occurrences, slots), "payload": payload}


def write(docs: DataFrame, path: str, to: str, end_id: int, text: str = "text", key: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Encodes docs with the byte-level vocabulary at path, appends end_id to each, and writes shards to the folder `to`:
    those of part p to part=p below `to`/shards, the directory's bucket b to bucket=b below `to`/directory."""
    spark = docs.sparkSession
    n = parts_for(spark, text_bytes(docs.select(docs[text].alias("text"))), 24 << 20)
    ordered = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).repartitionByRange(n, "key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(path), np.array([end_id], "<u4").tobytes()
        width = 2 if max(max(encoder.bytes_of), end_id) < 1 << 16 else 4
        part, schema = TaskContext.get().partitionId(), pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), *((x, pa.binary()) for x in ("keys", "nulls", "occurrences")), ("seed", pa.int32()), *((x, pa.binary()) for x in ("pilots", "slots", "payload"))])
        open_, held, shard, before, last, again = [], 0, 0, 0, object(), 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(t.as_py() or "") + end
                again = again + 1 if k == last else 0
                last = k
                if open_ and held + len(ids) // 4 > shard_ids:
                    yield pa.RecordBatch.from_pylist([_row(part, shard, before, width, open_)], schema)
                    shard, before, open_, held = shard + 1, before + held, [], 0
                open_.append((k, again, ids))
                held += len(ids) // 4
        if open_:
            yield pa.RecordBatch.from_pylist([_row(part, shard, before, width, open_)], schema)

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").partitionBy("part").parquet(f"{to}/shards")
    _write_directory(spark, to)


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/shards")


def _write_directory(spark: SparkSession, folder: str) -> None:
    shards = _shards(spark, folder)
    n = max(1, -(-(shards.agg(F.sum("n_docs")).first()[0] or 0) // INDEX_KEYS))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each shard and bucket, the keys and their place: raw, as they go into the bucket."""
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls, occurrences = (np.frombuffer(row[c], k) for c, k in (("keys", "<i8"), ("nulls", bool), ("occurrences", "<u4")))
                bucket = bucket_of(keys, nulls, occurrences, n)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                spans = [order[a:b] for a, b in zip(edges, [*edges[1:], len(order)])]
                yield pa.record_batch(
                    [pa.array([bucket[x[0]] for x in spans], pa.int32()), *(pa.array([row[c]] * len(spans), pa.int32()) for c in ("part", "shard")), *(pa.array([c[x].tobytes() for x in spans], pa.binary()) for c in (keys, nulls, occurrences))],
                    names=["bucket", "part", "shard", "keys", "nulls", "occurrences"],
                )

    def build(t: pa.Table) -> pa.Table:
        keys, nulls, occurrences = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("keys", "<i8"), ("nulls", bool), ("occurrences", "<u4")))
        sizes, places = [len(x) for x in t.column("nulls").to_pylist()], np.zeros(len(keys), PLACE)
        places["part"], places["shard"] = (np.repeat(t.column(c).to_numpy(), sizes) for c in ("part", "shard"))
        row = {"bucket": t.column("bucket")[0].as_py(), "n_buckets": n, "n_keys": len(keys), **Index.build(keys, nulls, occurrences, places)}
        return pa.Table.from_pylist([row], pa.schema([*((c, pa.int32()) for c in ("bucket", "n_buckets", "n_keys", "seed")), ("pilots", pa.binary()), ("slots", pa.binary())]))

    dealt = shards.select("part", "shard", "keys", "nulls", "occurrences").mapInArrow(entries, "bucket int, part int, shard int, keys binary, nulls binary, occurrences binary")
    dealt.groupBy("bucket").applyInArrow(build, DIRECTORY).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/directory")


def get(spark: SparkSession, folder: str, keys: list[int | None], occurrence: int = 0) -> DataFrame:
    """doc_id, n_tokens and ids of those of a few keys that are there: the files of their buckets and of their parts are read, no others."""
    asked = sorted({k for k in keys if k is not None}) + [None] * (None in keys)
    values, nulls, number = np.array([k or 0 for k in asked], np.int64), np.array([k is None for k in asked], bool), np.full(len(asked), occurrence, np.uint32)
    directory = spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")
    first = directory.select("n_buckets").first()
    of: dict[tuple[int, int], list] = {}
    if first is not None and asked:
        bucket = bucket_of(values, nulls, number, first[0])
        for row in directory.where(F.col("bucket").isin(sorted(set(bucket.tolist())))).toLocalIterator():
            own, index = np.flatnonzero(bucket == row["bucket"]), Index(row.asDict(), PLACE)
            for i, at in zip(own, index.find(values[own], nulls[own], number[own])):
                if at >= 0:
                    of.setdefault((int(index.slots["part"][at]), int(index.slots["shard"][at])), []).append(asked[i])
    some = F.lit(False)
    for part in sorted({p for p, _ in of}):
        some |= (F.col("part") == part) & F.col("shard").isin(sorted(s for p, s in of if p == part))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                found = [(k, ids) for k in of[row["part"], row["shard"]] if (ids := shard.get(k, occurrence)) is not None]
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _shards(spark, folder).where(some).mapInArrow(take, "doc_id long, n_tokens long, ids binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, occurrence, start, n_tokens and ids (raw payload bytes as 32-bit ids) of all documents in the shard files.

    Each document is looked up through its shard's index. start: ids of all documents before it."""
    shards = _shards(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                at = shard.find(shard.keys, shard.nulls, shard.occurrences)
                if (at < 0).any() or len(np.unique(at)) != len(at):
                    raise ValueError("a shard's index doesn't hold its keys")
                found = shard.slots[at]
                ids = [shard.ids[f : f + c].astype("<u4").tobytes() for f, c in zip(found["first"].astype(np.int64), found["count"].astype(np.int64))]
                yield pa.record_batch(
                    [pa.array(np.full(len(at), row["part"], np.int32)), pa.array(shard.keys, mask=shard.nulls), pa.array(shard.occurrences.astype(np.int32)), pa.array(found["first"].astype(np.int64) + row["ids_before"]), pa.array(found["count"].astype(np.int64)), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "occurrence", "first", "n_tokens", "ids"],
                )

    # One row for each partition of the files: bounded by their number, not by the documents.
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = shards.mapInArrow(run, "part int, doc_id long, occurrence int, first long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", "occurrence", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")
