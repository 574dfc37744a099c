"""Exact substring dedup by fixed-block anchors.

The index holds the non-overlapping blocks of ANCHOR words of every document; every rolling window of ANCHOR words probes it.
As a repeated passage of at least `window` (2 * ANCHOR or more) words contains a whole block wherever it begins, each passage
that repeats has a hit. Around hits, windows of `window` words are compared by a 96-bit hash, and those that also start
earlier (smaller key, or same key and earlier start) mark all their words: the union of overlapping windows is the maximal
exact repeat. Only the first start of each window is looked for, never pairs of occurrences, so a passage that very many
documents share costs one row for each part of the corpus. Windows are judged on the input.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged. Null and empty texts have no words. Documents that
repeat a key count as one sequence of starts in order of text, without windows across them. Null keys come first, in order of a hash
of their text (and of the number of parts), so that they don't meet in one task. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._common import U64, mix64, rolling, row_of, text_buffer, word_hashes, words
from strata.llm._repeats import SENT, answer, answered, by_part, cogroup, marks, send, within

WINDOW, ANCHOR = 20, 10


class _Part:
    """The documents of a part in order of key and text, with their word hashes."""

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
        nulls = t.column("key").null_count  # sorted to the end: they come first
        if nulls:
            t = pa.concat_tables([t.slice(t.num_rows - nulls), t.slice(0, t.num_rows - nulls)]).combine_chunks()
        self.table, self.n = t, t.num_rows
        self.part = t.column("part")[0].as_py() if self.n else 0
        self.data, offsets = text_buffer(t.column("text"))
        self.starts, self.ends, self.first = words(self.data, offsets)
        self.hash = word_hashes(self.data, self.starts, self.ends)
        self.row = row_of(self.first)
        self.offsets = offsets

    def whole(self, k: int) -> np.ndarray:
        """Word positions at which k words of one document begin."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.row[:n] == self.row[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def long_enough(self, at: np.ndarray, k: int) -> np.ndarray:
        return at[np.diff(self.first)[self.row[at]] >= k]


def _windows(p: _Part, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash for the k words at each position."""
    return rolling(p.hash, k, 2)[at], (rolling(p.hash, k, 3)[at] >> U64(32)).astype(np.uint32)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, block: int = 1 << 16) -> tuple[bytes, np.ndarray]:
    """The bytes of the kept words, each with a blank behind it, and the n + 1 places at which words begin there."""
    lengths = np.where(kept, ends - starts + 1, 0)
    place = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(place[-1], np.uint8)
    wide = np.append(data, np.uint8(0x20))
    for at in range(0, len(starts), block):
        n, lo, hi = lengths[at : at + block], place[at], place[min(at + block, len(starts))]
        out[lo:hi] = wide[np.arange(lo, hi) - np.repeat(place[at : at + len(n)] - starts[at : at + block], n)]
    out[place[1:][kept] - 1] = 0x20
    return out.tobytes(), place


def _key_order(keys: pa.ChunkedArray) -> np.ndarray:
    """Keys as numbers in order; null before all."""
    return keys.fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept (the kept words joined by one space), spans (first and last word removed, in runs) and the
    columns of docs named in carry. as_is: texts without a repeat are given unchanged."""
    anchor = window // 2
    names = [f"carry{i}" for i in range(len(carry))]
    own, n = by_part(docs, key, text, *(docs[c].alias(a) for c, a in zip(carry, names)))

    def probe(t: pa.Table) -> pa.Table:
        p = _Part(t)
        at = p.long_enough(p.whole(anchor), window)
        return send(p.part, rolling(p.hash, anchor)[at], (at - p.first[p.row[at]]) % anchor == 0, n)

    hits = answer(own.groupBy("part").applyInArrow(probe, SENT))
    layout = "bucket int, part int, high binary, low binary, doc binary, keys binary"

    def around(t: pa.Table, found: pa.Table) -> pa.Table:
        p = _Part(t)
        at = p.whole(anchor)
        hit = np.zeros(len(p.hash) + 1, np.int32)
        hit[at[within(marks(rolling(p.hash, anchor)[at], n), answered(found))] + 1] = 1
        so_far = np.cumsum(hit)
        at = p.whole(window)
        at = at[so_far[at + window - anchor + 1] > so_far[at]]
        high, low = _windows(p, at, window)
        order = np.lexsort((low, high))  # stable: the first of equal windows is the earliest
        h, l = high[order], low[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        at, h, l = at[order][first], h[first], l[first]
        keys = _key_order(p.table.column("key")) if p.n else np.zeros(0, np.int64)
        bucket = ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h)).tolist()
        rows = []
        for a, b in zip(edges, edges[1:]):
            docs_, index = np.unique(p.row[at[a:b]], return_inverse=True)
            rows.append((int(bucket[a]), p.part, h[a:b].tobytes(), l[a:b].tobytes(), index.astype(np.uint16 if len(docs_) < 1 << 16 else np.uint32).tobytes(), keys[docs_].tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.table({c.split()[0]: pa.array(v, pa.int32() if "int" in c else pa.binary()) for c, v in zip(layout.split(", "), columns)})

    candidates = cogroup(own, hits, around, layout)

    def settle(t: pa.Table) -> pa.Table:
        """For each part, those of its windows that start earlier in another part."""
        high = [np.frombuffer(x, U64) for x in t.column("high").to_pylist()]
        low = [np.frombuffer(x, np.uint32) for x in t.column("low").to_pylist()]
        keys = [np.frombuffer(k, np.int64)[np.frombuffer(d, np.uint16 if len(d) == 2 * len(l) else np.uint32)] for k, d, l in zip(t.column("keys").to_pylist(), t.column("doc").to_pylist(), low)]
        sizes = [len(x) for x in low]
        h, l, k = np.concatenate(high), np.concatenate(low), np.concatenate(keys)
        part = np.repeat(t.column("part").to_numpy(), sizes)
        order = np.lexsort((k, l, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (l[order][1:] != l[order][:-1])
        later = order[~first]
        rows = [(int(x), h[later[part[later] == x]]) for x in np.unique(part[later])]
        return pa.table({"part": pa.array([x for x, _ in rows], pa.int32()), "later": pa.array([v.tobytes() for _, v in rows], pa.binary())})

    verdicts = candidates.groupBy("bucket").applyInArrow(settle, "part int, later binary")

    def remove(t: pa.Table, found: pa.Table) -> pa.Table:
        p = _Part(t)
        at = p.whole(window)
        high, low = _windows(p, at, window)
        later = within(high, np.sort(np.frombuffer(b"".join(found.column("later").to_pylist()), U64)) if found.num_rows else np.zeros(0, U64))
        order = np.lexsort((low, high))
        h, l = high[order], low[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (l[1:] == l[:-1])
        later[order] |= again
        edge = np.zeros(len(p.hash) + window + 1, np.int32)
        np.add.at(edge, at[later], 1)
        np.add.at(edge, at[later] + window, -1)
        gone = np.cumsum(edge)[: len(p.hash)] > 0
        n_words = np.diff(p.first)
        removed = np.concatenate([[0], np.cumsum(gone)])
        raw, at_byte = joined(p.data, p.starts, p.ends, ~gone)
        texts, spans = [], []
        for i in range(p.n):
            a, b = p.first[i], p.first[i + 1]
            if as_is and not removed[b] - removed[a]:
                texts.append(bytes(p.data[p.offsets[i] : p.offsets[i + 1]]).decode() if p.table.column("text")[i].is_valid else None)
            else:
                texts.append(raw[at_byte[a] : max(at_byte[a], at_byte[b] - 1)].decode())
            runs = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
            spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(runs[::2], runs[1::2])])
        return pa.table({
            "key": p.table.column("key"), "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array((removed[p.first[1:]] - removed[p.first[:-1]]).astype(np.int64)),
            "kept": pa.array(texts, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            **{c: p.table.column(c) for c in names},
        })

    more = "".join(f", {a} {docs.schema[c].dataType.simpleString()}" for c, a in zip(carry, names))
    out = cogroup(own, verdicts, remove, "key long, n_words long, n_removed long, kept string, spans array<struct<first:int,last:int>>" + more)
    return out.withColumnsRenamed({"key": key, **dict(zip(names, carry))})


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(20)) AS k)
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
