"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers (powers of two up to the longest window). From the longest tier down, each
document opens a window of its tier; the gap behind it is filled from shorter tiers, first by the longest whole piece that
fits, then by cutting a piece to the exact size. Text longer than the longest window fills whole windows first, and its rest
is routed again. What is left when no more text comes is cut into powers of two, which need no padding. The windows of a
tier are then dealt to step groups of equal token count (but one of what is left over), so that the attention cost (the sum of
squared piece lengths) of the groups is even.

Packing happens within an input partition, in groups of a bounded number of tokens, with what doesn't fill a window carried
to the next group: no text is shuffled, memory is bounded, and a lost task packs the same rows in the same way again.
Null text counts as empty and still has its end id; a null key passes through; repeated rows are packed each on its own; an
empty table gives no pieces."""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strata.llm.tokens import word_encoder

TIERS = (4096, 2048, 1024, 512)
#: Tokens that are packed together, and tokens of a step group.
GROUP_TOKENS, STEP_TOKENS = 1 << 20, 1 << 18

Piece = tuple[int, int, int]  # document (its place in the group), start, length
Window = tuple[int, list[Piece]]  # size, pieces in order


class _Supply:
    """Pieces by length, so that the longest one that fits a gap is found at once."""

    def __init__(self, found: Iterable[Piece]) -> None:
        self.by: dict[int, list[Piece]] = {}
        for p in found:
            self.by.setdefault(p[2], []).append(p)
        self.lengths = sorted(self.by)

    def add(self, p: Piece) -> None:
        if p[2] not in self.by:
            self.by[p[2]] = []
            insort(self.lengths, p[2])
        self.by[p[2]].append(p)

    def take(self, at: int) -> Piece:
        length = self.lengths[at]
        p = self.by[length].pop()
        if not self.by[length]:
            del self.by[length], self.lengths[at]
        return p

    def fill(self, gap: int, below: int) -> tuple[list[Piece], int]:
        """Pieces for a gap, and what of it stays open: whole pieces of shorter tiers first, then one cut to size."""
        out = []
        while gap and self.lengths:
            at = bisect_right(self.lengths, min(gap, below)) - 1
            if at >= 0:
                out.append(self.take(at))
            else:
                doc, start, length = self.take(0)
                self.add((doc, start + gap, length - gap))
                out.append((doc, start, gap))
            gap -= out[-1][2]
        return out, gap


def pack(pieces: Iterable[Piece], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[Window], list[Piece]]:
    """Windows that hold every token of the pieces once, and the pieces left for a later call (none if last)."""
    longest, windows, rest = tiers[0], [], []
    for doc, start, length in pieces:
        while length > longest:
            windows.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        if length:
            rest.append((doc, start, length))
    supply = _Supply(rest)
    for size, shorter in zip(tiers, (*tiers[1:], 0)):
        while supply.lengths and supply.lengths[-1] > shorter:
            opened = supply.take(len(supply.lengths) - 1)
            more, gap = supply.fill(size - opened[2], shorter or size)
            if gap:  # no text is left
                left = [opened, *more]
                return (windows, left) if not last else (windows + _tail(left), [])
            windows.append((size, [opened, *more]))
    return windows, []


def _tail(left: list[Piece]) -> list[Window]:
    """The last tokens, fewer than the longest window has, in windows that are powers of two."""
    out, n = [], sum(p[2] for p in left)
    queue = list(reversed(left))
    while n:
        size = gap = 1 << (n.bit_length() - 1)
        window = []
        while gap:
            doc, start, length = queue.pop()
            window.append((doc, start, min(gap, length)))
            if length > gap:
                queue.append((doc, start + gap, length - gap))
            gap -= window[-1][2]
        out.append((size, window))
        n -= size
    return out


def step_groups(windows: list[Window], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window. Groups of a tier hold as many windows as step_tokens allow, and one holds those left over, which are
    taken evenly from cheap to costly; the others are dealt, the costliest first, to the group of least cost with room."""
    out, by_size, base = [0] * len(windows), {}, 0
    for i, (size, _) in enumerate(windows):
        by_size.setdefault(size, []).append(i)
    cost = [sum(p[2] ** 2 for p in pieces) for _, pieces in windows]
    for size, own in sorted(by_size.items(), reverse=True):
        room = max(1, step_tokens // size)
        own.sort(key=lambda i: -cost[i])
        n, over = divmod(len(own), room)
        left = {own[(2 * k + 1) * len(own) // (2 * over)] for k in range(over)}
        heap = [(0, g, 0) for g in range(n)]
        for i in own:
            if i in left:
                out[i] = base + n
                continue
            total, g, held = heapq.heappop(heap)
            out[i] = base + g
            if held + 1 < room:
                heapq.heappush(heap, (total + cost[i], g, held + 1))
        base += n + (over > 0)
    return out


SCHEMA = "start long, length int, doc_tokens long, sequence_id long, offset int, tier int, step_group long, ids binary"
_NAMES = ["start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def pack_documents(docs: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: key, start in its document's ids, length, doc_tokens, sequence_id, offset in the sequence,
    tier (the sequence's size), step_group, and ids (little-endian unsigned 32-bit). path: a word-end vocabulary file."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()
        ids: dict[int, bytes] = {}
        keys: dict[int, object] = {}
        waiting: list[Piece] = []
        held = n_docs = n_windows = n_groups = 0
        high = TaskContext.get().partitionId() << 32
        key_type = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting, held, n_windows, n_groups
            windows, waiting = pack(waiting, tiers, last)
            groups = step_groups(windows)
            rows = []
            for (size, pieces), group in zip(windows, groups):
                offset = 0
                for doc, start, length in pieces:
                    rows.append((keys[doc], start, length, len(ids[doc]) // 4, high + n_windows, offset, size, high + n_groups + group, ids[doc][4 * start : 4 * (start + length)]))
                    offset += length
                n_windows += 1
            n_groups += max(groups, default=-1) + 1
            kept = {p[0] for p in waiting}
            for d in [d for d in ids if d not in kept]:
                del ids[d], keys[d]
            held = sum(p[2] for p in waiting)
            columns = list(zip(*rows)) if rows else [()] * 9
            return pa.record_batch([pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], _TYPES))], names=["key", *_NAMES])

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids[n_docs], keys[n_docs] = encoder.encode(t.as_py() or "") + end, k
                waiting.append((n_docs, 0, len(ids[n_docs]) // 4))
                held += len(ids[n_docs]) // 4
                n_docs += 1
                if held >= group_tokens:
                    yield flush(False)
        if waiting:
            yield flush(True)

    return docs.select(docs[key].alias("key"), docs[text].cast("string")).mapInArrow(run, f"`key` {kind}, {SCHEMA}").withColumnRenamed("key", key)
