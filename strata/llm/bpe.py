"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text picks cut points that depend only on nearby content, so passages that documents
share fall into equal chunks. The chunks that come most often in the whole corpus are encoded once, by their hashes' counts, and go to
every worker as a table of bounded size; other chunks that come again are kept by the worker that sees them, the longest unused going
first. Where chunks meet, the ids near the joint may differ from those of the whole text: the joint is encoded again together with a
piece of each side, and if these pieces' ids are what the chunks have, the sides agree and the joint is repaired; else the joint grows
over the piece or chunk that disagrees, and is encoded again. The ids equal those of the tokenizers library for the whole text.

Null text counts as empty and gives no ids. Documents are taken as they come: repeated rows, extra columns and null keys
pass through, and an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._common import _BYTE, U64, text_buffer
from strata.llm.tokens import byte_encoder, pieces

#: A chunk ends where this many low bits of the rolling hash over the last 16 bytes are zero: about 512 bytes apart.
CHUNK_BITS, WINDOW = 9, 16
#: Chunks that every worker gets, and the longest of them in bytes: 16 MB of text at most, whatever the corpus.
SHARED_CHUNKS, SHARED_BYTES = 8192, 2048
#: Chunks of a generation that a worker keeps, and slots of the table that tells whether a chunk came before.
CHUNKS_KEPT, SEEN_SLOTS = 20_000, 1 << 22


def content_cuts(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Byte positions before which a chunk starts: a function of the WINDOW bytes before each, moved to a character's start."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    value = (_BYTE[data] >> U64(32)).astype(np.uint32)
    h = np.zeros(len(data) - WINDOW + 1, np.uint32)
    for i in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += value[i : i + len(h)]
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + WINDOW
    cuts = cuts[cuts < len(data)]
    return cuts[(data[cuts] & 0xC0) != 0x80]


class Chunk:
    """A chunk's ids between its first and last cuts that may be exact; what lies outside is open until its neighbours are known."""

    __slots__ = ("head", "first", "body", "last", "tail")

    def __init__(self, head: str, first: tuple[str, bytes], body: tuple[str, bytes], last: tuple[str, bytes], tail: str) -> None:
        #: Texts with their ids: the first piece of what is settled, all of it but the last piece, and the last piece.
        self.head, self.first, self.body, self.last, self.tail = head, first, body, last, tail

    @classmethod
    def of(cls, chunk: bytes, ids: Callable[[str], bytes]) -> Chunk | None:
        """None where a chunk has too few pieces to have a middle, or its middle doesn't agree with its own edges."""
        found = pieces(chunk.decode())
        if len(found) < 4:
            return None
        head, *middle, tail = found
        text, first, last = "".join(middle), (middle[0], ids(middle[0])), (middle[-1], ids(middle[-1]))
        whole = ids(text)
        if not (whole.startswith(first[1]) and whole.endswith(last[1])):
            return None
        return cls(head, first, (text[: len(text) - len(last[0])], whole[: len(whole) - len(last[1])]), last, tail)


class Kept:
    """The chunks that a worker keeps, in two generations: what isn't used while one fills is dropped."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, chunk: bytes) -> Chunk | None:
        if (found := self.young.get(chunk)) is None and (found := self.old.get(chunk)) is not None:
            self.put(chunk, found)
        return found

    def put(self, chunk: bytes, made: Chunk) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[chunk] = made


class ChunkEncoder:
    """encode(bytes, cuts) gives the ids of a whole text. ids: the ids of a text alone; shared: chunks that come often in the corpus."""

    def __init__(self, ids: Callable[[str], bytes], shared: list[bytes] | tuple = (), kept: int = CHUNKS_KEPT) -> None:
        self.ids, self.kept = ids, Kept(kept)
        self.shared = {c: made for c in shared if (made := Chunk.of(c, ids)) is not None}
        self.seen, self.n_seen, self.reused, self.widened = np.zeros(SEEN_SLOTS, bool), 0, 0, 0

    def _again(self, chunk: bytes) -> bool:
        """Whether the chunk came before, or another of its slot; the table starts anew when it is half full."""
        slot = hash(chunk) % SEEN_SLOTS
        if self.seen[slot]:
            return True
        if self.n_seen * 2 >= SEEN_SLOTS:
            self.seen[:], self.n_seen = False, 0
        self.seen[slot], self.n_seen = True, self.n_seen + 1
        return False

    def _chunk(self, chunk: bytes) -> Chunk | None:
        """A chunk that came before in the corpus or in this worker."""
        if (found := self.shared.get(chunk) or self.kept.get(chunk)) is not None:
            self.reused += 1
        elif self._again(chunk) and (found := Chunk.of(chunk, self.ids)) is not None:
            self.kept.put(chunk, found)
        return found

    def encode(self, text: bytes, cuts: list[int]) -> bytes:
        settled: list[tuple[str, bytes]] = []  # stretches of text with their ids
        open_ = ""  # what is open behind them
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            raw = text[a:b]
            chunk = self._chunk(raw)
            if chunk is None:
                open_ += raw.decode()
                continue
            open_, ids = self._joint(settled, open_ + chunk.head, chunk.first)
            if ids is None:  # the right side disagrees: the joint grows over this chunk
                self.widened += 1
                open_ = open_[: len(open_) - len(chunk.head)] + raw.decode()
                continue
            settled += [(open_, ids), chunk.body, chunk.last]  # the last piece is the left side of the next joint
            open_ = chunk.tail
        open_, ids = self._joint(settled, open_, ("", b""))
        return b"".join((*(x for _, x in settled), ids))

    def _joint(self, settled: list[tuple[str, bytes]], joint: str, right: tuple[str, bytes]) -> tuple[str, bytes | None]:
        """The joint and its ids, once both sides agree; it grows to the left over what disagrees. None: the right side disagrees."""
        while True:
            left = next((x for x in reversed(settled) if x[0]), ("", b""))
            found = self.ids(left[0] + joint + right[0])
            if not found.endswith(right[1]):
                return joint, None
            if found.startswith(left[1]):
                return joint, found[len(left[1]) : len(found) - len(right[1])]
            self.widened += 1
            while settled:
                stretch = settled.pop()[0]
                joint = stretch + joint
                if stretch:
                    break


def chunks_of(column: pa.Array) -> Iterator[tuple[bytes, list[int]]]:
    """Each text's bytes and the places at which its chunks after the first begin."""
    data, offsets = text_buffer(column)
    cuts, raw = content_cuts(data), data.tobytes()
    of_row = np.searchsorted(cuts, offsets, "right")
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        yield raw[lo:hi], (cuts[of_row[i] : np.searchsorted(cuts, hi)] - lo).tolist()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            yield from chunks_of(whole.column(0).slice(at, 512))


def frequent_chunks(docs: DataFrame, text: str = "text", n: int = SHARED_CHUNKS) -> list[bytes]:
    """The at most n chunks of more than one row that come most often in all texts: one scan counts hashes, and one fetches the chunks."""
    texts = docs.select(docs[text].cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hashes = [xxhash.xxh64_intdigest(t[a:b]) for t, cuts in _texts([whole]) for a, b in zip([0, *cuts], [*cuts, len(t)]) if b - a <= SHARED_BYTES]
            found, times = np.unique(np.array(hashes, U64), return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(times)], names=["h", "n"])

    counts = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = {r.h & (1 << 64) - 1 for r in counts.orderBy(F.desc("n"), "h").limit(n).collect()}  # bounded by n
    if not wanted:
        return []

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted)
        for t, cuts in _texts(batches):
            found = {h: t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)]) if b - a <= SHARED_BYTES and (h := xxhash.xxh64_intdigest(t[a:b])) in left}
            left -= found.keys()
            if found:
                yield pa.record_batch([pa.array(np.array(list(found), U64).view(np.int64)), pa.array(list(found.values()), pa.binary())], names=["h", "chunk"])

    return [r.chunk for r in texts.mapInArrow(fetch, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk")).collect()]


_OF_TABLE: dict[tuple[str, int], ChunkEncoder] = {}


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", n_shared: int = SHARED_CHUNKS) -> DataFrame:
    """key and ids (array of int) for each row of docs; path: a byte-level vocabulary file of the tokenizers library."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, text, n_shared))
    name = (path, hash(tuple(shared.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OF_TABLE:
            _OF_TABLE.clear()
            _OF_TABLE[name] = ChunkEncoder(byte_encoder(path).encode, shared.value)
        chunked = _OF_TABLE[name]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = [chunked.encode(t, cuts) for t, cuts in chunks_of(batch.column(1))]
                lengths = np.cumsum([0, *(len(x) // 4 for x in out)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.int32(), int(lengths[-1]), [None, pa.py_buffer(b"".join(out))])
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths), ids)], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text].cast("string")).mapInArrow(run, f"`key` {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of encoded, and decoded (in the place of one of that name): the text of its ids, special tokens included.
    Null ids give null."""
    encoded = encoded.drop("decoded")
    names = encoded.columns
    place = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = byte_encoder(path).bytes_of
        table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                column = batch.column(place)
                values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = []
                for i in range(batch.num_rows):
                    own = values[offsets[i] : offsets[i + 1]].tolist()
                    texts.append(b"".join(map(table.__getitem__, own)).decode("utf-8", "replace") if column[i].is_valid else None)
                yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")
