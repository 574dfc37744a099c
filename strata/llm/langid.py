"""Language identification by language-bitmask n-gram filters.

Training gathers the n-grams of four bytes (letters in lower case, everything else a blank) that are frequent in each
language and puts them into one bit-sliced Bloom filter: every row of the filter is a mask with one bit for each language, in
as many words of 64 bits as the languages need, and the AND of an n-gram's rows gives all languages that contain it, in one
probe for all languages of a word. Prediction counts the bits of
each language over all n-grams of the whole text, corrects each share for that language's rate of false positives (which
follows from how full its slice is), and takes the language with the largest corrected share; that share is the score.

Null texts and texts without a letter get `und` and score 0. A text with letters but without evidence gets the language with
most training rows and score 0; ties go to the language that comes first by name. Rows without a label or text teach nothing;
with no training rows at all every prediction is `und`. Repeated rows and extra columns pass through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm._common import U64, mix64, text_buffer

#: Training uses about this many rows for each language, chosen by a hash of their key: a bounded sample.
SAMPLE_ROWS = 3000
#: An n-gram belongs to a language if it is at least this share of the language's n-grams: at most 1 / MIN_SHARE of them.
MIN_SHARE = 1e-5
#: Rows of the filter, and probes for each n-gram.
ROWS_LOG2, PROBES = 20, 2
#: Languages of a word of the masks.
WORD = 64
UNDETERMINED = "und"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of each row as 32-bit values, and the n + 1 offsets of the rows. An n-gram has at least three letters'
    bytes and doesn't cross rows; a row's first word has a blank before it and its last one a blank after it."""
    n_rows = len(offsets) - 1
    lengths = np.diff(offsets)
    wide = np.full(len(data) + 2 * n_rows, 0x20, np.uint8)
    at = np.ones(len(wide), bool)
    starts = offsets[:-1] + 2 * np.arange(n_rows)
    at[starts] = False
    at[starts + lengths + 1] = False
    wide[at] = _LETTERS[data]
    after = np.flatnonzero(wide[:-1] == 0xC3) + 1
    wide[after] += (((wide[after] >= 0x80) & (wide[after] <= 0x9E) & (wide[after] != 0x97)) * np.uint8(0x20)).astype(np.uint8)
    if len(wide) < 4:
        return np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)
    w = wide.astype(np.uint32)
    value = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    blank = (wide == 0x20).astype(np.int8)
    good = blank[:-3] + blank[1:-2] + blank[2:-1] + blank[3:] <= 1
    good &= ~((blank[1:-2] == 1) & (blank[2:-1] == 1))
    ends = starts + lengths + 2
    for k in (1, 2, 3):  # n-grams that reach into the next row
        cross = ends - k
        cross = cross[(cross >= 0) & (cross < len(good))]
        good[cross] = False
    kept = np.flatnonzero(good)
    return value[kept], np.searchsorted(kept, np.append(starts, len(wide)))


@dataclass
class LanguageFilter:
    languages: list[str]
    rows: np.ndarray  # for each word of the masks, that of each row
    default: int
    rates: np.ndarray  # of false positives, for each language

    @classmethod
    def build(cls, found: dict[str, np.ndarray], default: str, log2: int = ROWS_LOG2) -> LanguageFilter:
        """found: the n-grams of each language."""
        languages = sorted(found)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= min(len(languages), WORD))
        rows = np.zeros((-(-len(languages) // WORD), 1 << log2), kind)
        for i, name in enumerate(languages):
            for at in cls._at(found[name], log2):
                rows[i // WORD][at] |= kind(1 << i % WORD)
        full = np.array([((rows[i // WORD] >> kind(i % WORD)) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, rows, languages.index(default), full**PROBES)

    @staticmethod
    def _at(values: np.ndarray, log2: int) -> list[np.ndarray]:
        h = mix64(values.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
        return [((h >> U64(31 * i)) & U64((1 << log2) - 1)).astype(np.int64) for i in range(PROBES)]

    def masks(self, values: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages that contain each n-gram, of those in this word."""
        rows = self.rows[word]
        first, *more = self._at(values, len(rows).bit_length() - 1)
        out = rows[first]
        for at in more:
            out &= rows[at]
        return out

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row and language, the share of the row's n-grams in the language, corrected for false positives."""
        values, at = grams(data, offsets)
        n = np.maximum(np.diff(at), 1)
        out = np.empty((len(offsets) - 1, len(self.languages)))
        sums = np.zeros(len(values) + 1, np.int32)
        for i in range(len(self.languages)):
            if i % WORD == 0:
                masks = self.masks(values, i // WORD)
            np.cumsum((masks >> masks.dtype.type(i % WORD)) & masks.dtype.type(1), dtype=np.int32, out=sums[1:])
            out[:, i] = ((sums[at[1:]] - sums[at[:-1]]) / n - self.rates[i]) / (1 - self.rates[i])
        return np.clip(out, 0, 1)


def train(docs: DataFrame, teach: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageFilter | None:
    """A filter from those rows of docs for which `teach` is true. The rows of a language are sampled by a hash of their key."""
    spark = docs.sparkSession
    rows = docs.where(teach & F.col(lang).isNotNull() & (F.col(text) != ""))
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    shares = spark.createDataFrame(pa.table({"_lang": pa.array(list(counts), pa.string()), "_share": pa.array([min(1.0, sample_rows / n) for n in counts.values()])}))
    unit = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(shares), F.col(lang) == F.col("_lang")).where(unit < F.col("_share")).select(lang, F.col(text).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                names = np.array(batch.column(0).to_pylist(), object)
                values, at = grams(*text_buffer(batch.column(1)))
                of_row = np.repeat(names, np.diff(at)) if len(values) else np.zeros(0, object)
                for name in sorted(set(names)):
                    found, n = np.unique(values[of_row == name], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    each = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    folder_total = each.groupBy("lang").agg(F.sum("n").alias("total"))
    # At most 1 / MIN_SHARE n-grams of a language can each have MIN_SHARE of them.
    kept = each.join(F.broadcast(folder_total), "lang").where((F.col("n") >= F.col("total") * MIN_SHARE) & (F.col("n") > 1)).select("lang", "gram").toPandas()
    of = dict(iter(kept.groupby("lang")["gram"]))
    found = {k: of[k].to_numpy().astype(np.uint32) if k in of else np.zeros(0, np.uint32) for k in counts}
    return LanguageFilter.build(found, min(counts, key=lambda k: (-counts[k], k)))


def predict(docs: DataFrame, model: LanguageFilter | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) behind its columns, from the text alone. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    spark, names = docs.sparkSession, docs.columns
    place = names.index(text)
    shared = spark.sparkContext.broadcast(model)  # 1 to 8 MB for each 64 languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                column = batch.column(place).cast(pa.string())
                data, offsets = text_buffer(column)
                plain = np.concatenate([[0], np.cumsum((_LETTERS[data] != 0x20) & (data < 128))])
                ascii_letters = plain[offsets[1:]] > plain[offsets[:-1]]
                letters = [bool(ascii_letters[i]) or any(map(str.isalpha, column[i].as_py() or "")) for i in range(batch.num_rows)]
                if own is None:
                    langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
                else:
                    shares = own.shares(data, offsets)
                    best = np.where(shares.max(1) > 0, shares.argmax(1), own.default)
                    scores = np.where(letters, shares.max(1), 0.0)
                    langs = [own.languages[b] if x else UNDETERMINED for b, x in zip(best, letters)]
                yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
