"""Exact Jaccard self-join of documents on word n-grams by parity sketches.

A document's set holds its distinct n-grams of lower-cased words. Sets are mapped to bit sketches of k segments: each n-gram's
hash names a segment and a bit in it, and setting a bit twice clears it, so the Hamming distance of two sketches is at most the
symmetric difference of their sets. Segments are wide (2**32 bits) and are kept as the XOR of one random word for each bit.
In a size band, a pair that reaches the threshold differs by at most d n-grams, hence in at most d of its k > d segments: it
agrees in a segment (pigeonhole). A document emits the segments of its own band and of the next larger one, so each pair meets
in the band of its larger set; it leaves out its empty segments if more than d others are left, which loses no pair. Of the e
segments that it emits so, at least e - d must come again in a partner: a document with fewer shared ones has no partner in
that band and drops out before sets are compared.

Sets that are equal are one class from the start (by two 64-bit sums of hashes and the size). Segments that only one class has
are dropped by the exchange of _repeats. Classes that share a segment, directly or through others, form candidate groups; a
group's sets meet in one task, or in tasks for pairs of blocks where it is large, and there a short sketch of each set bounds
the symmetric difference of a pair from below before the sets themselves are intersected. Every pair that the bound leaves is
intersected, and a task returns the number of links of each class, weighted by the other's rows, beside a spanning forest of
them. Where only components are wanted (drop_near_copies), pairs that are already connected aren't looked at again.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z in lower case. A document with fewer words than n has
its whole sequence as its one n-gram; one without words or text has an empty set and links with nothing. Rows with a null key
link with nothing and have a null component. Rows that repeat a key are in one component through it, whatever their classes, in
jaccard_classes; drop_near_copies goes by row. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strata.llm._common import U64, by_task, join_by_key, lower_ascii, mix64, rolling, row_of, stored, text_buffer, word_hashes, words
from strata.llm._repeats import SENT, answer, answered, by_part, cogroup, marks, send, within
from strata.llm.connected import UnionFind, components, with_least

#: N-grams of the sets of a block, a quarter of the most (8 bytes each), and bits of the short sketches there.
TASK_NGRAMS, SHORT_BITS = 1 << 20, 2048


def ngram_sets(column: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, end to end, and the rows' offsets."""
    data, offsets = text_buffer(column)
    data = lower_ascii(data)
    starts, ends, first = words(data, offsets)
    h, row, counts = word_hashes(data, starts, ends), row_of(first), np.diff(first)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    grams = rolling(h, n, 11)
    for i in np.flatnonzero(counts):
        a, b = first[i], first[i + 1]
        own = np.unique(grams[a : b - n + 1]) if b - a >= n else rolling(h[a:b], int(b - a), 100 + int(b - a))
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def class_sums(grams: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums of hashes of each set; with its size, they name the set."""
    sums = [np.concatenate([[U64(0)], np.cumsum(mix64(grams ^ U64(c)), dtype=U64)]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [(x[offsets[1:]] - x[offsets[:-1]]).view(np.int64) for x in sums]


class Bands:
    """Size bands for Jaccard similarity >= num / den."""

    def __init__(self, num: int, den: int, largest: int) -> None:
        self.num, self.den, self.low = num, den, [1]
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * den // num + 1)
        self.low.append(self.low[-1] * den // num + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def distance(self, band: int) -> int:
        """The largest symmetric difference of a pair whose larger set is in this band."""
        most = self.low[band] * self.den // self.num
        return 2 * most * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        d = self.distance(band)
        return d + 2 + (d + 1) // 4


def sketch_keys(grams: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the emitted segments of each set; the row of each key; its sketch (a row in a band); and how many keys of each
    sketch any partner must share."""
    sizes = np.diff(offsets)
    out, rows, sketches, needs, n_sketches = [], [], [], [], 0
    own = bands.of(np.maximum(sizes, 1))
    for step in (0, 1):
        k_of = np.array([bands.segments(b) for b in range(len(bands.low))])
        band = own + step
        alive = np.flatnonzero((sizes > 0) & (np.array([bands.distance(b) for b in range(len(bands.low))])[band] > 0))
        if not len(alive):
            continue
        k = k_of[band[alive]]
        base = np.concatenate([[0], np.cumsum(k)])
        row_of_gram = np.repeat(np.arange(len(alive)), sizes[alive])
        take = np.arange(len(row_of_gram)) - np.repeat(np.cumsum(sizes[alive]) - sizes[alive] - offsets[:-1][alive], sizes[alive])
        g = grams[take]
        # The segment is named by the hash and the band; the bit's random word is the hash, mixed.
        segment = (mix64(g + U64(0x632BE59BD9B4E019)) >> U64(32)) * k[row_of_gram].astype(U64) >> U64(32)
        place = base[row_of_gram] + segment.astype(np.int64)
        parity, count = np.zeros(base[-1], U64), np.bincount(place, minlength=base[-1])
        np.bitwise_xor.at(parity, place, mix64(g ^ U64(0xA24BAED4963EE407)))
        row = np.repeat(np.arange(len(alive)), k)
        d = np.array([bands.distance(b) for b in band[alive]])
        full = np.bincount(row[count > 0], minlength=len(alive))
        enough = full > d
        keep = (count > 0) | ~enough[row]
        number = np.arange(base[-1]) - base[row]
        key = mix64(parity + mix64((band[alive][row].astype(U64) << U64(40)) + number.astype(U64)))
        out.append(key[keep])
        rows.append(alive[row[keep]])
        sketches.append(row[keep] + n_sketches)
        needs.append(np.where(enough, full - d, 1))
        n_sketches += len(alive)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows), np.concatenate(sketches), np.concatenate(needs)


def short_sketch(own: np.ndarray) -> np.ndarray:
    """A parity sketch of SHORT_BITS bits."""
    bit = own & U64(SHORT_BITS - 1)
    out = np.zeros(SHORT_BITS // 64, U64)
    np.bitwise_xor.at(out, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right rows (places in sets)."""
    sizes, sketches = np.array([len(x) for x in sets], np.int64), np.array([short_sketch(x) for x in sets])
    label, out = np.arange(len(sets)), []
    same = left is right
    for x, i in enumerate(left):
        others = right[x + 1 :] if same else right
        others = others[label[others] != label[i]]
        a, b = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[a * den >= b * num]
        if not len(others):
            continue
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1)
        others = others[apart * (den + num) <= (sizes[i] + sizes[others]) * (den - num)]
        for j in others:
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * den >= num * (sizes[i] + sizes[j] - both):
                    out.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
    return out


def count_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, copies: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each set, the copies of those that it links with over the pairs of left and right rows, and a spanning forest of the links."""
    sizes, sketches = np.array([len(x) for x in sets], np.int64), np.array([short_sketch(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(names), bool)
    count, joined, out = np.zeros(len(sets), np.int64), UnionFind(len(sets)), []
    same = left is right
    for x, i in enumerate(left):
        others = right[x + 1 :] if same else right
        a, b = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[a * den >= b * num]
        if not len(others):
            continue
        apart = np.bitwise_count(sketches[others] ^ sketches[i]).sum(1)
        others = others[apart * (den + num) <= (sizes[i] + sizes[others]) * (den - num)]
        own = ids[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        # As many sets at once as TASK_NGRAMS n-grams hold.
        for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(sizes[others]) // TASK_NGRAMS)) + 1) if len(others) else ():
            first = np.cumsum(sizes[some]) - sizes[some]
            both = np.add.reduceat(held[ids[np.arange(sizes[some].sum()) + np.repeat(starts[some] - first, sizes[some])]], first, dtype=np.int64)
            linked = some[both * den >= num * (sizes[i] + sizes[some] - both)]
            count[i] += copies[linked].sum()
            count[linked] += copies[i]
            out += [(int(i), j) for j in linked.tolist() if joined.union(int(i), j)]
        held[own] = False
    return count, out


def linked_classes(docs: DataFrame, n: int, num: int, den: int, text: str, key: str, task_ngrams: int, count: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members: key, n, a and b (which name the class) of each row. Classes: n, a, b, rep (the least key), copies (rows) and id.
    Links: a spanning forest of links of similarity >= num / den as ids a and b and keys rep_a and rep_b, where n < 0; if count,
    also, where n >= 0, that class a links with n rows of other classes."""
    spark = docs.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                grams, offsets = ngram_sets(batch.column(1), n)
                yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), *map(pa.array, class_sums(grams, offsets))], names=["key", "n", "a", "b"])

    members = stored(docs.select(docs[key].cast("long"), docs[text].cast("string")).mapInArrow(summarise, "key long, n long, a long, b long"), "members")
    classes = members.where("n > 0 AND key IS NOT NULL").groupBy("n", "a", "b").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 1
    bands = Bands(num, den, largest)

    own, n_parts = by_part(docs.where(docs[key].isNotNull()), key, text)
    part = F.pmod(F.xxhash64("rep"), F.lit(n_parts)).cast("int")
    reps = classes.select(part.alias("part"), "rep", "n", "a", "b", "copies", "id")

    def sets_of(t: pa.Table, r: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of r, n-grams and offsets of the classes, each from one document: a key that repeats may stand for several."""
        t = t.filter(pa.compute.is_in(t.column("key"), r.column("rep").combine_chunks())).combine_chunks()
        grams, offsets = ngram_sets(t.column("text"), n)
        place = {c: i for i, c in enumerate(zip(*(r.column(x).to_pylist() for x in ("rep", "n", "a", "b"))))}
        found = zip(t.column("key").to_pylist(), np.diff(offsets).tolist(), *(x.tolist() for x in class_sums(grams, offsets)))
        at = np.array([place.pop(c, -1) for c in found], np.int64)
        use = np.flatnonzero(at >= 0)
        if len(use) < len(at):
            parts = [grams[offsets[i] : offsets[i + 1]] for i in use]
            grams, offsets = np.concatenate([np.zeros(0, U64), *parts]), np.cumsum([0, *map(len, parts)])
        return at[use], grams, offsets

    def emit(t: pa.Table, r: pa.Table) -> pa.Table:
        _, grams, offsets = sets_of(t, r)
        keys = sketch_keys(grams, offsets, bands)[0]
        return send(t.column("part")[0].as_py() if t.num_rows else 0, keys, None, n_parts)

    answers = answer(cogroup(own, reps, emit, SENT))
    both = answers.unionByName(reps, allowMissingColumns=True)

    def candidates(t: pa.Table, r: pa.Table) -> pa.Table:
        found = answered(r.filter(pa.compute.is_valid(r.column("bucket"))))
        own_classes = r.filter(pa.compute.is_valid(r.column("id"))).slice(0, None if len(found) else 0)
        place, grams, offsets = sets_of(t, own_classes)
        keys, rows, sketch, need = sketch_keys(grams, offsets, bands)
        own_marks = marks(keys, n_parts)
        hit = within(own_marks, found)
        hit &= (np.bincount(sketch[hit], minlength=len(need)) >= need)[sketch]
        rows, own_marks = rows[hit], own_marks[hit]
        order = np.argsort(rows, kind="stable")
        rows, own_marks = rows[order], own_marks[order].view(np.int64)
        at, first = np.unique(rows, return_index=True)
        ends = np.append(first, len(rows))
        about = own_classes.select(["id", "rep", "copies", "n"]).take(pa.array(place[at]))
        return pa.table({
            **{c: about.column(c) for c in about.column_names},
            "grams": pa.array([grams[offsets[i] : offsets[i + 1]].tobytes() for i in at], pa.binary()),
            "keys": pa.array([own_marks[a:b] for a, b in zip(ends, ends[1:])], pa.list_(pa.int64())),
        })

    found = stored(cogroup(own, both, candidates, "id long, rep long, copies long, n long, grams binary, keys array<long>"), "candidates")

    # Candidate groups: every class with the least class that shares a segment with it.
    emitted = found.select("id", F.explode("keys").alias("k"))
    groups = components(with_least(emitted, "k", "id", False).where("id > m").select(F.col("id").alias("a"), F.col("m").alias("b")))
    grouped = found.select("id", "rep", "copies", "n", "grams").join(groups.select(F.col("node").alias("id"), F.col("component_id").alias("group")), "id")
    # The blocks of a group grow with it, so that what is sent more than once stays in proportion, between bounds for tasks' memory.
    block = F.greatest(F.lit(task_ngrams // 16), F.least(F.lit(4 * task_ngrams), F.col("total") / 12))
    sizes = grouped.groupBy("group").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")).select("group", "members", F.ceil(F.col("total") / block).cast("int").alias("blocks"))
    tasks = (
        join_by_key(grouped, sizes, ["group"], "members", found.count())
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "rep", "copies", "grams")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_task(batches, ["group", "low", "high"]):
            sets = [np.frombuffer(x, U64) for x in t.column("grams").to_pylist()]
            ids, rep, copies, block = (t.column(c).to_numpy() for c in ("id", "rep", "copies", "own"))
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            left = np.flatnonzero(block == low)
            right = left if low == high else np.flatnonzero(block == high)
            n_links, edges = count_links(sets, left, right, copies, num, den) if count else (np.zeros(len(sets), np.int64), verify(sets, left, right, num, den))
            linked, edges = np.flatnonzero(n_links), np.array(edges, np.int64).reshape(-1, 2)
            ends = np.concatenate([np.column_stack([linked, linked]), edges])
            n_of = np.concatenate([n_links[linked], np.full(len(edges), -1)])
            yield pa.record_batch([*(pa.array(x[ends[:, side]]) for x in (ids, rep) for side in (0, 1)), pa.array(n_of)], names=["a", "b", "rep_a", "rep_b", "n"])

    work_tasks = tasks.repartition(n_tasks, "group", "low", "high").sortWithinPartitions("group", "low", "high", "id")
    return members, classes, stored(work_tasks.mapInArrow(work, "a long, b long, rep_a long, rep_b long, n long"), "links")


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id", task_ngrams: int = TASK_NGRAMS) -> DataFrame:
    """key, n_shingles, component_id (the least key that it reaches over links of similarity >= num / den) and n_links (the other
    rows that it has such a link with) for each row."""
    members, classes, links = linked_classes(docs, n, num, den, text, key, task_ngrams, count=True)
    # A key with several classes links them: an edge to the least key of each.
    keyed, one = members.where("n > 0 AND key IS NOT NULL"), F.struct("n", "a", "b")
    repeated = keyed.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low < high").select("key")
    same_key = keyed.join(repeated, "key").join(classes, ["n", "a", "b"]).select(F.col("key").alias("a"), F.col("rep").alias("b"))
    ends = components(links.where("n < 0").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(same_key))
    counts = links.where("n >= 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    of_class = classes.join(ends.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "id", "left")
    of_class = of_class.select("n", "a", "b", "copies", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = join_by_key(keyed, of_class, ["n", "a", "b"], "copies", members.count()).select("key", "n", "component_id", "n_links")
    rest = members.where("n = 0 OR key IS NULL").select("key", "n", F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(rest).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id", task_ngrams: int = TASK_NGRAMS) -> DataFrame:
    """docs with one row of each group of rows that reach each other over links of similarity >= num / den: that of the least key,
    and of equal keys the least class and row. Rows without words or key stay. What a row's key is elsewhere links nothing here."""
    members, classes, links = linked_classes(docs, n, num, den, text, key, task_ngrams, count=False)
    ends = components(links.where("n < 0").select("a", "b"))
    groups = classes.join(ends.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("component_id", "id").alias("group"))
    kept = stored(groups.agg(F.min(F.struct(F.col("rep").alias("key"), "n", "a", "b")).alias("one")).select("one.*"), "kept")
    keyed = members.where("key IS NOT NULL")
    repeated = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "repeated")
    gone = keyed.where("n > 0").join(kept, "key", "left_anti").select("key")
    once = docs.join(gone.unionByName(repeated).distinct().withColumnRenamed("key", key), key, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return once

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                grams, offsets = ngram_sets(batch.column(batch.schema.get_field_index(text)), n)
                yield pa.record_batch([*batch.columns, pa.array(np.diff(offsets)), *map(pa.array, class_sums(grams, offsets))], names=[*batch.schema.names, "_n", "_a", "_b"])

    # Rows of a key that repeats are told apart by their class.
    again = docs.join(repeated.withColumnRenamed("key", key), key, "left_semi").select(*docs.columns)
    again = stored(again.mapInArrow(classify, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("_n", "_a", "_b"))])), "again")
    own = [key, "_n", "_a", "_b"]
    best = again.join(kept.toDF(*own), own, "left_semi").groupBy(*own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(best).unionByName(again.where("_n = 0").select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM texts
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.c = l.a
), components AS (
  SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id
), counts AS (
  SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM sets JOIN components USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
