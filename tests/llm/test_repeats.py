"""op3 and op5 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import catalogue, jaccard, substring
from strata.llm._common import rolling, text_buffer, word_hashes, words
from strata.llm.connected import UnionFind

WORD = re.compile("[^\x20\x09-\x0d]+")


def removed(docs, window):
    """By definition: {row: (n_words, n_removed, kept text)} for (key, text) rows."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1] or ""))
    seen, out = set(), {}
    for i in order:
        w = WORD.findall(docs[i][1] or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone[s : s + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g))
    return out


def classes(docs, n, num, den):
    sets = []
    for _, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    uf, least = UnionFind(len(docs)), {}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None:
                both = len(a & b) if min(len(a), len(b)) * den >= max(len(a), len(b)) * num else 0
                if both * den >= num * (len(a) + len(b) - both) or docs[i][0] == docs[j][0]:
                    uf.union(i, j)
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[uf.find(i)] = min(k, least.get(uf.find(i), k))
    return sorted((k if k is not None else -1, len(s), least[uf.find(i)] if k is not None else -1) for i, ((k, _), s) in enumerate(zip(docs, sets)))


def corpus(n, seed, n_words=300):
    """Texts with shared passages, near and exact copies, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "É.", "A", "a", "É"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.15:
            text = rng.choice(docs)[1]
        elif docs and kind < 0.5:
            w = (rng.choice(docs)[1] or "").split()
            for _ in range(rng.randrange(0, 8)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, n_words))]
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(passages)
            text = "".join(x + rng.choice([" ", "\n", "\t ", "  "]) for x in w)
        docs.append((i * 7 % 1009, text))
    docs += [(2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "One"), (2006, "one two"), (2007, "x " * 4000), (2008, "x " * 50), (None, "one"), (None, docs[0][1]), (docs[3][0], docs[5][1]), (docs[4][0], docs[4][1])]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, key string, part int")


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 6)])
def test_removed_words(spark, seed, window):
    docs = corpus(400, seed)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, docs), window=window).collect())
    want = removed(docs, window)
    assert got == sorted((docs[i][0] is not None, docs[i][0] or 0, *v) for i, v in want.items())
    assert any(v[1] for v in want.values())


def test_spans_are_the_removed_words(spark):
    docs = corpus(100, 9)
    for r in substring.remove_repeats(frame(spark, docs)).collect():
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed
    assert substring.remove_repeats(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("seed,n,num,den,cut", [(1, 3, 9, 10, 1 << 20), (2, 5, 8, 10, 1 << 20), (3, 3, 9, 10, 700), (4, 2, 5, 10, 3000)])
def test_jaccard(spark, seed, n, num, den, cut):
    docs = corpus(350, seed, 120)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.jaccard_classes(frame(spark, docs), n, num, den, task_ngrams=cut).collect())
    want = classes(docs, n, num, den)
    assert got == want
    assert len({x[2] for x in want}) < len(want) - 60


def link_counts(docs, n, num, den):
    """By definition: (key, other rows of similarity >= num / den) for each row."""
    sets = []
    for _, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    count = [0] * len(docs)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and len(a & b) * den >= num * len(a | b):
                count[i] += 1
                count[j] += 1
    return sorted((-1 if k is None else k, c) for (k, _), c in zip(docs, count))


@pytest.mark.parametrize("n,num,den,cut", [(3, 9, 10, 1 << 20), (5, 8, 10, 1 << 20), (3, 9, 10, 2000)])
def test_jaccard_counts_every_link(spark, n, num, den, cut):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = corpus(120, 5, 120)
    for i in range(40):  # a group of near copies, some of them equal, far more links than a forest has
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "other"
        docs.append((3000 + i, " ".join(w)))
    docs.append((3000, " ".join([*base[:-1], "last"])))  # a key whose two texts are near copies
    docs += [(4000, " ".join(f"y{i}" for i in range(80))), (4000, " ".join(f"y{i}" for i in range(81)))]  # and link with nothing else
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in jaccard.jaccard_classes(frame(spark, docs), n, num, den, task_ngrams=cut).collect())
    want = link_counts(docs, n, num, den)
    assert got == want
    assert sum(c for _, c in want) > 4 * len(docs)


def test_a_repeated_key_links_its_classes(spark):
    """Also where the key is the least of none, or only of one, of its classes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(3, a), (7, a), (7, b), (5, c), (9, b + " end"), (9, c)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, docs), 3, 9, 10).collect())
    assert got == classes(docs, 3, 9, 10) and {x[2] for x in got} == {3}


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_classes(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert jaccard.jaccard_classes(frame(spark, [(1, None), (2, "")])).count() == 2


def test_segments_lose_no_pair():
    """Each pair at or above the threshold shares an emitted segment, and sketches never overstate the difference."""
    rng = np.random.default_rng(7)
    for num, den in ((9, 10), (8, 10), (5, 10)):
        for size in (1, 2, 5, 10, 19, 40, 200, 1500):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            for _ in range(8):
                drop = rng.integers(0, max(1, len(a) * (den - num) // den) + 1)
                more = rng.integers(0, max(1, len(a) * (den - num) // den) + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
                both, far = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
                assert np.bitwise_count(jaccard.short_sketch(a) ^ jaccard.short_sketch(b)).sum() <= far
                if far and both and both * den >= num * (len(a) + len(b) - both):
                    keys, rows, sketch, need = jaccard.sketch_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), jaccard.Bands(num, den, 4000))
                    shared = np.isin(keys, np.intersect1d(keys[rows == 0], keys[rows == 1]))
                    met = np.bincount(sketch[shared], minlength=len(need)) >= need
                    assert set(keys[shared & (rows == 0) & met[sketch]]) & set(keys[shared & (rows == 1) & met[sketch]])


def test_words_and_hashes():
    texts = ["a b", "b", "", " b a\x0b\x0cb ", "x" * 700_000 + " b", "é b", "a\xa0b"]
    data, offsets = text_buffer(pa.array(texts))
    starts, ends, first = words(data, offsets)
    found = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert found == [WORD.findall(t) for t in texts]
    h = word_hashes(data, starts, ends, 64)
    of = {}
    for w, x in zip([w for f in found for w in f], h):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_op3_and_op5_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = removed(docs, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalogue.op3_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {docs[i][0]: (*v[:2], hashlib.sha256(v[2].encode()).hexdigest()) for i, v in want.items()}
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in catalogue.op5_jaccard(spark, "/root/testdata/sf0.001").collect())
    assert got == classes(docs, 3, 9, 10)


def thue_morse(n, zero="a", one="b"):
    """The sequence of n letters whose pattern and complement collide in polynomial hashes modulo powers of two."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join((zero, one)[b] for b in bits), "".join((one, zero)[b] for b in bits)


@pytest.mark.parametrize("n", [32, 64, 65, 1024, 4096])
def test_regular_words_do_not_collide(spark, n):
    """Words of two letters in a regular pattern: neither removed as a repeat nor linked."""
    x, y = thue_morse(n)
    docs = [(1, " ".join([x] * 40)), (2, " ".join([y] * 40)), (3, x), (4, y), (5, " ".join([x, y] * 20)), (6, " ".join([y, x] * 20)), (7, y)]
    want = removed(docs, 20)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, docs)).collect())
    assert got == sorted((docs[i][0], *v) for i, v in want.items())
    rows = jaccard.jaccard_classes(frame(spark, docs), 3, 9, 10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == classes(docs, 3, 9, 10)
    assert sorted((r.doc_id, r.n_links) for r in rows) == link_counts(docs, 3, 9, 10)


def test_rolling_names_each_run():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 4, 3000).astype(np.uint64)
    for k in (1, 2, 3, 4, 5, 7, 10, 20, 33):
        found = rolling(values, k, 2, block=100)
        runs = [tuple(values[i : i + k].tolist()) for i in range(len(values) - k + 1)]
        assert len(found) == len(runs) and len(set(zip(runs, found.tolist()))) == len(set(runs)) == len(set(found.tolist()))
    assert len(rolling(values[:4], 5)) == 0


def test_regular_runs_of_words_do_not_collide():
    x, y = (np.array([ord(c) for c in t], np.uint64) for t in thue_morse(4096))
    assert rolling(x, 4096, 7)[0] != rolling(y, 4096, 7)[0]


def test_parts_grow_with_the_root_of_the_corpus():
    from strata.llm import _repeats

    for total in (1 << 30, 90 << 30, 1 << 40, 40 << 40):
        size = _repeats.part_bytes(total)
        n = -(-total // size)
        assert size <= _repeats.LARGEST_PART and (size == _repeats.PART_BYTES or size / 6 / n > 0.9 * _repeats.ROW_HASHES)
    assert _repeats.part_bytes(100 << 40) == _repeats.LARGEST_PART


def test_many_null_and_repeated_keys(spark):
    """Null keys link with nothing in op5 and come first in op3; tables of nothing else work."""
    docs = corpus(60, 11, 80)
    nulls = [(None, f"{t} own{i}") for i, (_, t) in enumerate(docs[:30])]
    rows = substring.remove_repeats(frame(spark, nulls + [(5, docs[0][1])])).collect()
    assert len(rows) == 31 and {r.n_removed for r in rows if r.doc_id == 5} == {removed(nulls + [(5, docs[0][1])], 20)[30][1]}
    assert {(r.component_id, r.n_links) for r in jaccard.jaccard_classes(frame(spark, nulls)).collect()} == {(None, 0)}
    same = [(7, t) for _, t in docs]
    want = removed(same, 20)
    assert sorted((r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame(spark, same)).collect()) == sorted(want.values())
