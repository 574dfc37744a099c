"""op1, op7 and the component search against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import catalogue, neardup, topk
from strata.llm.connected import UnionFind, components


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def truth(ids, x, threshold):
    s = unit(x) @ unit(x).T
    near = s >= threshold
    np.fill_diagonal(near, False)
    uf = UnionFind(len(ids))
    for i, j in zip(*np.nonzero(near)):
        uf.union(int(i), int(j))
    least = {}
    for i, v in enumerate(ids):
        least[uf.find(i)] = min(v, least.get(uf.find(i), v))
    return {v: (int(near[i].sum()), least[uf.find(i)]) for i, v in enumerate(ids)}


def clustered(n, d=64, seed=3):
    """Vectors with near copies at all distances about the threshold, exact copies, and one large group."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    near = base[rng.integers(0, len(base), n // 2)] + rng.normal(size=(n // 2, d)) * rng.uniform(0, 0.45, (n // 2, 1))
    hot = base[:1] + rng.normal(size=(n // 4, d)) * 0.1
    return np.concatenate([base, near, hot, base[:20], base[:1].repeat(50, 0)]).astype(np.float32)


def compare(got, want, recall, ids):
    """Never a link too many; links found; and components: the same where no link of theirs was missed, and else only finer."""
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(v[0] for v in got.values()) >= recall * sum(v[0] for v in want.values())
    missed = {want[i][1] for i in ids if got[i][0] != want[i][0]}
    assert all(got[i] == want[i] for i in ids if want[i][1] not in missed)
    of = {}
    for i in ids:
        assert of.setdefault(got[i][1], want[i][1]) == want[i][1]


def test_near_duplicates(spark):
    x = clustered(3000)
    ids = np.random.default_rng(5).permutation(len(x) * 3)[: len(x)].tolist()
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist(), "x", 1, 2) for i, v in zip(ids, x)], f"vec_id long, embedding array<{kind}>, unit string, id int, k int")
        rows = neardup.near_duplicates(df).collect()
        compare({r.vec_id: (r.n_links, r.component_id) for r in rows}, truth(ids, x.astype(float), 0.95), 0.99, ids)
        assert len(rows) == len(ids) and all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_blocks_change_nothing(spark, monkeypatch):
    """A large bucket in many blocks, each pair of blocks a task."""
    x, ids = clustered(1200), list(range(1270))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    assert len(x) == len(ids)
    whole = sorted(map(tuple, neardup.near_duplicates(df).collect()))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LARGEST_BLOCK", 16)
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == whole
    compare({r[0]: r[1:3] for r in whole}, truth(ids, x.astype(float), 0.95), 0.99, ids)


def test_estimates_are_unbiased_and_bounds_hold():
    x = unit(np.random.default_rng(1).normal(size=(1500, 64)))
    x[750:] = unit(x[:750] + 0.04 * np.random.default_rng(2).normal(size=(750, 64)))
    codes, true = neardup.Codes(x), x @ x.T
    error = codes.estimate(codes.turned) - true
    off = ~np.eye(len(x), dtype=bool)
    assert abs(error[off].mean()) < 2e-3
    assert (np.abs(error) <= codes.error[:, None])[off].all()
    stored = neardup.Codes.unpacked(codes.packed(), 64)
    assert (stored.signs == codes.signs).all() and (stored.factor == codes.factor).all()
    assert (np.abs((stored.turned - codes.turned) @ codes.signs.T) <= stored.rounding[:, None]).all()
    every = np.arange(len(x))
    assert stored.may_reach(every, every, 0.95)[true >= 0.95].all()
    assert stored.may_reach(every, every, 0.95).mean() < 0.1


def test_near_duplicates_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (8, [2.0, 0.0]), (10, [1e-30, 1e-30]), (11, [1e30, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS d", "'x' AS v", "2 AS rep", "array(1) AS keys")
    found = neardup.near_duplicates(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == len(rows)
    assert got[1] == (2, 1, True) and got[8] == (2, 1, False)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    for i in (2, 3, 4, 5, 6, 7, 9):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.01]), (3, [0.01, 1.0]), (3, [1.0, 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (3, 2, 1, False)]
    apart = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(apart).collect()) == [(4, 1, 4), (5, 0, 5), (5, 1, 4)]


def test_op1_on_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    got = {r.vec_id: (r.n_links, r.component_id) for r in catalogue.op1_embedding_neardup(spark, "/root/testdata/sf0.1").collect()}
    compare(got, truth(ids, x, 0.95), 0.98, ids)


def best(q, rows, k):
    scored = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in rows if i != q[0])
    return [(i, -s) for s, i in scored[:k]]


def test_op7_on_a_table(spark):
    rows = [(r.vec_id, [math.floor(256 * float(np.float64(x))) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {}
    for r in catalogue.op7_maxscore(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q[0]: best(q, rows, 5) for q in rows if q[0] % 50 == 0}


def test_top_k_edges(spark):
    rows = [(0, [1.0, -1.0]), (50, [0.5]), (1, [1.0, -1.0]), (2, [1.0, -1.0]), (3, None), (4, [None]), (5, [float("nan"), 0.0]), (6, []), (None, [1.0, 1.0]), (7, [1e30, -1e30]), (100, [-3.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS own", "1L AS id", "2 AS rank", "array(0) AS v")
    out = topk.top_k(df, df.vec_id % 50 == 0, 3, block_rows=3, block_queries=2).collect()
    of = {q: [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100)}
    assert of[0] == [(7, (1 << 63) - 1), (1, 2 * 256**2), (2, 2 * 256**2)]
    assert of[50] == [(7, (1 << 63) - 1), (0, 128 * 256), (1, 128 * 256)]
    assert of[100] == [(0, 0), (1, 0), (2, 0)] and {r.query_id for r in out} == {0, 50, 100}
    assert topk.top_k(df.limit(0), df.vec_id % 50 == 0, 3).count() == 0


def exact_best(rows, queries, k, scale=256):
    """By definition, over (id, vector) rows as floats: (query id, rank, id, score) with scores beyond a long cut there after ranking."""
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows]
    out = []
    for a in queries:
        i, q = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(whole) if b != a)[:k]
        out += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_large_components_are_exact(spark):
    """Beyond 2**24 after scaling, beyond a long, beyond a double's product, beside small and fractional ones."""
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 1.0]), (1, [70000.0, 0.5]), (2, [80000.0, 0.5]), (3, [90000.0, 0.5]), (50, [2.0**40 + 0.25, 3.0]), (4, [1e300, 1e300]), (5, [1e300, 1.1e300]), (6, [-1e308, 1e308]), (7, [1.7e308, 0.0]), (100, [-1.5e308, 2.0])]
    rows += [(200 + i, (rng.normal(size=2) * 10.0 ** rng.integers(-3, 25)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 50 == 0, 5, block_rows=40).collect())
    assert got == exact_best(rows, [a for a, (i, _) in enumerate(rows) if i % 50 == 0], 5)
    assert [r[2] for r in exact_best(rows[:4], [0], 5)] == [3, 2, 1]


def test_repeated_ids_are_queries_and_candidates_of_their_own(spark):
    rows = [(0, [1.0]), (0, [1.0]), (0, [2.0]), (1, [3.0]), (50, [1.0]), (1, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 50 == 0, 3).collect())
    assert got == exact_best(rows, [0, 1, 2, 4], 3)


def test_sparse_postings_on_a_table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ((rng.random(12) < 0.2) * rng.normal(size=12)).tolist()[: rng.integers(0, 13)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 50 == 0, 5, block_rows=700, block_queries=20).collect())
    assert got == exact_best(rows, range(0, 3000, 50), 5)


def test_exact_bytes_sort_like_numbers():
    numbers = [x * s for x in (0, 1, 255, 256, 1 << 63, (1 << 63) - 1, 1 << 700, (1 << 700) + 5) for s in (1, -1)]
    assert sorted(set(numbers), key=topk.ordered_bytes) == sorted(set(numbers))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 40), st.integers(1, 6), st.integers(0, 1 << 30))
def test_maxscore_is_exact(n, d, k, seed):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(-9, 10, (n, d)) * (rng.random((n, d)) < 0.4), rng.permutation(n * 2)[:n]
    q = x[: min(n, 5)]
    found = topk.search(q, ids[: len(q)], topk.Shard(x, ids, ids), k)
    for i in range(len(q)):
        want = best((ids[i], q[i]), list(zip(ids, x)), k)
        assert [(a, b) for a, b in zip(found.ids[i], found.scores[i])][: len(want)] == want


def test_maxscore_leaves_rows_out():
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 6, (20_000, 32)) * (rng.random((20_000, 32)) < 0.1)
    stats = {}
    topk.search(x[:20], np.arange(20), topk.Shard(x, np.arange(len(x)), np.arange(len(x))), 5, stats)
    assert stats["scored"] < 0.25 * 20 * len(x)


@pytest.mark.parametrize("pairs", [False, True])
def test_components(spark, pairs):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(2000 + i, 2001 + i) for i in range(150)] + [(5000, 5000 + i) for i in range(1, 400)] + [(7, 7)] + [(5999, i) for i in range(5400, 5500)]
    uf = UnionFind(6000)
    for a, b in edges:
        uf.union(a, b)
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    if pairs:
        df = df.selectExpr("struct(a DIV 10 AS x, a AS y) AS a", "struct(b DIV 10 AS x, b AS y) AS b").where("a.y IS NOT NULL")
    got = {(r.node.y if pairs else r.node): (r.component_id.y if pairs else r.component_id) for r in components(df).collect()}
    assert got == {n: uf.find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(df.limit(0)).count() == 0
