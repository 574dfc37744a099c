"""Connected components of a graph that no single task or driver holds.

Edges are contracted by alternating large-star and small-star steps (Kiveris et al., 2014): each step is two aggregations
and two joins on node ids, and each round is written to the shared folder, so lineage stays short and lost executors repeat
one round at most. Rounds end when every component is a star around its least node: a number of rounds that grows with the
logarithm of the longest path, not with the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._common import stored

#: Tasks over which the edges of one node are dealt.
SALTS = 32


def with_least(rows: DataFrame, node: str, to: str, also_self: bool) -> DataFrame:
    """rows (node, to) with m, the least `to` of each node (also_self: or the node itself).

    A hub's rows are dealt by (node, salt), so they meet in SALTS tasks; what meets by node alone has SALTS rows of it at most."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(to), F.lit(SALTS)).cast("int"))
    each = salted.groupBy(node, "salt").agg(F.min(to).alias("low"))
    least = F.min("low").over(Window.partitionBy(node))
    return salted.join(each.select(node, "salt", (F.least(node, least) if also_self else least).alias("m")), [node, "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """(node, to), node > to, of each node's larger neighbours to its least neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return with_least(both, "u", "v", True).where("v > u AND v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(node, to) of each node's smaller neighbours, and of itself, to the least of them."""
    found = with_least(edges, "a", "b", False)
    moved = found.select(F.explode(F.array("a", "b")).alias("x"), "m").where("x > m")
    return moved.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component_id (the least node that it reaches) for each node of edges (a, b); loops and nulls count for nothing.
    Nodes are of any type that can be ordered."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    measure = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        mark = tuple(now.agg(*measure).first())
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component_id"))).distinct()


class UnionFind:
    """Over 0 .. n - 1, within one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def forest(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Joins all pairs; returns those that joined what was apart. Each pass takes one pair of each i, so dense pairs go fast."""
        out = []
        while len(i):
            first = np.unique(i, return_index=True)[1]
            for a, b in zip(i[first].tolist(), j[first].tolist()):
                if self.union(a, b):
                    out.append((a, b))
            labels = np.array([self.find(x) for x in range(len(self.parent))])
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
        return out
