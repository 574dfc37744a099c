"""Aggregates of group() and arg-aggregates.

Exemplary aggregates (min, max, bool_and, bool_or, choose, choose_rand) pick one of their inputs, so repeated rows don't matter;
before any other, repeated input rows are dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    name: str
    column: Column
    exemplary: bool = False

    def named(self, name: str) -> Agg:
        return Agg(name, self.column, self.exemplary)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def min_(x) -> Agg:
    return Agg("min", F.min(_c(x)), True)


def max_(x) -> Agg:
    return Agg("max", F.max(_c(x)), True)


def bool_and(x) -> Agg:
    return Agg("booleanand", F.bool_and(_c(x)), True)


def bool_or(x) -> Agg:
    return Agg("booleanor", F.bool_or(_c(x)), True)


def choose(x) -> Agg:
    """One value of the group that isn't null: the least, so that results don't change from run to run."""
    return Agg("choose", F.min(_c(x)), True)


def choose_rand(x, seed: int = 0) -> Agg:
    """A value picked by a seeded hash: as good as random, and the same in every run and retry."""
    return Agg("chooserand", F.max_by(_c(x), F.xxhash64(_c(x), F.lit(seed))), True)


def sum_(x) -> Agg:
    return Agg("sum", F.sum(_c(x)))


def count(x=None) -> Agg:
    """Rows of the group; the argument doesn't matter."""
    return Agg("count", F.count(F.lit(1)))


def avg(x) -> Agg:
    return Agg("avg", F.avg(_c(x).cast("double")))


def accum(x) -> Agg:
    """The sorted set of values, null among them."""
    return Agg("accum", F.transform(F.array_sort(F.collect_set(F.struct(_c(x).alias("x")))), lambda s: s["x"]))


def accum_pair(x, y) -> Agg:
    return Agg("accumpair", F.array_sort(F.collect_set(F.struct(_c(x).alias("x"), _c(y).alias("y")))))


def custom(name: str, column: Column, exemplary: bool = False) -> Agg:
    """An aggregate of one's own: any aggregating column, a grouped-aggregate pandas UDF among them."""
    return Agg(name, column, exemplary)


def folded(name: str, zero: Column, step: Callable[[Column, Column], Column], x, final: Callable[[Column], Column] | None = None, exemplary: bool = False) -> Agg:
    """init / trans / final as columns, over the group's values in sorted order, which one task holds: for groups of bounded size.
    Others are for group_fold() with a HostAgg, whose states merge."""
    values = F.array_sort(F.collect_list(_c(x)))
    return Agg(name, F.aggregate(values, zero, step, final) if final else F.aggregate(values, zero, step), exemplary)


IGNORE, KEEP, REPLACE, DELETE = "ignore", "keep", "replace", "delete"


class HostAgg:
    """An aggregate in the host language, for group_fold() and arg_fold(); any method may be overridden.

    trans() gives the new state and what is to become of the input in an arg-aggregate: IGNORE, KEEP (beside those kept), REPLACE (them),
    or (DELETE, values) (keep it, and drop kept rows of these values). merge() joins the states of two parts of a group."""

    def init(self, value):
        return value

    def trans(self, state, value):
        return state, IGNORE

    def merge(self, a, b):
        return self.trans(a, b)[0]

    def final(self, state):
        return state


BY_NAME: dict[str, Callable] = {"min": min_, "max": max_, "bool_and": bool_and, "bool_or": bool_or, "choose": choose, "choose_rand": choose_rand, "sum": sum_, "count": count, "avg": avg, "accum": accum}
