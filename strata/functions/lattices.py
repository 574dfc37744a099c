"""Join-semilattices as columns: each has a bottom, a merge of two columns and a merge of a group.

A lattice cell of a program is a keyed relation: lmax, lmin and lbool have no key and one value; lset and lpset are keyed by the
element; lbag by the element with its multiplicity; lmap by its key with a lattice value. So merging is aggregation, equal for
cells and for lattice-valued columns of tables, and Spark combines it before the shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    """merge(a, b) is associative, commutative and idempotent; agg(c) merges a group. Null is bottom."""

    name: str
    merge: Callable[[Column, Column], Column]
    agg: Callable[[Column], Column]
    bottom: object = None
    #: Functions that distribute over merge, and monotone ones that need the whole value.
    morphs: frozenset[str] = frozenset()
    monotones: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if both := self.morphs & self.monotones:
            raise TypeError(f"both morph and monotone: {sorted(both)}")


lmax = Lattice("lmax", lambda a, b: F.greatest(a, b), F.max, None, frozenset({"gt", "gt_eq", "plus", "min_of"}))
lmin = Lattice("lmin", lambda a, b: F.least(a, b), F.min, None, frozenset({"lt", "plus"}))
lbool = Lattice("lbool", lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), F.bool_or, False, frozenset({"when_true"}))
#: Sets in a column: sorted arrays without repeats.
lset = Lattice("lset", lambda a, b: F.array_sort(F.array_union(a, b)), lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), (), frozenset({"intersect", "contains", "pro", "eqjoin"}), frozenset({"size", "group_count"}))
lpset = Lattice("lpset", lset.merge, lset.agg, (), lset.morphs, frozenset({"size", "group_count", "pos_sum"}))


def _bag_agg(c: Column) -> Column:
    entries = F.flatten(F.collect_list(F.map_entries(c)))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]))))


#: Bags in a column: maps from element to multiplicity; merge takes the larger multiplicity.
lbag = Lattice("lbag", lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y)), _bag_agg, {}, frozenset({"intersect", "multiplicity", "contains", "plus"}), frozenset({"size"}))


def lmap(value: Lattice) -> Lattice:
    """Maps in a column whose values are of another lattice."""

    def agg(c: Column) -> Column:
        def merge(acc: Column, entry: Column) -> Column:
            return F.map_zip_with(acc, entry, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(value.merge(x, y)))

        maps = F.collect_list(c)
        return F.aggregate(F.slice(maps, 2, F.greatest(F.size(maps) - 1, F.lit(0))), maps[0], merge)

    def both(a: Column, b: Column) -> Column:
        return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(value.merge(x, y)))

    return Lattice(f"lmap<{value.name}>", both, agg, {}, frozenset({"at", "filter", "apply_morph", "key", "key_set", "intersect"}), frozenset({"apply", "size"}))


def custom(name: str, merge: Callable[[Column, Column], Column], agg: Callable[[Column], Column] | None = None, bottom: object = None, morphs=(), monotones=()) -> Lattice:
    """A lattice of one's own. Without agg, a group is folded with merge in sorted order."""

    def fold(c: Column) -> Column:
        values = F.array_sort(F.collect_list(c))
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], merge)

    return Lattice(name, merge, agg or fold, bottom, frozenset(morphs), frozenset(monotones))


BY_NAME = {x.name: x for x in (lmax, lmin, lbool, lset, lpset, lbag)}
