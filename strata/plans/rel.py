"""Relational expressions of rules: trees that know which collections they read, and how, and build DataFrames on demand."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import CompileError
from strata.functions import aggs as A
from strata.operators import relational as O

Env = Callable[["Scan"], DataFrame]


class Rel:
    """build(env) gives the DataFrame; reads: each scan in it, and whether the result may shrink as the scan grows."""

    def __init__(self, build: Callable[[Env], DataFrame], reads: Sequence[tuple[Scan, bool]], key_cols: Sequence[str] | None = None, name: str | None = None) -> None:
        self._build, self.reads, self._keys, self.alias = build, tuple(reads), key_cols, name

    def build(self, env: Env) -> DataFrame:
        return self._build(env)

    def scans(self) -> tuple[tuple[Scan, bool], ...]:
        return self.reads

    def _unary(self, f: Callable[[DataFrame], DataFrame], nm: bool = False, key_cols=None) -> Rel:
        return Rel(lambda env: f(self.build(env)), [(s, n or nm) for s, n in self.scans()], key_cols)

    def _binary(self, other: Rel, f: Callable[[DataFrame, DataFrame], DataFrame], nm_left: bool = False, nm_right: bool = False) -> Rel:
        reads = [(s, n or nm_left) for s, n in self.scans()] + [(s, n or nm_right) for s, n in other.scans()]
        return Rel(lambda env: f(self.build(env), other.build(env)), reads)

    def apply(self, f: Callable[[DataFrame], DataFrame], monotone: bool = False) -> Rel:
        """Any function of DataFrames; it counts as non-monotone unless said otherwise."""
        return self._unary(f, not monotone)

    # projection and filter
    def select(self, *exprs, where: Column | None = None) -> Rel:
        return self._unary(lambda d: O.project(d, *exprs, where=where))

    pro = map = each = select

    def where(self, pred: Column) -> Rel:
        return self._unary(lambda d: d.where(pred), key_cols=self._keys)

    def reject(self, pred: Column) -> Rel:
        """Rows for which pred doesn't hold."""
        return self.where(~F.coalesce(pred, F.lit(False)))

    def uniq(self) -> Rel:
        return self._unary(lambda d: d.distinct(), key_cols=self._keys)

    def first(self, n: int = 1, *order) -> Rel:
        """The n first rows in an order, of all columns if none is given."""
        return self._unary(lambda d: O.top_k(d, n, *(order or d.columns)), True, self._keys)

    def on_include(self, pred: Column) -> Rel:
        return self.where(pred)

    def on_exists(self) -> Rel:
        return self

    def flat_map(self, items: Column, *exprs, name: str = "item") -> Rel:
        return self._unary(lambda d: O.flat_map(d, items, *exprs, name=name))

    def _key_cols(self) -> Sequence[str]:
        if self._keys is None:
            raise CompileError("this expression has no key: give it one with rename()")
        return self._keys

    def keys(self) -> Rel:
        k = self._key_cols()
        return self._unary(lambda d: O.keys(d, k), key_cols=k)

    def values(self) -> Rel:
        k = self._key_cols()
        return self._unary(lambda d: O.values(d, k))

    def inspected(self) -> Rel:
        return self._unary(O.inspected)

    def rename(self, name: str, *cols: str, n_keys: int | None = None) -> Rel:
        out = self._unary(lambda d: d.toDF(*cols) if cols else d, key_cols=cols[:n_keys] if cols else self._keys)
        out.alias = name
        return out

    # products
    def __mul__(self, other: Rel) -> Product:
        return Product([self]) * other

    # other collections
    def notin(self, other: Rel, preds=None, theta: Column | None = None) -> Rel:
        return self._binary(other, lambda a, b: O.notin(a, b, preds, theta), nm_right=True)

    def exists(self, other: Rel, theta: Column | None = None) -> Rel:
        return self._binary(other, lambda a, b: O.exists(a, b, theta), nm_right=True)

    def include(self, other: Rel, preds) -> Rel:
        """Rows for which other has an equal row on preds; has_key with preds on its key."""
        return self._binary(other, lambda a, b: O.lefts(a, b, preds), nm_right=True)

    has_key = include

    def if_empty(self, other: Rel) -> Rel:
        return self._binary(other, O.empty, nm_right=True)

    def if_any(self, other: Rel) -> Rel:
        """All rows where other has any, else none."""
        return self.exists(other)

    def with_length(self, other: Rel, name: str = "length") -> Rel:
        return self._binary(other, lambda a, b: O.with_length(a, b, name), nm_right=True)

    def lookup(self, other: Rel, preds, *exprs) -> Rel:
        return self._binary(other, lambda a, b: O.lookup(a, b, preds, *exprs), nm_right=True)

    def with_cell(self, cell: Rel, name: str, monotone: bool = False) -> Rel:
        """Rows with the value of an lmax, lmin or lbool as one more column."""
        return self._binary(cell, lambda a, b: a.crossJoin(F.broadcast(b.select(F.col("v").alias(name)))), nm_right=not monotone)  # one row

    def scalar(self, kind: str, pred: Column | None = None) -> Rel:
        return self._unary(lambda d: O.scalar(d, kind, pred), True)

    # aggregation and order
    def group(self, keys, *aggs: A.Agg, **named: A.Agg) -> Rel:
        f = (lambda d: O.group_as(d, keys, **named)) if named else (lambda d: O.group(d, keys, *aggs))
        return self._unary(f, True, list(keys or []))

    def argagg(self, agg: str, keys, column: str) -> Rel:
        return self._unary(lambda d: O.argagg(d, agg, keys, column), True, self._keys)

    def argmin(self, keys, column: str) -> Rel:
        return self.argagg("min", keys, column)

    def argmax(self, keys, column: str) -> Rel:
        return self.argagg("max", keys, column)

    def reduce(self, init, step, merge, schema: str) -> Rel:
        return self._unary(lambda d: O.reduce(d, init, step, merge, schema), True)

    inject = reduce

    def group_fold(self, keys, column: str, agg: A.HostAgg, name: str, type_: str) -> Rel:
        return self._unary(lambda d: O.group_fold(d, keys, column, agg, name, type_), True, list(keys or []))

    def arg_fold(self, keys, column: str, agg: A.HostAgg) -> Rel:
        return self._unary(lambda d: O.arg_fold(d, keys, column, agg), True, self._keys)

    def sort(self, *order) -> Rel:
        out = self._unary(lambda d: d, True, self._keys)
        out.order = order
        return out

    def each_with_index(self, name: str = "i") -> Rel:
        """Rows with their place in the order of a sort() before it, or of all columns; numbered by ranges, of which tasks hold one."""
        order = getattr(self, "order", ())
        return Rel(lambda env: O.with_index(self.build(env), *order, name=name, materialise=getattr(env, "write", None)), [(s, True) for s, _ in self.scans()])

    # lattice functions: of cells, whose relation has the value in column v (lmax, lmin, lbool), or is keyed by element or key
    def gt(self, n) -> Rel:
        return self.select((F.col("v") > n).alias("v"))

    def gt_eq(self, n) -> Rel:
        return self.select((F.col("v") >= n).alias("v"))

    def lt(self, n) -> Rel:
        return self.select((F.col("v") < n).alias("v"))

    def lt_eq(self, n) -> Rel:
        return self._unary(lambda d: d.select((F.col("v") <= n).alias("v")), True)

    def plus(self, n) -> Rel:
        """Adds a number to an lmax or lmin, or the multiplicities of another bag."""
        if isinstance(n, Rel):
            return self._binary(n, lambda a, b: a.unionByName(b).groupBy(a.columns[0]).agg(F.sum("v").alias("v")))
        return self.select((F.col("v") + n).alias("v"))

    def min_of(self, n) -> Rel:
        return self.select(F.least(F.col("v"), F.lit(n)).alias("v"))

    def when_true(self, then: Rel | None = None) -> Rel:
        """then's rows (or one row) if the lbool is true."""
        if then is None:
            return self.where(F.col("v")).select(F.lit(True).alias("v"))
        return self._binary(then, lambda a, b: b.crossJoin(F.broadcast(a.where("v").limit(1).select(F.lit(1).alias("_t")))).drop("_t"))  # one row

    def size(self) -> Rel:
        """Elements of a set, keys of a map, or all multiplicities of a bag."""
        bag = getattr(self, "kind", "") == "lbag"
        return self._unary(lambda d: d.agg(F.coalesce(F.sum("v") if bag else F.count(F.lit(1)), F.lit(0)).cast("long").alias("v")))

    def pos_sum(self) -> Rel:
        return self._unary(lambda d: d.agg(F.coalesce(F.sum_distinct(F.col(d.columns[0])), F.lit(0)).alias("v")))

    def contains(self, x) -> Rel:
        return self._unary(lambda d: d.agg(F.coalesce(F.bool_or(F.col(d.columns[0]) == F.lit(x)), F.lit(False)).alias("v")))

    def multiplicity(self, x) -> Rel:
        return self._unary(lambda d: d.agg(F.coalesce(F.max(F.when(F.col(d.columns[0]) == F.lit(x), F.col("v"))), F.lit(0)).alias("v")))

    def group_count(self, *cols: str) -> Rel:
        return self._unary(lambda d: d.groupBy(*cols).agg(F.count(F.lit(1)).alias("v")))

    def intersect(self, other: Rel) -> Rel:
        """Common elements; of bags with the smaller multiplicity, of maps with merged values."""
        kind, lattice = getattr(self, "kind", "lset"), getattr(self, "value_lattice", None)

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            if kind in ("lset", "lpset"):
                return a.intersect(b)
            k = a.columns[0]
            value = F.least(O.L["v"], O.R["v"]) if kind == "lbag" else lattice.merge(O.L["v"], O.R["v"])
            return O.pairs(a, b, {k: k}, O.L[k].alias(k), value.alias("v"))

        return self._binary(other, both)

    def merge(self, other: Rel) -> Rel:
        """The least upper bound of two cells of one kind."""
        schema = self.schema
        return self._binary(other, lambda a, b: schema.merged(schema.align(a).unionByName(schema.align(b))))

    def eqjoin(self, other: Rel, preds=None, *exprs) -> Rel:
        return self._binary(other, lambda a, b: O.pairs(a, b, preds, *exprs) if preds else O.combos([a, b], None, *exprs))

    def at(self, key, bottom=None) -> Rel:
        """A map's value at a key; bottom if there is none, or no row without one."""
        if bottom is None:
            return self._unary(lambda d: d.where(F.col(d.columns[0]) == F.lit(key)).select("v"))
        return self._unary(lambda d: d.agg(F.coalesce(F.max(F.when(F.col(d.columns[0]) == F.lit(key), F.col("v"))), F.lit(bottom)).alias("v")))

    def filter_true(self) -> Rel:
        return self.where(F.col("v"))

    def apply_values(self, f: Callable[[Column], Column], morph: bool = True) -> Rel:
        return self._unary(lambda d: d.select(d.columns[0], f(F.col("v")).alias("v")), not morph)

    def key_set(self) -> Rel:
        return self._unary(lambda d: d.select(d.columns[0]).distinct())

    def has_map_key(self, key) -> Rel:
        return self.contains(key)


def either(condition: Rel, then: Rel, otherwise: Rel) -> Rel:
    """then's rows where the condition has any row, else those of otherwise, by position."""
    yes, no = then.if_any(condition), otherwise.if_empty(condition)
    return yes._binary(no, lambda a, b: a.union(b))


class Scan(Rel):
    """The rows of a named collection; each use in a rule is a scan of its own."""

    def __init__(self, name: str, key_cols: Sequence[str] | None = None) -> None:
        super().__init__(lambda env: env(self), (), key_cols, name)
        self.name = name

    def scans(self):
        return ((self, False),)


class Literal(Rel):
    def __init__(self, make: Callable[[], DataFrame]) -> None:
        super().__init__(lambda env: make(), ())


class Product:
    """Inputs of a join that waits for its predicates."""

    #: Instances of one collection that a strict rule may join.
    strict_limit: int | None = None

    def __init__(self, inputs: list[Rel]) -> None:
        self.inputs = inputs
        names = [r.alias for r in inputs if r.alias]
        if self.strict_limit and max(map(names.count, names), default=0) > self.strict_limit:
            raise CompileError(f"a collection is joined more than {self.strict_limit} times in one rule; rename() it")

    def __mul__(self, other: Rel) -> Product:
        return type(self)([*self.inputs, other])

    def _preds(self, preds):
        def place(x):
            if isinstance(x, ColumnRef):
                at = [i for i, r in enumerate(self.inputs) if r.alias == x.collection]
                if len(at) != 1:
                    raise CompileError(f"{x.collection}.{x.column} is {'not joined' if not at else 'ambiguous'} here")
                return (at[0], x.column)
            return x

        pairs_ = preds.items() if isinstance(preds, dict) else preds or []
        return [tuple(place(x) for x in p) for p in pairs_]

    def _join(self, f: Callable[[list[DataFrame]], DataFrame], nm: bool = False) -> Rel:
        inputs = self.inputs
        return Rel(lambda env: f([r.build(env) for r in inputs]), [(s, n or nm) for r in inputs for s, n in r.scans()])

    def combos(self, preds=None, *exprs, theta: Column | None = None) -> Rel:
        p = self._preds(preds)
        return self._join(lambda d: O.combos(d, p, *exprs, theta=theta))

    pairs = combos

    def matches(self, *exprs) -> Rel:
        return self._join(lambda d: O.matches(d, *exprs))

    def lefts(self, preds=None, *exprs, theta: Column | None = None) -> Rel:
        p = self._preds(preds)
        return self._join(lambda d: O.lefts(d[0], d[1], p, *exprs, theta=theta))

    def rights(self, preds=None, *exprs, theta: Column | None = None) -> Rel:
        p = self._preds(preds)
        return self._join(lambda d: O.rights(d[0], d[1], p, *exprs, theta=theta))

    def outer(self, preds=None, *exprs) -> Rel:
        if len(self.inputs) != 2:
            raise CompileError("an outer join has two inputs")
        p = self._preds(preds)
        return self._join(lambda d: O.outer(d[0], d[1], p, *exprs), True)

    def flatten(self, preds=None) -> Rel:
        p = self._preds(preds)
        return self._join(lambda d: O.flatten(d, p))


class ColumnRef:
    """A column of a named collection, for predicates that say which input they mean."""

    def __init__(self, collection: str, column: str) -> None:
        self.collection, self.column = collection, column
