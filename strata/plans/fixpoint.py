"""Recursion to a fixpoint by semi-naive rounds over DataFrames.

Each round joins only what the last one found (the delta), drops rows that are already there by an anti-join that matches nulls,
and is written, so lineage doesn't grow. The rows found so far are a few sorted-by-size runs of files, of which the newest are
merged when they come near each other in size: each row is rewritten a number of times that grows with the logarithm of the
rounds, and plans stay as small. With lattice-valued columns, the runs hold all values that a key has had; new values are merged with
those of their keys alone, the delta is what changed, and monotone improvement ends on cyclic graphs too.

While all collections of a recursion have few rows of plain types (LOCAL_ROWS, whatever the input), rounds keep them on the driver,
as local relations, and write nothing; beyond that they go to files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import StrataError
from strata.plans.storage import Storage
from strata.schema import Schema

MAX_ROUNDS = 10_000
#: Rows of a recursion that rounds keep on the driver, at most, and types whose values are equal there if and only if Spark's are.
LOCAL_ROWS, LOCAL_TYPES = 5_000, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType, T.BooleanType)


def same_row(columns) -> object:
    return fold(lambda a, b: a & b, (F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in columns))


def added(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of new that old doesn't have."""
    return new.alias("n").join(old.alias("o"), same_row(new.columns), "left_anti")


def improved(schema: Schema, new: DataFrame, versions: DataFrame) -> DataFrame:
    """For the keys of new, the merge of new and earlier lattice values where it differs from what they had. versions: all values so far."""
    own = schema.merged(new)
    names = [*schema.key_cols, *schema.plain_vals]
    if names:
        on = fold(lambda a, b: a & b, (F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in names))
        versions = versions.alias("o").join(own.alias("n"), on, "left_semi")
    stored = schema.merged(versions)
    return added(schema.merged(own.unionByName(stored)), stored)


class Runs:
    """A growing set of rows as runs of files, each more than twice as large as the next."""

    def __init__(self, storage: Storage, name: str, df: DataFrame, n: int) -> None:
        self.storage, self.name, self.runs, self.frame = storage, name, [(df, n)], df

    def add(self, df: DataFrame, n: int) -> None:
        self.runs.append((df, n))
        merged = False
        while len(self.runs) > (1 if merged else 12) and self.runs[-2][1] <= 2 * self.runs[-1][1]:
            (a, m), (b, k) = self.runs[-2:]
            self.runs[-2:] = [(a.unionByName(b), m + k)]
            merged = True
        if merged:
            df, n = self.runs[-1]
            self.runs[-1] = self.storage.counted(df.coalesce(1) if n < 100_000 else df, self.name)  # few rows, few files
        self.frame = fold(lambda a, b: a.unionByName(b), (d for d, _ in self.runs))

    def df(self) -> DataFrame:
        """All rows; the same frame until more are added."""
        return self.frame


class _Made(dict):
    """Frames that are made when a rule first asks for them."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]]) -> None:
        super().__init__()
        self.make = make

    def __contains__(self, name) -> bool:
        return name in self.make

    def __missing__(self, name) -> DataFrame:
        if name not in self.make:
            raise KeyError(name)
        self[name] = self.make[name]()
        return self[name]


def _few(df: DataFrame, limit: int) -> set[tuple] | None:
    """The rows of df as a set, or None where there are more than limit."""
    found = {tuple(r) for r in df.limit(limit + 1).collect()}
    return found if len(found) <= limit else None


def _solve_locally(base, step, schemas, max_rounds, on_round) -> tuple[dict[str, set[tuple]], dict[str, set[tuple]], int, bool]:
    """(rows so far, the last rounds' new ones, rounds, whether that is the fixpoint): as far as it goes with few rows."""
    full: dict[str, set[tuple]] = {}
    frame = lambda n, rows: schemas[n].frame(_session(base), sorted(rows, key=repr))
    for n, df in base.items():
        if (found := _few(df.distinct(), LOCAL_ROWS)) is None:
            return {}, {}, 0, False
        full[n] = found
    delta = {n: set(rows) for n, rows in full.items()}
    for k in range(max_rounds):
        live = {n: frame(n, rows) for n, rows in delta.items() if rows}
        if not live:
            return full, {}, k, True
        if on_round:
            on_round(k)
        known = _Made({n: (lambda n=n, rows=frozenset(rows): frame(n, rows)) for n, rows in full.items()})
        new: dict[str, set[tuple]] = {}
        for n, terms in step(known, live).items():
            if terms:
                found = _few(fold(lambda a, b: a.unionByName(b), (schemas[n].align(t) for t in terms)), LOCAL_ROWS)
                if found is None:
                    return full, delta, k, False
                new[n] = found - full[n]
        if sum(map(len, full.values())) + sum(map(len, new.values())) > LOCAL_ROWS:
            return full, delta, k, False
        for n, rows in new.items():
            full[n] |= rows
        delta = new
    raise StrataError(f"no fixpoint in {max_rounds} rounds")


def _session(base: dict[str, DataFrame]):
    return next(iter(base.values())).sparkSession


def solve(
    base: dict[str, DataFrame],
    step: Callable[[dict[str, DataFrame], dict[str, DataFrame]], dict[str, list[DataFrame]]],
    schemas: dict[str, Schema],
    storage: Storage,
    max_rounds: int = MAX_ROUNDS,
    on_round: Callable[[int], None] | None = None,
    grown: dict[str, Runs] | None = None,
) -> dict[str, DataFrame]:
    """The least fixpoint of mutually recursive collections. grown: gets the runs of those without lattices.

    step(full, delta) gives, for each collection, what follows from delta (with everything else taken from full)."""
    full, delta, first = {}, {}, 0
    if all(not schemas[n].lattices and all(isinstance(f.dataType, LOCAL_TYPES) for f in schemas[n].fields) for n in base):
        rows, last, first, done = _solve_locally(base, step, schemas, max_rounds, on_round)
        if rows:
            # What was found so far goes to files; a round that had too many rows for the driver is done again from them.
            local = {n: storage.counted(schemas[n].frame(storage.spark, sorted(r, key=repr)), n) for n, r in rows.items()}
            full = {n: Runs(storage, n, *x) for n, x in local.items()}
            delta = {n: (schemas[n].frame(storage.spark, sorted(r, key=repr)), len(r)) for n, r in last.items()}
            if done:
                if grown is not None:
                    grown.update(full)
                return {n: r.df() for n, r in full.items()}
    if not full:
        for n, df in base.items():
            delta[n] = storage.counted(schemas[n].merged(df), n)
            full[n] = Runs(storage, n, *delta[n])
    for k in range(first, max_rounds):
        live = {n: df for n, (df, rows) in delta.items() if rows}
        if not live:
            if grown is not None:
                grown.update({n: r for n, r in full.items() if not schemas[n].lattices})
            return {n: storage.write(schemas[n].merged(r.df()), n) if schemas[n].lattices and len(r.runs) > 1 else r.df() for n, r in full.items()}
        if on_round:
            on_round(k)
        known = _Made({n: (lambda n=n, df=r.df(): schemas[n].merged(df) if schemas[n].lattices else df) for n, r in full.items()})
        delta = {}
        for n, terms in step(known, live).items():
            if not terms:
                continue
            new = fold(lambda a, b: a.unionByName(b), (schemas[n].align(t) for t in terms))
            delta[n] = storage.counted(improved(schemas[n], new, full[n].df()) if schemas[n].lattices else added(new.distinct(), full[n].df()), n)
        for n, (d, rows) in delta.items():
            if rows:
                full[n].add(d, rows)
    raise StrataError(f"no fixpoint in {max_rounds} rounds")


def closure(base: DataFrame, step: Callable[[DataFrame], DataFrame], storage: Storage, schema: Schema | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One collection with linear recursion: step(delta) gives what follows from the last round's rows."""
    schema = schema or Schema(tuple(base.schema.fields))
    return solve({"x": base}, lambda full, delta: {"x": [step(delta["x"])]}, {"x": schema}, storage, max_rounds)["x"]
