"""Relational operators over DataFrames, with the engine's set semantics.

All are compositions of DataFrame operations, so Catalyst pushes filters, prunes columns and picks joins. Null matches null in
joins, anti-joins and groups. Expressions over the inputs of a join name them by position: L["x"], R["y"] or S(i)["x"]."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.errors import CompileError, TypeMismatchError
from strata.functions import aggs as A
from strata.functions.scalars import inspect


class Side:
    """The columns of a join's input."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_{self.place}.`{name}`")

    def star(self) -> Column:
        return F.col(f"_{self.place}.*")


def S(place: int) -> Side:
    return Side(place)


L, R = Side(0), Side(1)
Ref = "str | tuple[int, str]"


def conj(parts: Iterable[Column]) -> Column | None:
    parts = list(parts)
    return fold(lambda a, b: a & b, parts) if parts else None


def exprs_of(df: DataFrame, exprs: Sequence) -> list[Column]:
    return [F.col(e) if isinstance(e, str) else e for e in exprs]


# --- projection and filter -------------------------------------------------------------------------------------------


def project(df: DataFrame, *exprs, where: Column | None = None) -> DataFrame:
    """Rows for which `where` holds, mapped."""
    df = df if where is None else df.where(where)
    return df.select(*exprs_of(df, exprs)) if exprs else df


#: Other names of the same operator.
pro = map_ = each = project


def flat_map(df: DataFrame, items: Column, *exprs, name: str = "item", index: str | None = None) -> DataFrame:
    """A row for each item of an array column; exprs see the row's columns, the item and, if named, its index."""
    row = df.select("*", F.posexplode(items).alias(index or "_index", name))
    return row.select(*exprs) if exprs else (row if index else row.drop("_index"))


def keys(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    return df.select(*key_cols).distinct()


def values(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in key_cols]).distinct()


def inspected(df: DataFrame, name: str = "line") -> DataFrame:
    """One string column with each row's printed form."""
    shown = [inspect(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return df.select(F.concat(F.lit("["), F.concat_ws(", ", *shown), F.lit("]")).alias(name))


def rename(df: DataFrame, *cols: str) -> DataFrame:
    return df.toDF(*cols)


def null_tuple(df: DataFrame) -> DataFrame:
    """One row of nulls with df's columns."""
    return df.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))


# --- joins -----------------------------------------------------------------------------------------------------------


def _resolve(ref, dfs: Sequence[DataFrame], default: int) -> tuple[int, str]:
    if isinstance(ref, tuple):
        place, name = ref
    elif isinstance(ref, str):
        place, name = default, ref
    else:
        raise CompileError(f"not a column reference: {ref!r}")
    if not 0 <= place < len(dfs) or name not in dfs[place].columns:
        raise CompileError(f"input {place} has no column {name}")
    return place, name


def equalities(dfs: Sequence[DataFrame], preds) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """Pairs of (input, column) that must be equal.

    preds: a dict or list of pairs; strings name the left and the right input where there are two, (place, name) any; or lists
    of equivalence classes with more than two members. Styles can't be mixed."""
    pairs: list = []
    for p in preds.items() if isinstance(preds, dict) else preds or []:
        if not isinstance(p, (tuple, list)):
            raise CompileError(f"not a join predicate: {p!r}")
        pairs += [(a, b) for a, b in zip(p, p[1:])] if len(p) > 2 else [tuple(p)]
    kinds = {isinstance(x, tuple) for p in pairs for x in p}
    if len(kinds) > 1:
        raise CompileError("qualified and plain references are mixed")
    if kinds == {False} and len(dfs) > 2:
        out = []
        for a, b in pairs:
            found = [[i for i, d in enumerate(dfs) if x in d.columns] for x in (a, b)]
            if any(len(f) != 1 for f in found):
                raise CompileError(f"{a} => {b} is ambiguous or missing among {len(dfs)} inputs")
            out.append(((found[0][0], a), (found[1][0], b)))
        return out
    out = [(_resolve(a, dfs, 0), _resolve(b, dfs, 1)) for a, b in pairs]
    if any(a[0] == b[0] for a, b in out):
        raise CompileError("a join predicate names one input alone")
    return out


def combos(dfs: Sequence[DataFrame], preds, *exprs, how: str = "inner", theta: Column | None = None, strict: bool = False) -> DataFrame:
    """n-way join. Each predicate joins the chain as soon as both its inputs are there, so Catalyst sees equi-joins only.

    Without exprs: one struct column for each input. theta: a further condition over all inputs."""
    pairs = equalities(dfs, preds)
    if strict and preds and {x[0] for p in pairs for x in p} != set(range(len(dfs))):
        raise CompileError("an input takes part in no predicate")
    if how == "left" and len(dfs) != 2:
        raise CompileError("an outer join has two inputs")
    out = dfs[0].alias("_0")
    for i in range(1, len(dfs)):
        own = [S(a[0])[a[1]].eqNullSafe(S(b[0])[b[1]]) for a, b in pairs if max(a[0], b[0]) == i]
        last = [theta] if theta is not None and i == len(dfs) - 1 else []
        on = conj(own + last)
        out = out.crossJoin(dfs[i].alias(f"_{i}")) if on is None else out.join(dfs[i].alias(f"_{i}"), on, how)
    if exprs:
        return out.select(*exprs)
    structs = [F.struct(*(S(i)[c].alias(c) for c in d.columns)) for i, d in enumerate(dfs)]
    if how == "left":  # an unmatched right row is null, not a struct of nulls
        structs[1] = F.when(conj(S(1)[c].isNull() for c in dfs[1].columns), F.lit(None)).otherwise(structs[1])
    return out.select(*(s.alias(f"t{i}") for i, s in enumerate(structs)))


def pairs(left: DataFrame, right: DataFrame, preds, *exprs, theta: Column | None = None) -> DataFrame:
    return combos([left, right], preds, *exprs, theta=theta)


def natural_preds(dfs: Sequence[DataFrame]) -> list:
    """Equality on every column name that two inputs share, over all pairs of inputs."""
    return [((i, c), (j, c)) for i in range(len(dfs)) for j in range(i + 1, len(dfs)) for c in dfs[i].columns if c in dfs[j].columns]


def matches(dfs: Sequence[DataFrame], *exprs) -> DataFrame:
    return combos(dfs, natural_preds(dfs), *exprs)


def lefts(left: DataFrame, right: DataFrame, preds, *exprs, theta: Column | None = None) -> DataFrame:
    """Left rows with a match, once each."""
    on = conj([L[a[1]].eqNullSafe(R[b[1]]) for a, b in equalities([left, right], preds)] + ([theta] if theta is not None else []))
    out = left.alias("_0").join(right.alias("_1"), on if on is not None else F.lit(True), "left_semi")
    return out.select(*exprs) if exprs else out


def rights(left: DataFrame, right: DataFrame, preds, *exprs, theta: Column | None = None) -> DataFrame:
    on = conj([L[a[1]].eqNullSafe(R[b[1]]) for a, b in equalities([left, right], preds)] + ([theta] if theta is not None else []))
    out = right.alias("_1").join(left.alias("_0"), on if on is not None else F.lit(True), "left_semi")
    return out.select(*exprs) if exprs else out


def outer(left: DataFrame, right: DataFrame, preds, *exprs) -> DataFrame:
    """Left outer join: unmatched left rows meet a row of nulls."""
    return combos([left, right], preds, *exprs, how="left")


def flatten(dfs: Sequence[DataFrame], preds=None) -> DataFrame:
    """All columns side by side; a name that came before gets _1, _2, ..."""
    names, out = set(), []
    for i, d in enumerate(dfs):
        for c in d.columns:
            name, k = c, 0
            while name in names:
                k += 1
                name = f"{c}_{k}"
            names.add(name)
            out.append(S(i)[c].alias(name))
    return combos(dfs, preds, *out)


def notin(left: DataFrame, right: DataFrame, preds=None, theta: Column | None = None) -> DataFrame:
    """Left rows without a match: equal on preds and theta true. With neither: without an equal row, by position."""
    if not preds and theta is None:
        if len(left.columns) != len(right.columns):
            return left
        both = [L[a].eqNullSafe(R[b]) for a, b in zip(left.columns, right.columns)]
    else:
        both = [L[a[1]].eqNullSafe(R[b[1]]) for a, b in equalities([left, right], preds)] + ([theta] if theta is not None else [])
    return left.alias("_0").join(right.alias("_1"), conj(both), "left_anti")


def exists(left: DataFrame, right: DataFrame, theta: Column | None = None) -> DataFrame:
    """Left rows for which some right row satisfies theta; without theta, all of them if right has a row."""
    if theta is None:
        return left.crossJoin(F.broadcast(right.limit(1).select(F.lit(1).alias("_one")))).drop("_one")  # one row at most
    return left.alias("_0").join(right.alias("_1"), theta, "left_semi")


def empty(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows if right has none."""
    flag = right.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty"))
    return left.crossJoin(F.broadcast(flag)).where("_empty").drop("_empty")  # one row


def lookup(left: DataFrame, right: DataFrame, preds, *exprs) -> DataFrame:
    """The row of right with a key, or nulls: a left join on a unique key."""
    return outer(left, right, preds, *exprs)


def with_length(left: DataFrame, right: DataFrame, name: str = "length") -> DataFrame:
    return left.crossJoin(F.broadcast(right.agg(F.count(F.lit(1)).alias(name))))  # one row


# --- aggregation -----------------------------------------------------------------------------------------------------


def group(df: DataFrame, keys: Sequence | None, *aggs: A.Agg, is_set: bool = False) -> DataFrame:
    """Keys and aggregates. No keys: one group, and no row for empty input. Repeated input rows are dropped before any
    aggregate that isn't exemplary; is_set says that there are none."""
    keys = list(keys or [])
    if not aggs:
        return df.select(*keys).distinct()
    if not is_set and not all(a.exemplary for a in aggs):
        df = df.distinct()
    named = [a.column.alias(f"{a.name}_{i}") for i, a in enumerate(aggs)]
    if keys:
        return df.groupBy(*keys).agg(*named)
    return df.groupBy(F.lit(1).alias("_one")).agg(*named).drop("_one")


def group_as(df: DataFrame, keys: Sequence | None, is_set: bool = False, **aggs: A.Agg) -> DataFrame:
    """group() with names for its aggregates."""
    out = group(df, keys, *aggs.values(), is_set=is_set)
    return out.toDF(*out.columns[: len(out.columns) - len(aggs)], *aggs)


def argagg(df: DataFrame, agg: str, keys: Sequence[str] | None, column: str, seed: int = 0) -> DataFrame:
    """Rows that reach the aggregate of their group. min and max keep ties; the others pick one row.

    The aggregate is combined before its shuffle and met again by a join, so no task holds a whole group."""
    keys, all_ = list(keys or []), F.struct(*df.columns)
    one = [] if keys else [F.lit(1).alias("_one")]
    if agg in ("min", "max"):
        best = df.groupBy(*keys, *one).agg(A.BY_NAME[agg](column).column.alias("_best"))
        on = conj([L[k].eqNullSafe(F.col(f"_1.`{k}`")) for k in keys] + [L[column].eqNullSafe(F.col("_1._best"))])
        found = df.alias("_0").join(best.alias("_1") if keys else F.broadcast(best.alias("_1")), on, "left_semi")
        return found.distinct()  # of the few rows that are left
    pick = {
        "choose": F.min(all_),
        "choose_rand": F.max_by(all_, F.xxhash64(*df.columns, F.lit(seed))),
        "bool_and": F.min_by(all_, F.struct(F.col(column), all_)),
        "bool_or": F.min_by(all_, F.struct(~F.col(column), all_)),
    }
    if agg not in pick:
        raise CompileError(f"{agg} picks none of its inputs")
    out = df.groupBy(*keys, *one).agg(pick[agg].alias("_row"))
    return out.select(*(F.col(f"_row.`{c}`") for c in df.columns))


def argmin(df: DataFrame, keys: Sequence[str] | None, column: str) -> DataFrame:
    return argagg(df, "min", keys, column)


def argmax(df: DataFrame, keys: Sequence[str] | None, column: str) -> DataFrame:
    return argagg(df, "max", keys, column)


def reduce(df: DataFrame, init, step: Callable, merge: Callable, schema: str, fan_in: int = 256) -> DataFrame:
    """A host-language fold: step(memo, row) within partitions, merge(memo, memo) of their memos in two levels, then the memo's rows.

    A memo is a list of rows or a dict of key to value; it must start as `init` and its size must be bounded. The input's partitions
    stay as they are: only memos are shuffled, fan_in of them to a group. Empty input gives init's rows. Aggregates that Spark has
    should be written with group()."""
    spark, columns = df.sparkSession, df.columns
    if not isinstance(init, (list, dict, tuple, set)):
        raise TypeMismatchError("a memo is a list of rows or a dict")
    import pickle

    def part(frames):
        import copy

        from pyspark import TaskContext

        memo, any_ = copy.deepcopy(init), False
        for pdf in frames:
            for row in pdf.itertuples(index=False, name=None):
                memo, any_ = step(memo, dict(zip(columns, row))), True
        if any_:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "memo": [pickle.dumps(memo)]})

    def together(pdfs):
        memo = None
        for pdf in pdfs:
            for m in map(pickle.loads, pdf.memo):
                memo = m if memo is None else merge(memo, m)
        return memo

    def some(pdf):
        return pd.DataFrame({"memo": [pickle.dumps(together([pdf]))]})

    def done(frames):
        memo = together(frames)
        memo = init if memo is None else memo
        rows = [(k, *(v if isinstance(v, (tuple, list)) else (v,))) for k, v in memo.items()] if isinstance(memo, dict) else [tuple(r) for r in memo]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = spark.createDataFrame([], schema).columns
    memos = df.mapInPandas(part, "at int, memo binary").groupBy(F.floor(F.col("at") / fan_in)).applyInPandas(some, "memo binary")
    seed = spark.createDataFrame([], "memo binary")
    return memos.unionByName(seed).repartition(1).mapInPandas(done, schema)  # one memo for fan_in partitions


def group_fold(df: DataFrame, keys: Sequence[str] | None, column: str, agg: A.HostAgg, name: str, type_: str) -> DataFrame:
    """An aggregate in the host language: each partition folds its own rows of a group into a state, and the states of a group are
    merged, so no task holds a group's rows."""
    import pickle

    keys, kinds = list(keys or []), {f.name: f.dataType.simpleString() for f in df.schema}
    slim = df.select(*keys, F.col(column).alias("_x"))

    def part(frames):
        states: dict[tuple, object] = {}
        for pdf in frames:
            for *k, x in pdf.itertuples(index=False, name=None):
                k = tuple(None if v != v else v for v in k)
                states[k] = agg.trans(states[k], x)[0] if k in states else agg.init(x)
            if len(states) > 50_000:
                yield rows(states)
                states = {}
        if states:
            yield rows(states)

    def rows(states):
        return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "_state"])

    def merged(key, pdf):
        states = map(pickle.loads, pdf["_state"])
        state = next(states)
        for s in states:
            state = agg.merge(state, s)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), agg.final(state))], columns=[*keys, name])

    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    partial = slim.mapInPandas(part, f"{head}_state binary")
    grouped = partial.groupBy(*keys)
    return grouped.applyInPandas(merged, f"{head}`{name}` {type_}")


def arg_fold(df: DataFrame, keys: Sequence[str] | None, column: str, agg: A.HostAgg) -> DataFrame:
    """Rows that an aggregate of one's own keeps: its trans() says of each input, in order of value, whether it is ignored, kept beside
    those kept so far, kept in their place, or makes some of them go. What one partition discards can't be kept in the end, so
    each partition keeps its own and the kept rows of a group meet."""
    keys, columns = list(keys or []), df.columns
    place, key_at = columns.index(column), [columns.index(k) for k in keys]

    def keep(rows: list[tuple]) -> list[tuple]:
        state, kept = None, []
        for i, row in enumerate(sorted(rows, key=lambda r: (r[place] is None, r[place], repr(r)))):
            state, flag = (agg.init(row[place]), A.KEEP) if i == 0 else agg.trans(state, row[place])
            if flag == A.KEEP:
                kept.append(row)
            elif flag == A.REPLACE:
                kept = [row]
            elif isinstance(flag, tuple) and flag[0] == A.DELETE:
                gone = set(flag[1])
                kept = [r for r in kept if r[place] not in gone] + [row]
            elif flag != A.IGNORE:
                raise CompileError(f"not a flag: {flag!r}")
        return kept

    def part(frames):
        groups: dict[tuple, list[tuple]] = {}
        for pdf in frames:
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                own = groups.setdefault(tuple(row[i] for i in key_at), [])
                own.append(row)
                if len(own) > 1000:
                    own[:] = keep(own)
        kept = [r for own in groups.values() for r in keep(own)]
        if kept:
            yield pd.DataFrame(kept, columns=columns)

    def merged(pdf):
        return pd.DataFrame(keep(list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None))), columns=columns)

    partial = df.distinct().mapInPandas(part, df.schema)
    grouped = partial.groupBy(*keys)
    return grouped.applyInPandas(merged, df.schema)


# --- order -----------------------------------------------------------------------------------------------------------


def sort(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*(order or df.columns))


def with_index(df: DataFrame, *order, name: str = "i", materialise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows with their 0-based place in the order (all columns if none is given).

    Rows are range-partitioned and numbered within partitions; the partitions' counts, one row each, give the offsets.
    materialise() writes and rereads its input: it is the program's in rules, and by default a folder of its own."""
    order = order or tuple(df.columns)
    if materialise is None:
        from strata.plans.storage import Storage

        materialise = Storage(df.sparkSession).write
    ranged = df.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in order)).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id()
    placed = materialise(ranged.select("*", F.shiftright(mono, 33).cast("int").alias("_part"), mono.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def longest_runs(df: DataFrame, group_cols: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that touch or overlap, coalesced: gaps and islands by window functions."""
    w = Window.partitionBy(*group_cols).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).over(w)
    return df.withColumn("_island", island).groupBy(*group_cols, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


# --- sets ------------------------------------------------------------------------------------------------------------


def union(*dfs: DataFrame) -> DataFrame:
    """By position, equal rows once."""
    return fold(lambda a, b: a.union(b), dfs).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def scalar(df: DataFrame, kind: str, pred: Column | None = None) -> DataFrame:
    """all, any, none, one, or member of a relation as one boolean row (column `value`)."""
    p = F.coalesce(pred if pred is not None else F.lit(True), F.lit(False))
    hits = F.count_if(p)
    value = {"all": F.count_if(~p) == 0, "any": hits > 0, "none": hits == 0, "one": hits == 1, "member": hits > 0}[kind]
    return df.agg(value.alias("value"))
