"""Schemas of collections: ordered columns, of which the first ones are the key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata.errors import CompileError, KeyConstraintError, TypeMismatchError
from strata.functions.lattices import Lattice

RESERVED = {"schema", "cols", "key_cols", "val_cols", "tabname", "keys", "values", "rows", "insert", "delete", "upsert"}


def _fields(ddl: str | Sequence[T.StructField] | None) -> list[T.StructField]:
    if not ddl:
        return []
    if isinstance(ddl, str):
        parts = T.StructType.fromDDL(", ".join(p if " " in p.strip() else f"{p.strip()} string" for p in _split(ddl))).fields
        return [T.StructField(f.name, f.dataType, True) for f in parts]
    return [T.StructField(f.name, f.dataType, True) for f in ddl]


def _split(ddl: str) -> list[str]:
    """At commas that aren't within a type's brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


@dataclass(frozen=True)
class Schema:
    """keys and vals: DDL strings (`a long, b string`; a name without a type is a string) or fields.

    lattices: the lattice of each val column that holds lattice values. location: the column with a message's address."""

    key_fields: tuple[T.StructField, ...]
    val_fields: tuple[T.StructField, ...] = ()
    lattices: dict[str, Lattice] = field(default_factory=dict)
    location: str | None = None

    @classmethod
    def of(cls, keys=None, vals=None, lattices: dict[str, Lattice] | None = None, located: bool = False) -> Schema:
        if keys is None and vals is None:
            keys, vals = "key string", "val string"
        key_fields, val_fields = _fields(_plain(keys)), _fields(_plain(vals))
        marked = [x.split()[0][1:] for part in (keys, vals) if isinstance(part, str) for x in _split(part) if x.startswith("@")]
        names = [f.name for f in (*key_fields, *val_fields)]
        if len(set(names)) != len(names):
            raise CompileError(f"column names repeat: {names}")
        if RESERVED & set(names):
            raise CompileError(f"reserved column names: {sorted(RESERVED & set(names))}")
        if marked and not located:
            raise CompileError("only channels have a column marked with @")
        if located and len(marked) != 1:
            raise CompileError("a channel has exactly one column marked with @")
        wrong = set(lattices or {}) - {f.name for f in val_fields}
        if wrong:
            raise TypeMismatchError(f"lattice values belong in non-key columns, not in {sorted(wrong)}")
        return cls(tuple(key_fields), tuple(val_fields), dict(lattices or {}), marked[0] if located else None)

    @property
    def fields(self) -> list[T.StructField]:
        return [*self.key_fields, *self.val_fields]

    @property
    def key_cols(self) -> list[str]:
        return [f.name for f in self.key_fields]

    @property
    def val_cols(self) -> list[str]:
        return [f.name for f in self.val_fields]

    @property
    def cols(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def struct(self) -> T.StructType:
        return T.StructType(self.fields)

    @property
    def plain_vals(self) -> list[str]:
        return [c for c in self.val_cols if c not in self.lattices]

    def align(self, df: DataFrame) -> DataFrame:
        """df by position: short rows are padded with nulls, wide ones are an error."""
        if len(df.columns) > len(self.fields):
            raise TypeMismatchError(f"{len(df.columns)} columns for the {len(self.fields)} of {self.cols}")
        named = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
        given = [F.col(f"_{i}") if i < len(df.columns) else F.lit(None) for i in range(len(self.fields))]
        return named.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(given, self.fields)))

    def rows(self, spark, rows) -> DataFrame:
        """A DataFrame of host rows (tuples, lists or dicts of columns)."""
        out = []
        for r in rows:
            if isinstance(r, dict):
                r = [r.get(c) for c in self.cols]
            if not isinstance(r, (tuple, list)):
                raise TypeMismatchError(f"not a row: {r!r}")
            if len(r) > len(self.fields):
                raise TypeMismatchError(f"{len(r)} values for the columns {self.cols}")
            out.append((*r, *[None] * (len(self.fields) - len(r))))
        return self.frame(spark, out)

    def frame(self, spark, rows: list[tuple]) -> DataFrame:
        """Full rows as a local relation: no task makes it, and Catalyst drops it from plans where it is empty."""
        plain = not any(isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.MapType, T.StructType)) for f in self.fields)
        if not self.fields or not (plain or not rows):
            return spark.createDataFrame(rows, self.struct)
        kinds = to_arrow_schema(self.struct)
        columns = list(zip(*rows)) if rows else [()] * len(self.fields)
        try:
            table = pa.Table.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds)], schema=kinds)
        except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
            raise TypeMismatchError(f"values don't fit the columns {self.cols}: {e}") from e
        return spark.createDataFrame(table, self.struct)

    def merged(self, df: DataFrame) -> DataFrame:
        """Aligned rows as a set: equal rows once, lattice values merged by key."""
        if not self.lattices:
            return df.distinct()
        keys = [F.col(c) for c in (*self.key_cols, *self.plain_vals)]
        one = [] if keys else [F.lit(1).alias("_one")]
        out = df.groupBy(*keys, *one).agg(*(self.lattices[c].agg(F.col(c)).cast(self.struct[c].dataType).alias(c) for c in self.val_cols if c in self.lattices))
        return out.select(*self.cols)

    def conflict(self, df: DataFrame) -> DataFrame | None:
        """Keys that more than one row of df has; None if that can't be."""
        if not self.plain_vals:
            return None
        one = [] if self.key_cols else [F.lit(1).alias("_one")]
        return df.groupBy(*self.key_cols, *one).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def check(self, df: DataFrame, name: str) -> None:
        """Raises if two rows of df agree on the key. One aggregation on the key; stops at the first conflict found."""
        found = self.conflict(df)
        if found is not None and (bad := found.limit(1).collect()):
            raise KeyConstraintError(f"{name}: two rows with the key {tuple(bad[0])[: len(self.key_cols)]}")


def _plain(x):
    return x.replace("@", "") if isinstance(x, str) else x
