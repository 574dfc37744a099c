"""Scalar helpers that rule bodies use beside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number division that rounds down; by zero is an error, as ANSI mode has it."""
    return F.floor(a / b).cast("long")


def inspect(column: Column, kind: T.DataType) -> Column:
    """A value's printed form: strings in quotes, null as nil, arrays in brackets."""
    if isinstance(kind, T.StringType):
        shown = F.concat(F.lit('"'), F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    elif isinstance(kind, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: inspect(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        shown = F.concat(F.lit("["), F.concat_ws(", ", *(inspect(column[f.name], f.dataType) for f in kind.fields)), F.lit("]"))
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit("nil"))


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def json_long(props: Column, key: str) -> Column:
    return F.get_json_object(props, f"$.{key}").cast("long")


def random_of(*cols, seed: int = 0) -> Column:
    """A number from 0 to 1, exclusive, for each value of some columns: as good as random, and the same in every run and retry."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def id_of(*cols, seed: int = 0) -> Column:
    """A 32-digit identifier for each value of some columns: of equal values the same, of others another."""
    return F.md5(F.to_json(F.struct(*cols, F.lit(seed).alias("_seed"))).cast("binary"))
