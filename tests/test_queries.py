"""Every engine query against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb
import pytest

from strata import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    """A value in a form that both sides share: six digits of numbers, times without a zone, rows as lists."""
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in values))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    cursor = duck.execute(queries.ORACLE_SQL[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


def same_generation_of(spark, folder, customers, nations):
    """(rows of the query, rows of its SQL, rows that the query stored) over customers (key, nation) of the segment and nations (key, region)."""
    spark.createDataFrame([(k, n, "BUILDING") for k, n in customers] + [(0, 0, "MACHINERY"), (1, 1, None)], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"file://{folder}/customer.parquet")
    spark.createDataFrame(nations, "n_nationkey int, n_regionkey int").write.parquet(f"file://{folder}/nation.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("program-*"))
    found = queries.QUERIES["same_generation"](spark, f"file://{folder}")
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    stored = sum(spark.read.parquet(f"file://{x}").count() for p in set(shared.glob("program-*")) - before for x in p.iterdir())
    with duckdb.connect() as con:
        for name in ("customer", "nation"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        cursor = con.execute(queries.ORACLE_SQL["same_generation"])
        return got, rows([c[0] for c in cursor.description], cursor.fetchall()), stored


def test_same_generation_stores_no_pairs_of_customers(spark, tmp_path):
    got, want, stored = same_generation_of(spark, tmp_path, [(k, k % 3) for k in range(600)], [(0, 0), (1, 0), (2, 1)])
    assert got == want and len(got[1]) == 603
    assert stored < 2 * 603


def test_same_generation_of_several_parents_and_nulls(spark, tmp_path):
    customers = [(1, 0), (1, 0), (1, 3), (2, 1), (2, 2), (3, 2), (4, 4), (5, 9), (6, 9), (7, None), (8, None), (None, 0), (None, 4), (None, None)]
    nations = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (3, 2), (4, None), (None, 0), (None, None)]
    got, want, _ = same_generation_of(spark, tmp_path, customers, nations)
    assert got == want and len(got[1]) > 10
