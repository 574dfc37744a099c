"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import aggs as A
from strata.functions.scalars import json_long, words
from strata.operators import relational as O
from strata.operators.relational import L, R, S
from strata.plans import fixpoint
from strata.plans import program as P
from strata.plans.storage import Storage
from strata.streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c) -> F.Column:
    """Exact sums of amounts: floats as decimals of two places."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


# --- flagship ----------------------------------------------------------------------------------------------------------


@query("""SELECT n_name, CAST(sum(CAST(l_extendedprice AS decimal(12,2)) * (1 - CAST(l_discount AS decimal(12,2)))) AS double) AS revenue
FROM (SELECT DISTINCT n_name, l.* FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem l ON l_orderkey = o_orderkey
JOIN nation ON n_nationkey = c_nationkey) GROUP BY n_name""")
def revenue_by_nation(spark, d):
    c, o, li, n = (t(spark, d, x) for x in ("customer", "orders", "lineitem", "nation"))
    joined = O.combos([c, o, li, n], [((0, "c_custkey"), (1, "o_custkey")), ((1, "o_orderkey"), (2, "l_orderkey")), ((0, "c_nationkey"), (3, "n_nationkey"))], S(3)["n_name"].alias("n_name"), (S(2)["l_extendedprice"].cast("decimal(12,2)") * (1 - S(2)["l_discount"].cast("decimal(12,2)"))).alias("amount"))
    # Rows of lineitem are distinct and each meets one nation: the input of the sum is a set already.
    out = O.group_as(joined, ["n_name"], is_set=True, revenue=A.sum_("amount"))
    return out.withColumn("revenue", F.col("revenue").cast("double"))


# --- projection and filter -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def project(spark, d):
    return O.project(t(spark, d, "orders"), "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_rows(spark, d):
    return O.project(t(spark, d, "orders"), "o_orderkey", "o_totalprice", where=(F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))


@query("SELECT DISTINCT p_partkey FROM part")
def keys(spark, d):
    return O.keys(t(spark, d, "part"), ["p_partkey"])


@query("SELECT DISTINCT p_brand, p_size FROM part")
def values(spark, d):
    return O.values(t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_partkey"])


@query("SELECT n_nationkey AS id, n_name AS label FROM nation")
def rename(spark, d):
    return O.rename(t(spark, d, "nation").select("n_nationkey", "n_name"), "id", "label")


@query("""SELECT '[' || n_nationkey || ', "' || n_name || '", ' || n_regionkey || ']' AS line FROM nation""")
def inspected(spark, d):
    return O.inspected(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> ''")
def flat_map_words(spark, d):
    return O.flat_map(t(spark, d, "documents"), words(F.col("text")), "doc_id", "word", name="word").distinct()


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count_group(spark, d):
    return O.group_as(O.flat_map(t(spark, d, "documents"), words(F.col("text")), "doc_id", "at", "word", name="word", index="at"), ["word"], is_set=True, n=A.count())


@query("SELECT event_type AS k, count(*) AS n FROM events GROUP BY event_type")
def word_count_reduce(spark, d):
    def step(memo, row):
        memo[row["event_type"]] = memo.get(row["event_type"], 0) + 1
        return memo

    def merge(a, b):
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a

    return O.reduce(t(spark, d, "events").select("event_type"), {}, step, merge, "k string, n long")


@query("SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[Ll]icen[cs]e|http|@')")
def grep_lines(spark, d):
    return O.flat_map(t(spark, d, "documents"), F.split("text", "\n"), "doc_id", "line", name="line").where(F.col("line").rlike("[Ll]icen[cs]e|http|@")).distinct()


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def pairs(spark, d):
    return O.pairs(t(spark, d, "customer"), t(spark, d, "orders"), {"c_custkey": "o_custkey"}, L["c_custkey"].alias("c_custkey"), R["o_orderkey"].alias("o_orderkey"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def combos3(spark, d):
    return O.combos([t(spark, d, x) for x in ("supplier", "nation", "region")], {"s_nationkey": "n_nationkey", "n_regionkey": "r_regionkey"}, S(0)["s_suppkey"].alias("s_suppkey"), S(1)["n_name"].alias("n_name"), S(2)["r_name"].alias("r_name"))


@query("SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def matches_natural(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return O.matches([c, s], S(0)["id"].alias("c_custkey"), S(1)["id"].alias("s_suppkey")).distinct()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def lefts(spark, d):
    return O.lefts(t(spark, d, "orders"), t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, F.col("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND o_orderpriority = '1-URGENT')")
def rights(spark, d):
    return O.rights(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT a.n_nationkey, a.n_regionkey, b.r_regionkey, b.r_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def flatten(spark, d):
    return O.flatten([t(spark, d, "nation").select("n_nationkey", "n_regionkey"), t(spark, d, "region")], {"n_regionkey": "r_regionkey"})


@query("SELECT a.r_name, b.r_name AS r_name_1 FROM region a, region b")
def product(spark, d):
    r = t(spark, d, "region").select("r_name")
    return O.flatten([r, r])


@query("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def theta_pairs(spark, d):
    n = t(spark, d, "nation")
    return O.pairs(n, n, {"n_regionkey": "n_regionkey"}, L["n_nationkey"].alias("low"), R["n_nationkey"].alias("high"), theta=L["n_nationkey"] < R["n_nationkey"])


@query("SELECT DISTINCT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey + 1 = b.c_custkey")
def self_join(spark, d):
    c = t(spark, d, "customer").withColumn("next", F.col("c_custkey") + 1)
    return O.pairs(c, c, {"c_nationkey": "c_nationkey", "c_mktsegment": "c_mktsegment", "next": "c_custkey"}, L["c_custkey"].alias("a"), R["c_custkey"].alias("b"))


@query("SELECT DISTINCT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def outer(spark, d):
    return O.outer(t(spark, d, "orders"), t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, L["o_orderkey"].alias("o_orderkey"), R["l_partkey"].alias("l_partkey")).distinct()


_MISSING = "(SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IS NULL)"


@query(f"SELECT x.o_orderkey AS a, y.least AS b FROM {_MISSING} x JOIN (SELECT l_partkey, min(o_orderkey) AS least FROM {_MISSING} GROUP BY l_partkey) y ON x.l_partkey IS NOT DISTINCT FROM y.l_partkey")
def null_keys_match(spark, d):
    """All orders without line items, joined on their null part with the least of them."""
    missing = O.outer(t(spark, d, "orders"), t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, L["o_orderkey"].alias("k"), R["l_partkey"].alias("p")).where("p IS NULL")
    least = O.group_as(missing, ["p"], least=A.min_("k"))
    return O.pairs(missing, least, {"p": "p"}, L["k"].alias("a"), R["least"].alias("b"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def notin_keys(spark, d):
    return O.notin(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), {"doc_id": "doc_id"})


@query("SELECT c_nationkey, c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def notin_whole(spark, d):
    c = t(spark, d, "customer")
    return O.notin(c.select("c_nationkey", "c_mktsegment").distinct(), c.where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def notin_block(spark, d):
    return O.notin(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, theta=R["l_quantity"] > 25)


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def notin_chain(spark, d):
    first = O.notin(t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"})
    return O.notin(first, t(spark, d, "customer").where("c_acctbal < 0"), {"o_custkey": "c_custkey"})


@query("SELECT conv_id, turn FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
def notin_self(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn").withColumn("next", F.col("turn") + 1)
    return O.notin(c, c, {"conv_id": "conv_id", "next": "turn"}).select("conv_id", "turn")


# --- aggregation ---------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, min(l_quantity) AS least, max(l_quantity) AS most, CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) AS total, count(*) AS n,
avg(l_linenumber) AS mean_line FROM lineitem GROUP BY ALL""")
def group_min_max_sum_cnt_avg(spark, d):
    li = t(spark, d, "lineitem")
    out = O.group_as(li, ["l_returnflag", "l_linestatus"], is_set=True, least=A.min_("l_quantity"), most=A.max_("l_quantity"), total=A.sum_(money("l_extendedprice")), n=A.count("l_tax"), mean_line=A.avg("l_linenumber"))
    return out.withColumn("total", F.col("total").cast("double"))


@query("SELECT count(*) AS n, max(o_orderdate) AS last FROM orders")
def group_global(spark, d):
    return O.group_as(t(spark, d, "orders"), None, is_set=True, n=A.count(), last=A.max_("o_orderdate"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0")
def group_nokeys_empty(spark, d):
    return O.group_as(t(spark, d, "orders").where("o_orderkey < 0"), None, n=A.count())


@query("SELECT l_returnflag, CAST(sum(q) AS double) AS total, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_quantity AS q FROM lineitem) GROUP BY l_returnflag")
def group_distinct_input(spark, d):
    return O.group_as(t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q")), ["l_returnflag"], total=A.sum_("q"), n=A.count())


@query("SELECT l_shipyear, bool_and(late) AS all_late, bool_or(late) AS any_late FROM (SELECT year(l_shipdate) AS l_shipyear, l_tax > 0.07 AS late FROM lineitem) GROUP BY l_shipyear")
def bool_and_or(spark, d):
    li = t(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("l_shipyear"), (F.col("l_tax") > 0.07).alias("late"))
    return O.group_as(li, ["l_shipyear"], all_late=A.bool_and("late"), any_late=A.bool_or("late"))


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey)), ',') AS nations FROM customer GROUP BY c_mktsegment")
def accum(spark, d):
    out = O.group_as(t(spark, d, "customer").select("c_mktsegment", "c_nationkey"), ["c_mktsegment"], nations=A.accum("c_nationkey"))
    return out.withColumn("nations", F.array_join(F.col("nations").cast("array<string>"), ","))


@query("SELECT quality, string_agg(DISTINCT doc_id || ':' || toxic, ',' ORDER BY doc_id || ':' || toxic) AS pairs FROM labels GROUP BY quality")
def accum_pair(spark, d):
    out = O.group_as(t(spark, d, "labels"), ["quality"], pairs=A.accum_pair("doc_id", "toxic"))
    return out.select("quality", F.array_join(F.array_sort(F.transform("pairs", lambda p: F.concat_ws(":", p["x"], p["y"]))), ",").alias("pairs"))


@query("SELECT s_nationkey, min(s_name) AS one FROM supplier GROUP BY s_nationkey")
def choose_min(spark, d):
    return O.group_as(t(spark, d, "supplier"), ["s_nationkey"], one=A.choose("s_name"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_keys_only(spark, d):
    return O.group(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT p_brand, CAST(product(1 + p_size % 2) AS double) AS folded FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand")
def custom_aggregate(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_size")
    return O.group_as(p, ["p_brand"], folded=A.folded("product", F.lit(1.0).cast("double"), lambda a, x: a * (1 + x % 2), "p_size"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) = 1")
def argmin_ties(spark, d):
    return O.argmin(t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal")


@query("SELECT p_partkey, p_brand, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) = 1")
def argmax(spark, d):
    return O.argmax(t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def argmax_global(spark, d):
    return O.argmax(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), None, "o_totalprice")


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT * FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) = 1) QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1")
def argmin_then_argmax(spark, d):
    return O.argmax(O.argmin(t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size"), ["p_brand"], "p_partkey")


@query("SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1")
def argagg_choose(spark, d):
    return O.argagg(t(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "choose", ["s_nationkey"], "s_suppkey")


@query("SELECT quality, doc_id, toxic = 1 AS bad FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY toxic DESC, doc_id) = 1")
def argagg_bool_or(spark, d):
    return O.argagg(t(spark, d, "labels").select("quality", "doc_id", (F.col("toxic") == 1).alias("bad")), "bool_or", ["quality"], "bad")


@query("SELECT user_id, true AS member, count(DISTINCT event_id) > 5 AS varies FROM events GROUP BY user_id")
def choose_rand(spark, d):
    """Which row is picked is no matter for SQL; that it is one of the group's own is, and that another seed picks another where there
    are more than a few to pick from."""
    e = t(spark, d, "events").select("user_id", "event_id")
    picked = O.group_as(e, ["user_id"], **{f"s{i}": A.choose_rand("event_id", i) for i in range(12)}, n=A.count())
    own = O.flat_map(picked, F.array(*(f"s{i}" for i in range(12))), "user_id", "n", "event_id", name="event_id").distinct()
    found = O.pairs(own, e, {"user_id": "user_id", "event_id": "event_id"}, L["user_id"].alias("user_id"), L["n"].alias("n"), L["event_id"].alias("event_id"))
    seen = found.distinct().groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("k"))
    return seen.select("user_id", F.lit(True).alias("member"), ((F.col("k") > 1) & (F.col("n") > 5)).alias("varies"))


@query("SELECT 'none' AS k, CAST(0 AS bigint) AS n")
def reduce_empty(spark, d):
    """A fold of nothing gives its initial value."""
    return O.reduce(t(spark, d, "orders").where("o_totalprice < 0").select("o_orderstatus"), {"none": 0}, lambda memo, row: memo, lambda a, b: a, "k string, n long")


# --- order and sets --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders")
def sort_index(spark, d):
    p = _Numbered(spark)
    p.tick({"rows": t(spark, d, "orders").select("o_totalprice", "o_orderkey")})
    return p.placed.df().select("o_orderkey", "o_totalprice", "i")


class _Numbered(P.Program):
    rows = P.scratch("o_totalprice double, o_orderkey long")
    placed = P.scratch("o_totalprice double, o_orderkey long, i long")

    @P.rules
    def number(p):
        p.placed <= p.rows.sort("o_totalprice", "o_orderkey").each_with_index()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, d):
    return O.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_rules(spark, d):
    return O.union(t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 8000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return O.intersect(t(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("nation")), t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_rows(spark, d):
    return O.subtract(t(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), t(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("""SELECT user_id, min(day) AS first, max(day) AS last FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g
FROM (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS date)) AS bigint) AS day FROM events)) GROUP BY user_id, g""")
def longest_runs(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    spans = t(spark, d, "events").select("user_id", day.alias("first")).distinct().withColumn("last", F.col("first") + 1)
    return O.longest_runs(spans, ["user_id"], "first", "last").select("user_id", "first", (F.col("last") - 1).alias("last"))


# --- predicates over other collections -------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists_block(spark, d):
    return O.exists(t(spark, d, "customer"), t(spark, d, "orders"), (L["c_custkey"] == R["o_custkey"]) & (R["o_totalprice"] > 200000)).select("c_custkey")


@query("SELECT event_id FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value > 400)")
def include_block(spark, d):
    e = t(spark, d, "events")
    return O.lefts(e, e.where("value > 400"), {"user_id": "user_id", "event_type": "event_type"}, F.col("event_id"))


@query("SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def empty_block(spark, d):
    return O.empty(t(spark, d, "region").select("r_name"), t(spark, d, "orders").where("o_totalprice < 0"))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def coll_lookup(spark, d):
    return O.lookup(t(spark, d, "orders"), t(spark, d, "customer"), {"o_custkey": "c_custkey"}, L["o_orderkey"].alias("o_orderkey"), R["c_mktsegment"].alias("c_mktsegment"))


@query("SELECT r_name, (SELECT count(*) FROM nation) AS length FROM region")
def coll_length(spark, d):
    return O.with_length(t(spark, d, "region").select("r_name"), t(spark, d, "nation"))


@query("SELECT (SELECT bool_and(o_totalprice > 0) FROM orders) AS every, (SELECT count(*) FILTER (WHERE o_orderkey = 1) = 1 FROM orders) AS one")
def scalar_predicates(spark, d):
    o = t(spark, d, "orders")
    return O.scalar(o, "all", F.col("o_totalprice") > 0).withColumnRenamed("value", "every").crossJoin(O.scalar(o, "one", F.col("o_orderkey") == 1).withColumnRenamed("value", "one"))  # one row each


# --- recursion ---------------------------------------------------------------------------------------------------------------

_EDGES = """edge AS (SELECT c_nationkey AS f, s_nationkey AS t, min(CAST(round(o_totalprice) AS bigint)) AS c FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""
_PARTNERS = f"""{_EDGES}, partner AS (SELECT f, t FROM (SELECT f, t, rank() OVER (PARTITION BY f ORDER BY c) AS least, rank() OVER (PARTITION BY f ORDER BY c DESC) AS most FROM edge)
WHERE least = 1 OR most = 1)"""


def edges(spark, d) -> DataFrame:
    c, o, li, s = (t(spark, d, x) for x in ("customer", "orders", "lineitem", "supplier"))
    joined = O.combos([c, o, li, s], [((0, "c_custkey"), (1, "o_custkey")), ((1, "o_orderkey"), (2, "l_orderkey")), ((2, "l_suppkey"), (3, "s_suppkey"))], S(0)["c_nationkey"].alias("f"), S(3)["s_nationkey"].alias("t"), F.round(S(1)["o_totalprice"]).cast("long").alias("c"))
    return O.group_as(joined, ["f", "t"], c=A.min_("c"))


def partners(spark, d, store: Storage) -> DataFrame:
    """From each customer nation to the supplier nations of its least and its greatest edge: few edges, so that paths are long."""
    edge = store.write(edges(spark, d), "edge")
    return store.write(O.union(O.argmin(edge, ["f"], "c"), O.argmax(edge, ["f"], "c")).select("f", "t").distinct(), "partner")


def _doublings(step: str) -> str:
    """SQL of best paths by five doublings: all of up to 32 edges, more than a best path between 25 nations has."""
    parts = [_EDGES] + [f"d{k + 1} AS (SELECT f, t, {step} AS c FROM (SELECT f, t, c, NULL AS e FROM {x} UNION ALL SELECT a.f, b.t, a.c, b.c FROM {x} a JOIN {x} b ON a.t = b.f) GROUP BY f, t)" for k in range(5) for x in [f"d{k}" if k else "edge"]]
    return f"WITH {', '.join(parts)} SELECT f, t, CAST(c AS bigint) AS c FROM d5"


@query(f"WITH RECURSIVE {_PARTNERS}, tc AS (SELECT f, t FROM partner UNION SELECT tc.f, partner.t FROM tc JOIN partner ON tc.t = partner.f) SELECT f, t FROM tc")
def tc_nations(spark, d):
    store = Storage(spark)
    edge = partners(spark, d, store)
    return fixpoint.closure(edge, lambda x: O.pairs(x, edge, {"t": "f"}, L["f"].alias("f"), R["t"].alias("t")), store)


@query(f"WITH RECURSIVE {_PARTNERS}, tc AS (SELECT f, t FROM partner UNION SELECT tc.f, partner.t FROM tc JOIN partner ON tc.t = partner.f) SELECT f, t FROM tc WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = tc.t AND s_acctbal > 9000)")
def tc_then_notin(spark, d):
    return O.notin(tc_nations(spark, d), t(spark, d, "supplier").where("s_acctbal > 9000"), {"t": "s_nationkey"})


class _Paths(P.Program):
    """Shortest paths with a least-value lattice column: ends on cyclic graphs."""

    edge = P.scratch("f int, t int, c long")
    path = P.scratch("f int, t int", "c long", {"c": "lmin"})

    @P.rules
    def paths(p):
        p.path <= p.edge.select("f", "t", "c")
        p.path <= (p.path * p.edge).pairs({"t": "f"}, L["f"], R["t"], L["c"] + R["c"])


class _Widest(_Paths):
    path = P.scratch("f int, t int", "c long", {"c": "lmax"})

    @P.rules
    def paths(p):
        p.path <= p.edge.select("f", "t", "c")
        p.path <= (p.path * p.edge).pairs({"t": "f"}, L["f"], R["t"], F.least(L["c"], R["c"]))


@query(_doublings("min(c + coalesce(e, 0))"))
def shortest_path_lmin(spark, d):
    p = _Paths(spark)
    p.tick({"edge": edges(spark, d)})
    return p.path.df()


@query(_doublings("max(CASE WHEN e < c THEN e ELSE c END)"))
def widest_path_lmax(spark, d):
    p = _Widest(spark)
    p.tick({"edge": edges(spark, d)})
    return p.path.df()


@query("SELECT DISTINCT a.conv_id, a.turn AS from_turn, b.turn AS to_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND (b.turn - a.turn) = (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn > a.turn AND c.turn <= b.turn)")
def reach_conversation(spark, d):
    store = Storage(spark)
    c = t(spark, d, "conversations").select("conv_id", "turn")
    step = store.write(O.pairs(c.withColumn("next", F.col("turn") + 1), c, {"conv_id": "conv_id", "next": "turn"}, L["conv_id"].alias("conv_id"), L["turn"].alias("from_turn"), R["turn"].alias("to_turn")), "step")
    return fixpoint.closure(step, lambda x: O.pairs(x, step, {"conv_id": "conv_id", "to_turn": "from_turn"}, L["conv_id"].alias("conv_id"), L["from_turn"].alias("from_turn"), R["to_turn"].alias("to_turn")), store)


@query("""WITH RECURSIVE child AS (SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS p FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
sg AS (SELECT a.c AS a, b.c AS b FROM child a JOIN child b ON a.p = b.p UNION SELECT x.c, y.c FROM sg JOIN child x ON x.p = sg.a JOIN child y ON y.p = sg.b)
SELECT a, count(*) AS n, min(b) AS least FROM sg GROUP BY a""")
def same_generation(spark, d):
    """Of customers of one segment and nations, as children of nations and regions: who has an ancestor in common at the same height.

    Nodes with the same parents have the same relatives: rounds pair such classes, and counts and least names of classes are summed up.
    Pairs grow with the square of the sets of parents that occur, not of the customers."""
    store = Storage(spark)
    c, n = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), t(spark, d, "nation")
    name = lambda letter, c: F.concat(F.lit(letter), c)
    child = c.select(name("c", "c_custkey").alias("c"), name("n", "c_nationkey").alias("p")).unionByName(n.select(name("n", "n_nationkey").alias("c"), name("r", "n_regionkey").alias("p")))
    # As in SQL, a null parent is nobody's; nodes without a name count as one, which is no parent.
    member = O.group_as(child.where("p IS NOT NULL"), ["c"], parents=A.accum("p"))
    member = store.write(member.withColumn("k", F.to_json("parents")), "member")
    kind = store.write(O.group_as(member, ["k", "parents"], is_set=True, size=A.count(), least=A.min_("c")), "kind")
    up = O.flat_map(kind, F.col("parents"), "k", "p", name="p")
    over = store.write(O.pairs(up, member, {"p": "c"}, L["k"].alias("k"), R["k"].alias("above")).distinct(), "over")
    base = O.pairs(up, up, {"p": "p"}, L["k"].alias("a"), R["k"].alias("b"))
    step = lambda x: O.combos([x, over, over], [((0, "a"), (1, "above")), ((0, "b"), (2, "above"))], S(1)["k"].alias("a"), S(2)["k"].alias("b"))
    sizes = O.pairs(fixpoint.closure(base, step, store), kind, {"b": "k"}, L["a"].alias("k"), R["size"].alias("size"), R["least"].alias("least"))
    total = store.write(O.group_as(sizes, ["k"], is_set=True, n=A.sum_("size"), least=A.min_("least")), "total")
    return O.pairs(member, total, {"k": "k"}, L["c"].alias("a"), R["n"].alias("n"), R["least"].alias("least"))


# --- steps: deferred inserts, deletes and upserts --------------------------------------------------------------------------

_DAY = "date_diff('day', DATE '2024-01-01', CAST(ts AS date))"


class _Ledger(P.Program):
    incoming = P.interface("input", "id long, status string, price long")
    latest = P.table("status string", "price long")
    total = P.table("id long, status string, price long")
    gone = P.interface("input", "id long, status string, price long")
    seen = P.table("status string")
    fresh = P.scratch("status string")
    log = P.table("status string, step long")

    @P.rules
    def change(p):
        best = p.incoming.group(["status"], price=A.max_("price"))
        p.latest.upsert_(best)
        p.total <= p.incoming
        p.total.delete_(p.gone)

    @P.rules
    def once(p):
        p.fresh <= p.incoming.select("status").notin(p.seen)
        p.seen.next_(p.fresh)
        p.log <= p.fresh.apply(lambda df: df.withColumn("step", F.lit(p.step).cast("long")), True)


def _ledger(spark, d, days=(0, 1, 2)) -> _Ledger:
    p = _Ledger(spark)
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice").cast("long").alias("price"))
    for k in days:
        p.tick({"incoming": o.where(F.col("id") % len(days) == k)})
    p.tick()
    return p


@query("SELECT o_orderstatus AS status, max(CAST(round(o_totalprice) AS bigint)) AS price FROM orders WHERE o_orderkey % 3 = 2 GROUP BY 1 UNION ALL SELECT o_orderstatus, max(CAST(round(o_totalprice) AS bigint)) FROM orders WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM orders WHERE o_orderkey % 3 = 2) GROUP BY 1")
def upsert_ticks(spark, d):
    return _ledger(spark, d).latest.df()


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(round(o_totalprice) AS bigint) AS price FROM orders")
def table_accumulates(spark, d):
    return _ledger(spark, d).total.df()


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(round(o_totalprice) AS bigint) AS price FROM orders WHERE o_orderstatus <> 'F'")
def delete_exact(spark, d):
    p = _ledger(spark, d)
    p.tick({"gone": p.total.df().where("status = 'F'")})
    p.tick({"gone": p.total.df().withColumn("price", F.col("price") + 1)})
    p.tick()
    return p.total.df()


@query("SELECT o_orderstatus AS status, min(o_orderkey % 3) AS step FROM orders GROUP BY 1")
def dedup_across_ticks(spark, d):
    return _ledger(spark, d).log.df()


class _Next(P.Program):
    inp = P.scratch("k long, v long")
    kept = P.table("k long, v long")
    echo = P.scratch("k long, v long")

    @P.rules
    def later(p):
        p.kept.next_(p.inp.select("k", F.col("v") + 1))
        p.echo.next_(p.kept)


@query("SELECT CAST(n_nationkey AS bigint) AS k, CAST(n_regionkey + 1 AS bigint) AS v FROM nation")
def deferred_insert(spark, d):
    p = _Next(spark)
    p.tick({"inp": t(spark, d, "nation").select("n_nationkey", "n_regionkey")})
    p.tick()
    p.tick()
    return p.echo.df()


class _Keyed(P.Program):
    held = P.table("k long", "v long")
    ask = P.scratch("k long")

    @P.rules
    def delete_by_key(p):
        p.held.delete_((p.held * p.ask).lefts({"k": "k"}))


@query("SELECT CAST(n_nationkey AS bigint) AS k, CAST(n_regionkey AS bigint) AS v FROM nation WHERE n_regionkey >= 2")
def delete_by_key(spark, d):
    p = _Keyed(spark)
    n = t(spark, d, "nation")
    p.tick({"held": n.select("n_nationkey", "n_regionkey")})
    p.tick({"ask": n.where("n_regionkey < 2").select("n_nationkey")})
    p.tick()
    return p.held.df()


# --- lattices ------------------------------------------------------------------------------------------------------------------


class _Cells(P.Program):
    ev = P.scratch("id long, u long, kind string, k long")
    hi = P.lmax("long")
    users = P.lset("long")
    nums = P.lpset("long")
    left = P.lbag("string")
    right = P.lbag("string")
    best = P.lmap("string", "long", "lmax")
    other = P.lmap("string", "long", "lmax")
    n_users = P.scratch("v long")
    pos = P.scratch("v long")
    bag_sum = P.scratch("elem string", "v long")
    bag_both = P.scratch("elem string", "v long")
    bag_any = P.lbag("string")
    common = P.scratch("k string", "v long")
    per_mod = P.scratch("m long", "v long")
    quorum = P.scratch("ok boolean")

    @P.rules
    def fill(p):
        e = p.ev
        p.hi <= e.select("k")
        p.users <= p.ev.select("u")
        p.nums <= p.ev.select("k")
        p.left <= p.ev.where(F.col("id") % 2 == 0).group(["kind"], A.count())
        p.right <= p.ev.where(F.col("id") % 2 == 1).group(["kind"], A.count())
        p.best <= p.ev.select("kind", "k")
        p.other <= p.ev.where("kind <> 'view'").select("kind", F.col("k") + 1)

    @P.rules
    def read(p):
        p.n_users <= p.users.size()
        p.pos <= p.nums.pos_sum()
        p.bag_sum <= p.left.plus(p.right)
        p.bag_both <= p.left.intersect(p.right)
        p.bag_any <= p.left.merge(p.right)
        p.common <= p.best.intersect(p.other)
        p.per_mod <= p.users.select((F.col("elem") % 7).alias("m"), "elem").group_count("m")
        p.quorum <= p.users.size().gt_eq(5).when_true()


def _cells(spark, d) -> _Cells:
    p = _Cells(spark)
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", json_long(F.col("props"), "k"))
    p.tick({"ev": e.where("event_id % 2 = 0")})
    p.tick({"ev": e})
    return p


_K = "CAST(json_extract(props, '$.k') AS bigint)"


@query(f"SELECT max({_K}) AS v FROM events")
def lmax_merge(spark, d):
    return _cells(spark, d).hi.df()


@query("SELECT count(DISTINCT user_id) AS v FROM events")
def lset_size(spark, d):
    return _cells(spark, d).n_users.df()


@query(f"SELECT CAST(sum(DISTINCT {_K}) AS bigint) AS v FROM events")
def lpset_pos_sum(spark, d):
    return _cells(spark, d).pos.df()


@query("SELECT event_type AS elem, count(*) AS v FROM events GROUP BY 1")
def lbag_sum(spark, d):
    return _cells(spark, d).bag_sum.df()


@query("SELECT elem, min(n) AS v FROM (SELECT event_type AS elem, event_id % 2 AS side, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY elem HAVING count(*) = 2")
def lbag_intersect(spark, d):
    return _cells(spark, d).bag_both.df()


@query("SELECT elem, max(n) AS v FROM (SELECT event_type AS elem, event_id % 2 AS side, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY elem")
def lbag_union(spark, d):
    return _cells(spark, d).bag_any.df()


@query(f"SELECT event_type AS k, max({_K}) AS v FROM events GROUP BY 1")
def lmap_merge(spark, d):
    return _cells(spark, d).best.df()


@query(f"SELECT event_type AS k, max({_K}) + 1 AS v FROM events WHERE event_type <> 'view' GROUP BY 1")
def lmap_intersect(spark, d):
    return _cells(spark, d).common.df()


@query("SELECT user_id % 7 AS m, count(DISTINCT user_id) AS v FROM events GROUP BY 1")
def lset_group_count(spark, d):
    return _cells(spark, d).per_mod.df()


@query("SELECT true AS ok WHERE (SELECT count(DISTINCT user_id) FROM events) >= 5")
def quorum(spark, d):
    return _cells(spark, d).quorum.df()


class _Maps(P.Program):
    ev = P.scratch("u long, kind string, k long")
    viewers = P.lset("long")
    failed = P.lset("long")
    used = P.lset("u long, k long")
    named = P.lset("k long, kind string")
    best = P.lmap("string", "long", "lmax")
    late = P.lmap("string", "boolean", "lbool")
    bag = P.lbag("string")
    low = P.lmin("long")
    both = P.scratch("u long")
    met = P.scratch("u long, kind string")
    has = P.scratch("v boolean")
    at = P.scratch("v long")
    kinds = P.scratch("k string")
    raised = P.scratch("k string, v long")
    true_for = P.scratch("k string")
    times = P.scratch("v long")
    below = P.scratch("k string")

    @P.rules
    def fill(p):
        p.viewers <= p.ev.where("kind = 'view'").select("u")
        p.failed <= p.ev.where("kind = 'error'").select("u")
        p.used <= p.ev.select("u", "k")
        p.named <= p.ev.select("k", "kind")
        p.best <= p.ev.select("kind", "k")
        p.late <= p.ev.select("kind", (F.col("k") >= 98).alias("late"))
        p.bag <= p.ev.group(["kind"], A.count())
        p.low <= p.ev.select("k")

    @P.rules
    def read(p):
        p.both <= p.viewers.intersect(p.failed)
        p.met <= p.used.eqjoin(p.named, {"k": "k"}, L["u"], R["kind"])
        p.has <= p.viewers.contains(1)
        p.at <= p.best.at("view")
        p.kinds <= p.best.key_set()
        p.raised <= p.best.apply_values(lambda v: v * 2 + 1)
        p.true_for <= p.late.filter_true().key_set()
        p.times <= p.bag.multiplicity("view")
        p.below <= p.low.lt(5).when_true(p.best.key_set())


def _maps(spark, d) -> _Maps:
    p = _Maps(spark)
    p.tick({"ev": t(spark, d, "events").select("user_id", "event_type", json_long(F.col("props"), "k")).distinct()})
    return p


@query("SELECT user_id AS u FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def lset_intersect(spark, d):
    return _maps(spark, d).both.df()


@query(f"SELECT DISTINCT u, kind FROM (SELECT DISTINCT user_id AS u, {_K} AS k FROM events) JOIN (SELECT DISTINCT {_K} AS k, event_type AS kind FROM events) USING (k)")
def lset_eqjoin(spark, d):
    return _maps(spark, d).met.df()


@query("SELECT count(*) > 0 AS v FROM events WHERE event_type = 'view' AND user_id = 1")
def lset_contains(spark, d):
    return _maps(spark, d).has.df()


@query(f"SELECT max({_K}) AS v FROM events WHERE event_type = 'view' HAVING count(*) > 0")
def lmap_at(spark, d):
    return _maps(spark, d).at.df()


@query("SELECT DISTINCT event_type AS k FROM events")
def lmap_key_set(spark, d):
    return _maps(spark, d).kinds.df()


@query(f"SELECT event_type AS k, max({_K}) * 2 + 1 AS v FROM events GROUP BY 1")
def lmap_apply(spark, d):
    return _maps(spark, d).raised.df()


@query(f"SELECT event_type AS k FROM events GROUP BY 1 HAVING bool_or({_K} >= 98)")
def lmap_filter(spark, d):
    return _maps(spark, d).true_for.df()


@query(f"SELECT count(*) AS v FROM (SELECT DISTINCT user_id, {_K} FROM events WHERE event_type = 'view')")
def lbag_multiplicity(spark, d):
    return _maps(spark, d).times.df()


@query(f"SELECT DISTINCT event_type AS k FROM events WHERE (SELECT min({_K}) FROM events) < 5")
def lmin_when_true(spark, d):
    return _maps(spark, d).below.df()


# --- events and channels ---------------------------------------------------------------------------------------------------------


class _Timer(P.Program):
    """What comes in between two ticks of a timer is counted at the second."""

    ev = P.interface("input", "id long, kind string")
    timer = P.periodic(3600)
    open_ = P.table("id long, kind string")
    counts = P.table("bucket long, kind string", "n long")

    @P.rules
    def gather(p):
        p.open_ <= p.ev
        due = p.open_.notin(p.ev).exists(p.timer)  # what came in before this step
        p.counts <= due.group(["kind"], n=A.count()).apply(lambda df: df.select(F.floor(F.unix_timestamp(F.lit(p.clock)) / 3600).cast("long") - 1, "kind", "n"), True)
        p.open_.delete_(due)


_HOURS = 6


@query(f"""WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts) / 3600) AS bigint) AS hour FROM events), h AS (SELECT min(hour) AS low FROM e)
SELECT hour AS bucket, event_type AS kind, count(*) AS n FROM e, h WHERE hour < low + {_HOURS} GROUP BY 1, 2""")
def periodic_bucket(spark, d):
    """The first hours of events, each hour's in a step of its own; the timer is due at each full hour."""
    e = t(spark, d, "events").select("event_id", "event_type", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour"))
    low = e.agg(F.min("hour")).first()[0]
    now = [dt.datetime.fromtimestamp(low * 3600, dt.timezone.utc).replace(tzinfo=None)]
    p = _Timer(spark, clock=lambda: now[0])
    for k in range(_HOURS):
        p.tick({"ev": e.where(F.col("hour") == low + k).select("event_id", "event_type")})
        now[0] += dt.timedelta(hours=1)
    p.tick()
    return p.counts.df()


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def last_heartbeat(spark, d):
    """Over the table as a stream."""
    path, name = f"{Storage(spark).folder}/heartbeat", f"heartbeat_{uuid.uuid4().hex}"
    events = t(spark, d, "events").select("user_id", "ts")
    seen = batches.last_seen(spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("user_id", "ts"), "user_id", "ts")
    latest: list[DataFrame] = []
    seen.writeStream.outputMode("complete").foreachBatch(lambda df, n: latest.append(Storage(spark).write(df, name))).trigger(availableNow=True).option("checkpointLocation", path).start().awaitTermination()
    return latest[-1] if latest else events.limit(0)


class _Mail(P.Program):
    chn = P.channel("@addr string, id long", "kind string")
    got = P.table("id long", "kind string")
    loop = P.loopback("id long")
    back = P.table("id long")

    @P.rules
    def store(p):
        p.got <= p.chn.payloads()
        p.loop.async_(p.chn.where("kind = 'error'").select("id"))
        p.back <= p.loop


def _mail(spark, d) -> _Mail:
    keep = lambda name, df: (df.where("kind <> 'view'"), None)
    p = _Mail(spark, address="here", channel_filter=keep)
    e = t(spark, d, "events")
    p.insert("chn", e.select(F.when(F.col("value") > 100, "here").otherwise("there"), "event_id", "event_type"))
    p.run()
    return p


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE value > 100 AND event_type <> 'view'")
def channel_filter(spark, d):
    return _mail(spark, d).got.df()


@query("SELECT event_id AS id FROM events WHERE value > 100 AND event_type = 'error'")
def loopback_count(spark, d):
    return _mail(spark, d).back.df()


class _Ask(P.Program):
    """Requests are joined with what is held, and answers go back to who asked."""

    known = P.table("k int", "name string")
    request = P.channel("@addr string, id long, sender string", "k int")
    response = P.channel("@addr string, id long", "name string")
    got = P.table("id long", "name string")

    @P.rules
    def answer(p):
        p.response.async_((p.request * p.known).pairs({"k": "k"}, L["sender"], L["id"], R["name"]))
        p.got <= p.response.payloads()


@query("SELECT c_custkey AS id, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def request_response(spark, d):
    p = _Ask(spark, address="here")
    p.tick({"known": t(spark, d, "nation").select("n_nationkey", "n_name")})
    p.insert("request", t(spark, d, "customer").select(F.lit("here"), F.col("c_custkey").cast("long"), F.lit("here"), F.col("c_nationkey").cast("int")))
    p.run()
    return p.got.df()


class _Queue(P.Program):
    """One row leaves in each step: the least."""

    waiting = P.table("k long, v string")
    head = P.scratch("k long, v string")
    served = P.table("k long, v string, step long")

    @P.rules
    def serve(p):
        p.head <= p.waiting.argmin([], "k")
        p.waiting.delete_(p.head)
        p.served <= p.head.apply(lambda df: df.withColumn("step", F.lit(p.step).cast("long")), True)


@query("SELECT CAST(r_regionkey AS bigint) AS k, r_name AS v, row_number() OVER (ORDER BY r_regionkey) - 1 AS step FROM region")
def queue_serial(spark, d):
    p = _Queue(spark)
    rows = t(spark, d, "region").select("r_regionkey", "r_name")
    p.tick({"waiting": rows})
    for _ in range(rows.count() - 1):
        p.tick()
    return p.served.df()


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    return batches.tumbling(t(spark, d, "events"), "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n")).select("start", "event_type", "n")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 hours, ts), time_bucket(INTERVAL 12 hours, ts) - INTERVAL 12 hours]) AS start FROM events) GROUP BY 1, 2")
def window_sliding(spark, d):
    return batches.sliding(t(spark, d, "events"), "ts", "1 day", "12 hours", ["event_type"], F.count(F.lit(1)).alias("n")).select("start", "event_type", "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 hours THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s""")
def window_sessions(spark, d):
    return batches.sessions(t(spark, d, "events"), "ts", "6 hours", ["user_id"], F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


# --- declarations, callbacks and host calls ----------------------------------------------------------------------------------------


class _Temp(P.Program):
    """A temporary relation, joined with a table; a bootstrap; a rule whose rows are literal; a read-only view and a lookup with a cell."""

    nation = P.scratch("k long, region long")
    start = P.table("region long", "name string")
    top = P.lmax("long")
    view = P.coll_expr(lambda: [(0, "zero"), (1, "one"), (2, "two")], "region long", "word string")
    named = P.scratch("k long, name string, word string, top long")
    fixed = P.scratch("k long, name string")

    @P.bootstrap
    def begin(p):
        p.start.insert([(k, f"region {k}") for k in range(5)])

    @P.rules
    def relate(p):
        even = p.temp("even", p.nation.where(F.col("k") % 2 == 0))
        p.top <= p.nation.select("k")
        both = (even * p.start).pairs({"region": "region"}, L["k"], L["region"], R["name"])
        word = both.lookup(p.view, {"region": "region"}, L["k"].alias("k"), L["name"].alias("name"), R["word"].alias("word"))
        p.named <= word.with_cell(p.top, "top", True)
        p.fixed <= [(1, "literal"), (2, "rows")]
        p.fixed <= p.named.select("k", "name")


def _temp(spark, d) -> _Temp:
    p = _Temp(spark)
    p.tick({"nation": t(spark, d, "nation").select("n_nationkey", "n_regionkey")})
    return p


@query("""SELECT CAST(n_nationkey AS bigint) AS k, 'region ' || n_regionkey AS name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS word,
(SELECT CAST(max(n_nationkey) AS bigint) FROM nation) AS top FROM nation WHERE n_nationkey % 2 = 0""")
def temp_bootstrap_lookup(spark, d):
    return _temp(spark, d).named.df()


@query("SELECT CAST(n_nationkey AS bigint) AS k, 'region ' || n_regionkey AS name FROM nation WHERE n_nationkey % 2 = 0 UNION VALUES (1, 'literal'), (2, 'rows')")
def literal_rows(spark, d):
    return _temp(spark, d).fixed.df()


class _Lines(P.Program):
    words = P.table("lineno long, word string")

    @P.rules
    def split(p):
        p.words <= p.text.flat_map(words(F.col("text")), "lineno", "word", name="word")


@query("""SELECT CAST(row_number() OVER (ORDER BY line) - 1 AS bigint) AS lineno, unnest(string_split(line, ' ')) AS word
FROM (SELECT 'nation ' || n_nationkey || ' is ' || n_name AS line FROM nation) WHERE line <> ''""")
def file_reader_words(spark, d):
    """A text file as numbered lines, read in the first step, and its words."""
    folder = f"{Storage(spark).folder}/lines"
    line = F.concat(F.lit("nation "), "n_nationkey", F.lit(" is "), "n_name").alias("line")
    t(spark, d, "nation").select(line).orderBy("line").coalesce(1).write.text(folder)
    lines = type("Lines", (_Lines,), {"text": P.file_reader(f"{folder}/*.txt")})(spark)
    lines.tick()
    lines.tick()
    return lines.words.df()


@query("SELECT CAST(o_orderkey AS bigint) AS k, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'P'")
def durable_reload(spark, d):
    """A durable table written by one program, changed by a second one after it, and read by a third."""
    path = f"{Storage(spark).folder}/kept"

    class Store(P.Program):
        kept = P.durable(path, "k long", "v string")
        gone = P.scratch("k long, v string")

        @P.rules
        def drop(p):
            p.kept.delete_(p.gone)

    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    first, second = Store(spark), Store(spark)
    first.tick({"kept": o})
    first.stop()
    second.tick({"gone": o.where("o_orderstatus = 'P'")})
    second.tick()
    second.stop()
    third = Store(spark)
    third.tick()
    return third.kept.df()


@query("SELECT n_name AS line FROM nation WHERE n_regionkey = 1")
def terminal_echo(spark, d):
    """Lines typed in, those of one region printed."""
    out: list[str] = []

    class Echo(P.Program):
        terminal = P.terminal()
        region = P.table("name string")

        @P.rules
        def echo(p):
            p.terminal.async_(p.terminal.include(p.region, {"line": "name"}))

    p = Echo(spark, stdout=out.append)
    n = t(spark, d, "nation")
    p.tick({"region": n.where("n_regionkey = 1").select("n_name")})
    for r in n.select("n_name").collect():
        p.type_line(r[0])
    p.tick()
    return spark.createDataFrame([(x,) for x in out], "line string")


class _Account(P.Program):
    """Deposits in, balances out; one module for each region."""

    deposit = P.interface("input", "k long, amount long")
    total = P.table("k long, amount long")
    balance = P.interface("output", "k long", "sum long")

    @P.rules
    def add(p):
        p.total <= p.deposit
        p.balance <= p.total.group(["k"], sum=A.sum_("amount"))


class _Bank(P.Program):
    imports = {"a": _Account, "b": _Account}
    all_ = P.scratch("side string, k long, sum long")

    @P.rules
    def both(p):
        p.all_ <= p.a.balance.select(F.lit("a"), "k", "sum")
        p.all_ <= p.b.balance.select(F.lit("b"), "k", "sum")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS side, CAST(c_nationkey AS bigint) AS k, CAST(sum(amount) AS bigint) AS sum
FROM (SELECT DISTINCT o_orderstatus = 'F' AS o_f, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'x' END AS o_orderstatus, c_nationkey, CAST(round(o_totalprice) AS bigint) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2""")
def modules(spark, d):
    """Two instances of a module, each fed on its own."""
    rows = O.pairs(t(spark, d, "orders"), t(spark, d, "customer"), {"o_custkey": "c_custkey"}, (L["o_orderstatus"] == "F").alias("f"), R["c_nationkey"].cast("long").alias("k"), F.round(L["o_totalprice"]).cast("long").alias("amount"))
    p = _Bank(spark)
    p.tick({"a.deposit": rows.where("f").select("k", "amount"), "b.deposit": rows.where("NOT f").select("k", "amount")})
    return p.all_.df()


@query("SELECT status, count(*) AS n, CAST(min(day) AS bigint) AS first FROM (SELECT o_orderstatus AS status, o_orderkey % 3 AS day FROM orders) GROUP BY status")
def callbacks(spark, d):
    """A callback sees each step's rows; host code between steps feeds them."""
    seen: list[tuple[int, DataFrame]] = []
    p = _Ledger(spark)
    p.on("incoming", lambda df: seen.append((p.step, df)))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice").cast("long").alias("price"))
    for k in range(3):
        p.sync_do(lambda p, k=k: p.insert("incoming", o.where(F.col("id") % 3 == k)))
    rows = O.union(*(df.select("id", "status", F.lit(k).cast("long").alias("day")) for k, df in seen))
    return O.group_as(rows, ["status"], is_set=True, n=A.count(), first=A.min_("day"))


@query("SELECT c_custkey AS id, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey <= 5")
def sync_callbacks(spark, d):
    """Requests one at a time, each with its answer, in a program that runs in the background."""
    p = _Ask(spark, address="here")
    p.run_bg()
    try:
        p.sync_do(lambda p: p.insert("known", t(spark, d, "nation").select("n_nationkey", "n_name")))
        asked = t(spark, d, "customer").where("c_custkey <= 5").select("c_custkey", "c_nationkey").collect()
        found = []
        for r in asked:
            p.async_do(lambda p, r=r: p.insert("request", [("here", r[0], "here", r[1])]))
            found += [x[1:] for x in p.delta("response")]
    finally:
        p.stop()
    return spark.createDataFrame(found, "id long, name string")


@query("SELECT CAST(step AS bigint) AS step, CAST(floor(step / 2) AS bigint) AS held FROM (SELECT unnest(range(6)) AS step)")
def deferred_order(spark, d):
    """In each step a row is deleted and inserted at once: what arrives at the next step's start is there, deletes having gone first."""

    class Order(P.Program):
        n = P.table("v long")
        log = P.table("step long, held long")

        @P.rules
        def turn(p):
            p.n.delete_(p.n)
            p.n.next_(p.n.select(F.col("v") + 1))
            p.log <= p.n.apply(lambda df: df.select(F.lit(p.step).cast("long"), F.floor(F.col("v") / 2).cast("long")), True)

    p = Order(spark)
    p.insert("n", [(0,)])
    for _ in range(6):
        p.tick()
    return p.log.df()


@query("SELECT CAST(n_regionkey AS bigint) AS k, CAST(max(n_nationkey) AS bigint) AS best FROM nation GROUP BY 1")
def host_aggregate(spark, d):
    class Largest(A.HostAgg):
        def trans(self, state, value):
            return (value, A.REPLACE) if value > state else (state, A.KEEP if value == state else A.IGNORE)

    n = t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("k"), F.col("n_nationkey").cast("long").alias("v"))
    return O.group_fold(n, ["k"], "v", Largest(), "best", "long")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC) = 1")
def host_arg_aggregate(spark, d):
    class Last(A.HostAgg):
        def trans(self, state, value):
            return (state, A.KEEP) if value == state else (value, A.REPLACE) if value > state else (state, A.IGNORE)

    return O.arg_fold(t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", Last())


@query("""SELECT tick, name, n FROM (VALUES (0, 'nation', 25), (0, 'start', 0), (1, 'nation', 0), (1, 'start', 5)) x(tick, name, n) WHERE name = 'nation'
UNION ALL SELECT 0, 'named', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1, 'named', 0""")
def traced_cardinalities(spark, d):
    """What each step held, from the trace that a program leaves in files."""
    from strata import trace

    folder = f"{Storage(spark).folder}/trace"
    p = _Temp(spark, trace_folder=folder)
    p.tick({"nation": t(spark, d, "nation").select("n_nationkey", "n_regionkey")})
    p.tick()
    counts, _ = trace.load(spark, folder)
    return counts.where("table_name IN ('nation', 'named')").select(F.col("tick").cast("int").alias("tick"), F.col("table_name").alias("name"), "n")


@query("SELECT event_id AS id, event_type AS kind, 'received' AS what FROM events WHERE value > 100 UNION ALL SELECT event_id, event_type, 'sent' FROM events")
def traced_messages(spark, d):
    from strata import trace

    p = _Mail(spark, address="here", trace=True)
    e = t(spark, d, "events")
    p.insert("chn", e.select(F.when(F.col("value") > 100, "here").otherwise("there"), "event_id", "event_type"))
    p.tick()
    field = lambda k: F.get_json_object("tuple", f"$.{k}")
    found = [trace.messages(p, what).where("pred = 'chn'").select(field("id").cast("long").alias("id"), field("kind").alias("kind"), F.lit(what).alias("what")) for what in ("sent", "received")]
    return found[0].unionByName(found[1])


@query("SELECT 'a@0' AS src, 'b@0' AS dst, 'ring' AS name UNION ALL SELECT 'b@0', 'c@0', 'ring' UNION ALL SELECT 'c@0', 'a@1', 'ring' UNION ALL SELECT 'a@0', 'a@1', ''")
def space_time(spark, d):
    """A message around three programs: its edges and the order of each program's steps."""
    from strata import analysis
    from strata.streaming.network import Network

    class Node(P.Program):
        ring = P.channel("@to string, hops int")

        @P.rules
        def forward(p):
            after = {"a": "b", "b": "c", "c": "a"}[p.address]
            p.ring.async_(p.ring.where("hops < 3").select(F.lit(after), F.col("hops") + 1))

    net = Network(trace=True)
    nodes = {a: Node(spark, address=a, network=net) for a in "abc"}
    nodes["a"].deliver("ring", spark.createDataFrame([("a", 0)], "to string, hops int"))
    net.run()
    return spark.createDataFrame(analysis.space_time(net.log), "src string, dst string, name string")


@query("SELECT 'i1_INPUT' AS source, 'out' AS sink, 'A' AS label UNION ALL SELECT 'i2_INPUT', 'out', 'D'")
def label_report(spark, d):
    """Consistency labels of ways from inputs to outputs, marked by `interfaces`."""
    from strata import analysis

    class Ports(P.Program):
        i1, i2 = P.channel("@addr string, v long"), P.channel("@addr string, v long")
        stored, seen, out = P.table("v long"), P.table("v long"), P.scratch("v long")
        interfaces = {"i1": "input", "i2": "input", "out": "output"}

        @P.rules
        def body(p):
            p.stored <= p.i1.payloads()
            p.seen <= p.i2.payloads()
            p.out <= p.stored.notin(p.seen)

    found = analysis.path_report(Ports(spark))
    return spark.createDataFrame([(a, to, label) for to, of in found.items() for a, label in of.items()], "source string, sink string, label string")


@query("SELECT 'unread' AS pred, true AS input UNION ALL SELECT 'unwritten', false")
def underspecified(spark, d):
    from strata import analysis

    class Loose(P.Program):
        unread, used = P.interface("input", "v long"), P.interface("input", "v long")
        unwritten, made = P.interface("output", "v long"), P.scratch("v long")
        interfaces = {"made": "output"}

        @P.rules
        def body(p):
            p.made <= p.used

    return analysis.reflect(Loose(spark))["t_underspecified"]


@query("SELECT 'timer' AS pername, 3600.0::DOUBLE AS period")
def builtin_periodics(spark, d):
    class Seen(_Timer):
        found = P.scratch("pername string, period double")

        @P.rules
        def look(p):
            p.found <= p.periodics_tbl

    p = Seen(spark)
    p.tick()
    return p.found.df()


@query("SELECT 'n' || n_nationkey AS name, n_name AS value FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'late', 'node'")
def watched_folder(spark, d):
    """A folder's files as a collection that follows it."""
    folder = f"{Storage(spark).folder}/watched"
    nodes = t(spark, d, "nation").where("n_regionkey = 0").select(F.concat(F.lit("n"), "n_nationkey"), "n_name").collect()

    class Mirror(P.Program):
        nodes = P.watched(folder)
        seen = P.scratch("name string, value string")

        @P.rules
        def mirror(p):
            p.seen <= p.nodes

    def put(name, value):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(value.encode()))
        out.close()

    p = Mirror(spark)
    p.tick()
    for name, value in nodes:
        put(name, value)
    p.tick()
    put("late", "node")
    p.tick()
    return p.seen.df()


@query("""SELECT 'cheap' AS what, CAST(p_partkey AS bigint) AS k FROM part WHERE p_size = 1 UNION ALL SELECT 'first', CAST(p_partkey AS bigint) FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 3)
UNION ALL SELECT 'other', CAST(r_regionkey AS bigint) FROM region WHERE NOT r_regionkey > 2""")
def conditional_rules(spark, d):
    """A right side that depends on whether another collection has rows; the first rows; rejected rows."""
    from strata.plans.rel import either

    class Choose(P.Program):
        part = P.scratch("k long", "size int")
        region = P.scratch("k long")
        nothing = P.scratch("k long")
        out = P.scratch("what string, k long")

        @P.rules
        def choose(p):
            small = p.part.where("size = 1").select(F.lit("cheap"), "k")
            p.out <= either(p.region, small, p.region.select(F.lit("wrong"), "k"))
            p.out <= either(p.nothing, p.part.select(F.lit("wrong"), "k"), p.region.reject(F.col("k") > 2).select(F.lit("other"), "k"))
            p.out <= p.part.first(3, "k").select(F.lit("first"), "k")

    p = Choose(spark)
    p.tick({"part": t(spark, d, "part").select("p_partkey", "p_size"), "region": t(spark, d, "region").select("r_regionkey")})
    return p.out.df()


@query("SELECT CAST(n_nationkey AS bigint) AS k, true AS unit, 32 AS digits, (SELECT count(DISTINCT n_nationkey) FROM nation) AS ids FROM nation")
def random_and_ids(spark, d):
    from strata.functions.scalars import id_of, random_of

    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), random_of("n_nationkey").alias("r"), id_of("n_nationkey").alias("i"))
    ids = n.select("i").distinct().agg(F.count(F.lit(1)).alias("ids"))  # one row
    return n.crossJoin(ids).select("k", ((F.col("r") >= 0) & (F.col("r") < 1)).alias("unit"), F.length("i").alias("digits"), "ids")


# --- analysis ----------------------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e(lhs, body, neg, temporal) AS (VALUES ('hi', 'ev', false, false), ('users', 'ev', false, false), ('nums', 'ev', false, false), ('left', 'ev', true, false),
('right', 'ev', true, false), ('best', 'ev', false, false), ('other', 'ev', false, false), ('n_users', 'users', false, false), ('pos', 'nums', false, false), ('bag_sum', 'left', false, false),
('bag_sum', 'right', false, false), ('bag_both', 'left', false, false), ('bag_both', 'right', false, false), ('bag_any', 'left', false, false), ('bag_any', 'right', false, false), ('common', 'best', false, false), ('common', 'other', false, false),
('per_mod', 'users', false, false), ('quorum', 'users', false, false)), tc AS (SELECT lhs, body, body AS via, neg, temporal FROM e
UNION SELECT e.lhs, tc.body, e.body, e.neg OR tc.neg, e.temporal OR tc.temporal FROM e JOIN tc ON e.body = tc.lhs) SELECT * FROM tc""")
def dep_tc(spark, d):
    from strata import analysis

    p = _Cells(spark)
    return analysis.dependency_closure(spark.createDataFrame([(x.rule, x.lhs, x.op, x.body, x.nm) for x in p.depends()], analysis.DEPENDS), p.storage)


@query("""SELECT predicate, CAST(CASE WHEN predicate IN ('fresh', 'log') THEN 1 ELSE 0 END AS bigint) AS stratum
FROM (VALUES ('incoming'), ('latest'), ('total'), ('gone'), ('seen'), ('fresh'), ('log'), ('halt')) x(predicate)""")
def strata(spark, d):
    from strata import analysis

    return analysis.reflect(_Ledger(spark))["t_stratum"]


@query("""WITH RECURSIVE e(body, head, tag, op) AS (VALUES ('chn', 'got', 'M', '<='), ('chn', 'loop', 'A', '<~'), ('loop', 'back', 'M', '<=')),
p AS (SELECT body AS "from", head AS "to", [body, head] AS path, tag, op AS lastop FROM e
UNION SELECT p."from", e.head, list_append(p.path, e.head), least(p.tag, e.tag), e.op FROM p JOIN e ON p."to" = e.body WHERE NOT list_contains(p.path, e.head))
SELECT *, CAST(len(path) AS integer) AS len FROM p""")
def path_labels(spark, d):
    from strata import analysis

    p = _Mail(spark)
    depends = spark.createDataFrame([(x.rule, x.lhs, x.op, x.body, x.nm) for x in p.depends()], analysis.DEPENDS)
    return analysis.path_tags(spark, depends, p.storage)

