"""Relational operators on literal tuples."""

import pytest
from pyspark.sql import functions as F

from strata.errors import CompileError, TypeMismatchError
from strata.functions import aggs as A
from strata.operators import relational as O
from strata.operators.relational import L, R, S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def xy(spark):
    make = lambda *r: spark.createDataFrame(list(r), "x string, y1 int")
    return (
        make(("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2)),
        make(("a", 1), ("b", 2), ("c", 1), ("c", 2)),
        make(("a", 1), ("z", 1)),
        make(("a", 1), ("v", 1), ("z", 1)),
    )


def test_joins(spark, xy):
    r, s, t, mis = xy
    two = lambda p: rows(O.pairs(r, s, p, L["x"], L["y1"], R["y1"]))
    assert len(two({"x": "x"})) == 7 and len(two({"x": "x", "y1": "y1"})) == 4
    assert rows(O.combos([r, s, t], [((0, "x"), (1, "x")), ((1, "x"), (2, "x"))], S(0)["x"], S(1)["y1"], S(2)["y1"])) == [("a", 1, 1)]
    assert rows(O.matches([r, s, t], S(0)["x"])) == [("a",)]
    assert rows(O.outer(mis, r, {"x": "x"}, L["x"], R["x"], L["y1"], R["y1"])) == [("a", "a", 1, 1), ("v", None, 1, None), ("z", None, 1, None)]
    assert rows(O.pairs(t, s, {"x": "x"})) == [((("a"), 1), ("a", 1))]
    assert rows(O.outer(t, s, {"x": "x"}))[1] == (("z", 1), None)
    assert rows(O.lefts(r, t, {"x": "x"})) == [("a", 1)] and rows(O.rights(r, t, {"x": "x"})) == [("a", 1)]
    assert O.flatten([t, t], {"x": "x"}).columns == ["x", "y1", "x_1", "y1_1"]
    assert O.flatten([t, t]).count() == 4
    assert rows(O.combos([r, s], [["x", "x"]], L["x"]))[0] == ("a",)


def test_nulls_match(spark):
    d = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    assert rows(O.pairs(d, d, {"k": "k"}, L["v"], R["v"])) == [(1, 1), (2, 2)]
    assert rows(O.notin(d, d.where("v = 1"), {"k": "k"})) == [(2, 2)]
    assert rows(O.group_as(d.union(d), ["k"], n=A.count("v"))) == [(2, 1), (None, 1)]


@pytest.mark.parametrize("preds", [[("x", (1, "x"))], {"x": "nope"}, [((0, "x"), (0, "y1"))], {"x": 3}, [((7, "x"), (0, "x"))]])
def test_bad_predicates(xy, preds):
    with pytest.raises(CompileError):
        O.pairs(xy[0], xy[1], preds)


def test_more_bad_joins(xy):
    r, s, t, _ = xy
    with pytest.raises(CompileError):
        O.combos([r, s, t], {"x": "x"})  # which x?
    with pytest.raises(CompileError):
        O.combos([r, s, t], {(0, "x"): (1, "x")}, how="left")
    with pytest.raises(CompileError):
        O.combos([r, s, t], [((0, "x"), (1, "x"))], strict=True)


def test_antijoins(spark):
    emp = spark.createDataFrame([("bob", 1), ("betsy", 1), ("caitlin", 0)], "key string, val int")
    mgrs = emp.where("val > 0").select(F.col("key").alias("name"))
    assert rows(O.notin(emp, mgrs, {"key": "name"}).select("key")) == [("caitlin",)]
    assert rows(O.notin(emp, mgrs, theta=L["key"] == R["name"]).select("key")) == [("caitlin",)]
    assert rows(O.notin(emp, mgrs, {"key": "name"}, L["key"] == "bob").select("key")) == [("betsy",), ("caitlin",)]
    foo = spark.createDataFrame([("alex", 1), ("joe", 2), ("jonathan", 3)], "c1 string, c2 int")
    bar = spark.createDataFrame([("joe", 0), ("joe", 1), ("alex", 1)], "c1 string, c2 int")
    assert rows(O.notin(foo, bar, {"c1": "c1"}, L["c2"] <= R["c2"])) == [("joe", 2), ("jonathan", 3)]
    foo = spark.createDataFrame([("alex", 1), ("jonathan", 2), ("jonathan", 3)], "c1 string, c2 int")
    bar = spark.createDataFrame([("jonathan", 2), ("alex", 1)], "c3 string, c4 int")
    assert rows(O.notin(foo, bar)) == [("jonathan", 3)]
    assert rows(O.notin(foo, bar, {"c1": "c3"})) == []
    assert rows(O.notin(foo, bar, {"c2": "c4"})) == [("jonathan", 3)]
    one = spark.createDataFrame([(5, 10), (10, 10), (12, 11)], "ident int, foo int")
    assert rows(O.notin(one, one, {"foo": "ident"})) == [(12, 11), (5, 10)][:1] or rows(O.notin(one, one, {"foo": "ident"})) == [(12, 11)]


def test_groups(spark):
    s1 = spark.createDataFrame([(1, True), (1, False), (2, False), (3, True)], "x int, v boolean")
    assert rows(O.group(s1, None, A.bool_and("v"), A.bool_or("v"))) == [(False, True)]
    assert rows(O.group(s1, ["x"], A.bool_and("v"), A.bool_or("v"))) == [(1, False, True), (2, False, False), (3, True, True)]
    assert O.group(s1, ["x"], A.bool_and("v"), A.count()).columns == ["x", "booleanand_0", "count_1"]
    assert rows(O.group(s1.limit(0), None, A.count(), A.sum_("x"))) == []
    assert rows(O.group(s1, ["x"])) == [(1,), (2,), (3,)]
    kv = spark.createDataFrame([(6, 6), (5, 7), (4, 8), (0, 1)], "key int, val int")
    assert rows(O.group(kv.select((F.col("key") + F.col("val")).alias("s")), None, A.sum_("s"))) == [(13,)]
    assert rows(O.group(spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "k int, v int"), None, A.sum_("v"), A.avg("v"))) == [(21, 7.0)]
    p = spark.createDataFrame([(9, 3, 4), (9, 4, 3), (8, 1, 2), (7, 8, 9)], "v1 int, v2 int, v3 int")
    assert [(r[0], [tuple(x) for x in r[1]]) for r in sorted(O.group(p, ["v1"], A.accum_pair("v2", "v3")).collect())] == [(7, [(8, 9)]), (8, [(1, 2)]), (9, [(3, 4), (4, 3)])]
    n = spark.createDataFrame([(1, None), (1, "b"), (1, "a"), (1, None)], "k int, v string")
    assert rows(O.group(n, ["k"], A.accum("v"), A.choose("v"))) == [(1, [None, "a", "b"], "a")] or rows(O.group(n, ["k"], A.accum("v")))[0][1].count(None) == 1
    assert rows(O.group(p, ["v1"], A.folded("join", F.lit(""), lambda a, x: F.concat(a, x.cast("string")), "v2"))) == [(7, "8"), (8, "1"), (9, "34")]
    assert rows(O.group(p, None, A.choose_rand("v1", 3)))[0][0] in (7, 8, 9)


def test_argaggs(spark):
    t = spark.createDataFrame([(1, 2, 4), (1, 3, 5), (5, 5, 5)], "a int, b int, c int")
    assert rows(O.argmin(t, None, "a")) == [(1, 2, 4), (1, 3, 5)]
    assert rows(O.argmin(O.argmin(t, [], "a"), [], "b")) == [(1, 2, 4)]
    assert rows(O.argagg(t, "choose", ["a"], "b")) == [(1, 2, 4), (5, 5, 5)]
    assert len(rows(O.argagg(t, "choose_rand", ["a"], "b", seed=1))) == 2
    b = t.withColumn("ok", F.col("b") > 2)
    assert rows(O.argagg(b, "bool_and", ["a"], "ok")) == [(1, 2, 4, False), (5, 5, 5, True)]
    assert rows(O.argagg(b, "bool_or", ["a"], "ok")) == [(1, 3, 5, True), (5, 5, 5, True)]
    with pytest.raises(CompileError):
        O.argagg(t, "sum", ["a"], "b")
    arrays = spark.createDataFrame([([1, 9],), ([1, 2],), ([2],)], "x array<int>")
    assert rows(O.argmin(arrays, None, "x")) == [([1, 2],)]


def test_reduce(spark):
    t = spark.createDataFrame([(False, 3), (True, 4)], "v boolean, x int")
    step, merge = (lambda m, r: [(m[0][0] or r["v"],)]), (lambda a, b: [(a[0][0] or b[0][0],)])
    assert rows(O.reduce(t, [(False,)], step, merge, "v boolean")) == [(True,)]
    assert rows(O.reduce(t.limit(0), [(True,)], step, merge, "v boolean")) == [(True,)]
    count = lambda m, r: {**m, r["x"]: m.get(r["x"], 0) + 1}
    assert rows(O.reduce(t.union(t), {}, count, lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}, "x int, n int")) == [(3, 2), (4, 2)]
    with pytest.raises(TypeMismatchError):
        O.reduce(t, 5, step, merge, "v boolean")


def test_order_and_text(spark):
    tab = spark.createDataFrame([(20, 20), (20, 30), (1, 5), (1, 10)], "a int, b int")
    want = [(1, 10, 1), (1, 5, 0), (20, 20, 2), (20, 30, 3)]
    assert rows(O.with_index(tab)) == want
    from strata.plans.storage import Storage

    assert rows(O.with_index(tab.repartition(4), materialise=Storage(spark).write)) == want
    assert [tuple(r) for r in O.sort(tab, F.desc("b")).collect()][0] == (20, 30)
    assert rows(O.top_k(tab, 1, "a", "b")) == [(1, 5)]
    odd = spark.createDataFrame([(1, 'a"b', None, [1, 2], True)], "a int, b string, c string, d array<int>, e boolean")
    assert rows(O.inspected(odd)) == [('[1, "a\\"b", nil, [1, 2], true]',)]
    assert rows(O.flat_map(tab, F.array("a", "b"), "item")) == [(1,), (1,), (10,), (20,), (20,), (20,), (30,), (5,)]
    assert rows(O.union(tab, tab)) == rows(tab) and rows(O.subtract(tab, tab.where("a = 1"))) == [(20, 20), (20, 30)]
    assert rows(O.null_tuple(tab)) == [(None, None)]
    assert rows(O.values(tab, ["b"])) == [(1,), (20,)]
    spans = spark.createDataFrame([("x", 1, 2), ("x", 2, 4), ("x", 6, 7), ("y", 1, 9), ("y", 2, 3)], "g string, s int, e int")
    assert rows(O.longest_runs(spans, ["g"], "s", "e")) == [("x", 1, 4), ("x", 6, 7), ("y", 1, 9)]


def test_scalars_over_relations(spark):
    t = spark.range(5).select(F.col("id").alias("k"))
    value = lambda kind, p=None: O.scalar(t, kind, p).first()[0]
    assert value("all", F.col("k") >= 0) and not value("all", F.col("k") > 0)
    assert value("any", F.col("k") == 3) and value("none", F.col("k") == 9) and value("one", F.col("k") == 1)
    assert value("member", F.col("k") == 2) and not O.scalar(t.limit(0), "any").first()[0]
    assert O.exists(t, t.limit(0)).count() == 0 and O.exists(t, t).count() == 5 and O.empty(t, t.limit(0)).count() == 5
    assert rows(O.exists(t, t, L["k"] + 3 == R["k"])) == [(0,), (1,)]
    assert O.with_length(t, t).first()["length"] == 5
