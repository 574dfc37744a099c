"""Programs: steps, keys, recursion, lattices, modules, channels, timers and the error surface, on literal tuples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata import analysis, trace
from strata.errors import CompileError, IllegalSourceError, KeyConstraintError, ShutdownWithCallbacksError, StrataError, TypeMismatchError
from strata.functions import aggs as A
from strata.operators.relational import L, R
from strata.plans import program as P
from strata.plans.stratify import Depends, stratify
from strata.streaming.network import Network


class Baby(P.Program):
    tbl = P.table("k1 string, k2 string", "v1 long, v2 long")
    scr = P.scratch("k1 string, k2 string", "v1 long, v2 long")
    scr2 = P.scratch("k1 string, k2 string")
    vals = P.scratch("v1 long, v2 long")

    @P.bootstrap
    def start(p):
        p.scr.insert([("a", "b", 1, 2), ("a", "c", 3, 4)])

    @P.rules
    def body(p):
        p.scr2 <= p.scr.keys()
        p.vals <= p.scr.values()
        p.tbl.next_(p.scr)
        p.tbl.delete_(p.tbl.where(F.col("k2") == "b"))


def test_steps_keys_and_deletes(spark):
    with Baby(spark) as p:
        p.tick()
        assert p.rows("scr2") == [("a", "b"), ("a", "c")] and p.rows("vals") == [(1, 2), (3, 4)] and p.rows("tbl") == []
        p.tick()
        assert len(p.rows("tbl")) == 2 and p.rows("scr2") == []
        p.tick()
        assert p.rows("tbl") == [("a", "c", 3, 4)] and p.step == 3


class Keyed(P.Program):
    t1 = P.table("k long", "v long")
    one = P.table("", "foo long, bar long")
    copy = P.table("k long", "v long")

    @P.rules
    def body(p):
        p.copy <= p.t1


def test_keys_conflict(spark):
    for name, rows in (("t1", [(5, 10), (5, 11)]), ("one", [(1, 1), (2, 2)])):
        p = Keyed(spark)
        p.insert(name, rows)
        with pytest.raises(KeyConstraintError):
            p.tick()
    p = Keyed(spark)
    p.tick({"t1": [(5, 10), (5, 10)], "one": [(1, 2)]})
    assert p.rows("t1") == [(5, 10)]
    p.insert("t1", [(5, 12)])
    with pytest.raises(KeyConstraintError):
        p.tick()
    p = Keyed(spark)
    p.tick({"t1": [(5, 10)]})
    p.t1.delete([(5, 11)])
    p.tick()
    assert p.rows("t1") == [(5, 10)]
    p.t1.delete([(5, 10)])
    p.tick()
    assert p.rows("t1") == [] and p.rows("copy") == [(5, 10)]  # what was derived outlives its source
    p.copy.upsert([(5, 20)])
    p.tick()
    assert p.rows("copy") == [(5, 20)]


def test_rows_are_padded_or_too_wide(spark):
    p = Keyed(spark)
    p.tick({"t1": [(7,)]})
    assert p.rows("t1") == [(7, None)]
    with pytest.raises(TypeMismatchError):
        p.insert("t1", [(1, 2, 3)])
    with pytest.raises(TypeMismatchError):
        p.insert("t1", [5])
    with pytest.raises(TypeMismatchError):
        p.insert("t1", 5)
    with pytest.raises(CompileError):
        p.t1 <= p.copy  # outside a block of rules


class Tc(P.Program):
    link = P.table("src long, dest long")
    path = P.scratch("src long, dest long")
    excl = P.table("src long")
    rest = P.scratch("src long, dest long")

    @P.rules
    def body(p):
        p.path <= p.link
        p.path <= (p.link * p.path).pairs({"dest": "src"}, L["src"], R["dest"])
        p.rest <= p.path.notin(p.excl, {"src": "src"})


def test_recursion_then_negation(spark):
    p = Tc(spark, trace=True)
    p.tick({"link": [(1, 2), (2, 3), (3, 4), (6, 7), (2, 7)], "excl": [(1,)]})
    assert p.rows("path") == [(1, 2), (1, 3), (1, 4), (1, 7), (2, 3), (2, 4), (2, 7), (3, 4), (6, 7)]
    assert p.rows("rest") == [(2, 3), (2, 4), (2, 7), (3, 4), (6, 7)]
    p.tick({"link": [(4, 1)]})  # a cycle
    assert len(p.rows("path")) == 4 * 5 + 1
    assert dict(((t, n), c) for t, n, c in trace.cardinalities(p).collect())[0, "path"] == 9
    assert trace.metrics(p)["count"] == 2


class NonLinear(Tc):
    @P.rules
    def body(p):
        path = p.path  # one scan in both places
        p.path <= p.link
        p.path <= (path * path).pairs({"dest": "src"}, L["src"], R["dest"])


def test_doubling_recursion_and_override(spark):
    p = NonLinear(spark)
    p.tick({"link": [(i, i + 1) for i in range(9)]})
    assert len(p.rows("path")) == 45 and p.rows("rest") == []


class Short(P.Program):
    link = P.table("a string, b string, c long")
    path = P.scratch("a string, b string, nxt string", "c long", {"c": "lmin"})
    best = P.scratch("a string, b string", "c long", {"c": "lmin"})

    @P.rules
    def body(p):
        p.path <= p.link.select("a", "b", "b", "c")
        p.path <= (p.link * p.path).pairs({"b": "a"}, L["a"], R["b"], L["b"], L["c"] + R["c"])
        p.best <= p.path.select("a", "b", "c")


def test_least_costs_on_a_cycle(spark):
    p = Short(spark)
    p.tick({"link": [("a", "b", 1), ("a", "b", 4), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("a", "d", 9)]})
    got = {(a, b): c for a, b, c in p.rows("best")}
    assert got["a", "b"] == 1 and got["a", "d"] == 3 and got["a", "a"] == 4 and len(got) == 16
    with pytest.raises(StrataError):
        Short(spark, max_rounds=1).tick({"link": [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)]})


def test_strata():
    d = lambda lhs, body, nm=False, op="<=", rule=0: Depends(rule, lhs, op, body, nm)
    order, strata, rules = stratify([], [d("b", "a", rule=0), d("c", "b", True, rule=1), d("d", "c", rule=2), d("a", "d", True, "<+", 3)])
    assert strata == {"a": 0, "b": 0, "c": 1, "d": 1} and rules == {0: 0, 1: 1, 2: 1, 3: 2}
    with pytest.raises(CompileError):
        stratify([], [d("path", "link"), d("path", "path", True)])
    stratify([], [d("t5", "t5"), d("t4", "t5", True)])


class Cells(P.Program):
    inp = P.scratch("which string, v long")
    hi = P.lmax()
    lo = P.lmin()
    ok = P.lbool()
    nums = P.lpset()
    names = P.lset("string")
    pairs = P.lset("a long, b long")
    bag = P.lbag("string")
    best = P.lmap("string", "long", "lmax")
    over = P.scratch("v boolean")
    total = P.scratch("v long")
    joined = P.scratch("x long, y long")
    at = P.scratch("v long")
    quorum = P.scratch("who string")

    @P.rules
    def body(p):
        p.hi <= p.inp.select("v")
        p.lo <= p.inp.select("v")
        p.nums <= p.inp.select("v")
        p.names <= p.inp.select("which")
        p.pairs <= p.inp.select("v", F.col("v") + 1)
        p.bag <= p.inp.select("which", "v")
        p.best <= p.inp.select("which", "v")
        p.over <= p.hi.gt(12)
        p.ok <= p.hi.gt(12)
        p.total <= p.nums.pos_sum()
        p.joined <= p.pairs.eqjoin(p.pairs, {"b": "a"}, L["a"], R["b"])
        p.at <= p.best.at("q", 0)
        p.quorum <= p.ok.when_true(p.names.select("elem"))


def test_lattice_cells(spark):
    p = Cells(spark)
    p.tick({"inp": [("x", 5), ("x", 10)]})
    assert p.rows("hi") == [(10,)] and p.rows("lo") == [(5,)] and p.rows("over") == [(False,)] and p.rows("quorum") == [] and p.rows("at") == [(0,)]
    p.tick({"inp": [("q", 13), ("x", 6), ("y", 5)]})
    assert p.rows("hi") == [(13,)] and p.rows("over") == [(True,)] and p.rows("total") == [(34,)]
    assert p.rows("best") == [("q", 13), ("x", 10), ("y", 5)] and p.rows("bag") == p.rows("best") and p.rows("at") == [(13,)]
    assert p.rows("joined") == [(5, 7)] and p.rows("quorum") == [("q",), ("x",), ("y",)]
    p.insert("nums", [(-1,)])
    with pytest.raises(TypeMismatchError):
        p.tick()
    with pytest.raises(TypeMismatchError):
        P.Schema.of("k long", "v long", {"k": P.lat.lmax})


class Adder(P.Program):
    inp = P.interface("input", "v long")
    out = P.interface("output", "v long")

    @P.rules
    def add(p):
        p.out <= p.inp.select(F.col("v") + 1)


class Twice(P.Program):
    imports = {"first": Adder, "second": Adder}
    inp = P.interface("input", "v long")
    out = P.interface("output", "v long")
    unused = P.interface("output", "v long")

    @P.rules
    def wire(p):
        p.first.inp <= p.inp
        p.second.inp <= p.first.out
        p.out <= p.second.out


def test_modules_callbacks_and_interfaces(spark):
    p, seen = Twice(spark), []
    number = p.on("out", lambda df: seen.append(df.collect()))
    assert p.sync_callback("inp", [(5,)], "out") == [(7,)]
    p.off(number)
    p.tick({"inp": [(1,)]})
    assert len(seen) == 1 and p.underspecified() == [("unused", False)]
    r = analysis.reflect(p)
    assert {x.pred for x in r["t_underspecified"].collect()} == {"unused"} and r["t_rules"].count() == 5
    p.stop()
    with pytest.raises(IllegalSourceError):
        p.tick()
    with pytest.raises(ShutdownWithCallbacksError):
        p.delta("out")


class Timed(P.Program):
    tik = P.periodic(10)
    log = P.table("at timestamp")
    term = P.terminal()
    clock_row = P.scratch("step long")
    halt = P.scratch("command string")

    @P.rules
    def body(p):
        p.log <= p.tik.select("val")
        p.term.async_(p.term.select(F.upper("line")))
        p.clock_row <= p.at_step(lambda q: [(q.step,)], "step long")
        p.halt <= p.term.where("line = 'stop'").select(F.lit("kill"))


def test_timers_terminal_and_halt(spark):
    now, out = [dt.datetime(2024, 1, 1)], []
    p = Timed(spark, clock=lambda: now[0], stdout=out.append)
    p.tick()
    assert p.rows("log") == [] and p.rows("clock_row") == [(0,)]
    now[0] += dt.timedelta(seconds=11)
    p.type_line("hello")
    p.tick()
    assert len(p.rows("log")) == 1 and out == ["HELLO"] and p.rows("clock_row") == [(1,)]
    p.type_line("stop")
    p.run()
    assert p.stopped
    with pytest.raises(CompileError):
        p.now()


class Agent(P.Program):
    chn = P.channel("@addr string, k long", "v string")
    got = P.table("k long", "v string")

    @P.rules
    def body(p):
        p.got <= p.chn.payloads()
        p.chn.async_(p.chn.where(F.col("v") == "ping").select(F.lit("b"), "k", F.lit("pong")))


def test_channels(spark):
    net = Network()
    a, b = Agent(spark, address="a", network=net), Agent(spark, address="b", network=net)
    b.insert("chn", [("a", 1, "ping"), ("nowhere", 2, "lost")])
    net.run()
    assert a.rows("got") == [(1, "ping")] and b.rows("got") == [(1, "pong")]
    a.deliver("chn", spark.createDataFrame([("a", 3, "x"), ("a", 3, "y")], "addr string, k long, v string"))
    with pytest.raises(KeyConstraintError):
        a.tick()


def test_channel_filter_postpones(spark):
    rule = lambda name, df: (df.where("k < 10"), df.where("k >= 10 AND k < 20").withColumn("k", F.col("k") - 10))
    p = Agent(spark, address="a", channel_filter=rule)
    p.insert("chn", [("a", 1, "now"), ("a", 12, "later"), ("a", 30, "never")])
    p.tick()
    assert p.rows("got") == [(1, "now")]
    p.run()
    assert p.rows("got") == [(1, "now"), (2, "later")]


def test_declarations_are_checked(spark):
    for make in (
        lambda: P.Schema.of("a long, a long"),
        lambda: P.Schema.of("@a long"),
        lambda: P.channel("a string").schema(),
        lambda: P.channel("@a string, @b string").schema(),
        lambda: P.Schema.of("keys long"),
        lambda: P.interface("sideways", "a long"),
        lambda: type("Two", (P.Program,), {"a": P.terminal(), "b": P.terminal()})(spark),
    ):
        with pytest.raises(CompileError):
            make()
    assert P.Schema.of().cols == ["key", "val"] and P.Schema.of("a, b array<int>").cols == ["a", "b"]

    def bad(op, **decls):
        def body(p):
            getattr(p.lhs, op)(p.src) if op != "<=" else p.lhs <= p.src

        return lambda: type("Bad", (P.Program,), {"src": P.table("v string"), "body": P.rules(body), **decls})(spark)

    for op, decl in (("<=", P.channel()), ("next_", P.channel()), ("async_", P.table("v string")), ("<=", P.periodic(1)), ("delete_", P.scratch("v string")), ("upsert_", P.lset()), ("<=", P.terminal()), ("<=", P.readonly("v string"))):
        with pytest.raises(CompileError):
            bad(op, lhs=decl)()


class Temp(P.Program):
    src = P.table("a long, b string")
    out = P.table("b string, n long")

    @P.rules
    def body(p):
        t = p.temp("t", p.src.select("b", "a"))
        u = p.temp("u", t.where("a > 1"))
        p.out.next_(u.group(["b"], n=A.count()))


def test_temps_files_and_expressions(spark, tmp_path):
    p = Temp(spark)
    p.tick({"src": [(1, "x"), (2, "x"), (3, "y")]})
    assert p.rows("u") == [("x", 2), ("y", 3)] and p.rows("out") == []
    p.tick()
    assert p.rows("out") == [("x", 1), ("y", 1)]
    (tmp_path / "f.txt").write_text("one \ntwo Words\n\nlast")
    Files = type("Files", (P.Program,), {"text": P.file_reader(f"file://{tmp_path}/f.txt"), "made": P.coll_expr(lambda: [(1, "hi")], "a long, b string")})
    q = Files(spark)
    q.tick()
    assert q.rows("text") == [(0, "one"), (1, "two Words"), (2, ""), (3, "last")] and q.rows("made") == [(1, "hi")]
    q.tick()
    assert q.rows("text") == []


def test_durable_tables_outlive_programs(spark, tmp_path):
    Disk = type("Disk", (P.Program,), {"t1": P.durable(f"file://{tmp_path}/t", "k long", "v long")})
    with Disk(spark) as p:
        p.tick({"t1": [(1, 2), (3, 4)]})
        p.t1.delete([(1, 2)])
        p.tick()
    with Disk(spark) as p:
        p.tick({"t1": [(5, 6)]})
        assert p.rows("t1") == [(3, 4), (5, 6)]
        with pytest.raises(CompileError):
            p.t1.upsert([(5, 7)])


def test_rules_come_and_go(spark):
    from strata.repl import Repl

    out = []
    r = Repl(spark, out.append)
    for line in ('link = table("a long, b long")', 'path = scratch("a long, b long")', "path <= link", 'path <= (link * path).pairs({"b": "a"}, L["a"], R["b"])', "/lsrules", "nonsense <= link"):
        r.onecmd(line)
    r.program.insert("link", [(1, 2), (2, 3)])
    for line in ("/tick", "/dump path", "/rmrule 1", "/tick", "/explain", "/dot", "/lscollections", "/help", "/break path", "/run"):
        r.onecmd(line)
    assert "(1, 3)" in out and any("NameError" in x for x in out) and r.program.rows("path") == [(1, 2), (2, 3)]
    assert any(x.startswith("digraph") for x in out)


class Log(P.Program):
    """Stored votes, merged asynchronously and counted: order-sensitive."""

    i1 = P.channel("@addr string, v long")
    i2 = P.channel("@addr string, v long")
    stored = P.table("v long")
    seen = P.scratch("v long")
    response = P.interface("output", "v long")
    interfaces = {"i1": "input", "i2": "input"}

    @P.rules
    def body(p):
        p.stored <= p.i1.payloads()
        p.seen <= p.i2.payloads()
        p.response <= p.stored.notin(p.seen)


class Mono(Log):
    @P.rules
    def body(p):
        p.stored <= p.i1.payloads()
        p.seen <= p.i2.payloads()
        p.stored <= p.seen
        p.response <= p.stored


def test_labels(spark):
    assert analysis.output_report(Log(spark)) == {"response": "D"}
    # Stored state on one way alone doesn't guard the race.
    assert ("i1", "i2", "response", False) in analysis.channel_races(Log(spark))
    assert ("i1", "i2", "stored", True) in analysis.channel_races(Mono(spark))
    assert analysis.output_report(Mono(spark)) == {"response": "A"}
    assert analysis.path_report(Mono(spark)) == {"response": {"i1_INPUT": "A", "i2_INPUT": "A"}}
    M, N, A, D = (analysis.Label(i) for i in range(4))
    assert A.then(N) == D and N.then(A) == A and N.then(A).then(N) == D and D.then(M) == D and analysis.joined([A, N]) == D and analysis.joined([]) == M
    assert all(x.then(y).then(z) == x.then(z) if not y else True for x in (M, N, A, D) for y in (M, N, A, D) for z in (M, N, A, D))
    assert [(a, b, x.letter, why) for a, b, _, x, why in analysis.flows(Mono(spark))] == [("i1_INPUT", "response", "A", "way"), ("i2_INPUT", "response", "A", "way")]


class Guards(P.Program):
    i1, i2, response = P.interface("input"), P.interface("input"), P.interface("output")
    c1, c2 = P.channel("@addr string, val string"), P.channel("@addr string, val string")
    guard1, guard2 = P.table("addr string, val string"), P.table("addr string, val string")

    @P.rules
    def basic(p):
        p.c1.async_(p.i1)
        p.c2.async_(p.i2)
        p.guard1 <= p.c1
        p.guard2 <= p.c2


class GuardsNotIn(Guards):
    @P.rules
    def answer(p):
        p.response <= p.guard1.notin(p.guard2, {"val": "val"})


class GuardsGroup(Guards):
    @P.rules
    def answer(p):
        p.response <= p.guard1.group(["val"], A.count())


class GuardsJoin(Guards):
    @P.rules
    def answer(p):
        p.response <= (p.guard1 * p.guard2).lefts({"val": "val"})


class GuardsDelete(GuardsJoin):
    dguard, c3 = P.interface("input"), P.channel("@addr string, val string")

    @P.rules
    def delete(p):
        p.c3.async_(p.dguard)
        p.guard2.delete_((p.guard2 * p.c3).lefts({"val": "val"}))


class Sides(P.Program):
    lchan, rchan = P.channel("@addr string, val string"), P.channel("@addr string, val string")
    ls, rs, result = P.scratch("addr string, val string"), P.scratch("addr string, val string"), P.interface("output", "addr string, val string")
    lt, rt = P.table("addr string, val string"), P.table("addr string, val string")
    use = ("ls", "rs")

    @P.rules
    def body(p):
        p.ls <= p.lchan
        p.rs <= p.rchan
        p.lt <= p.lchan
        p.rt <= p.rchan
        p.result <= (p[p.use[0]] * p[p.use[1]]).lefts({"val": "val"})


def test_consistency_labels(spark):
    assert analysis.output_report(GuardsNotIn(spark)) == {"response": "D"}
    assert analysis.path_report(GuardsNotIn(spark)) == {"response": {"i1": "A", "i2": "D"}}
    assert analysis.path_report(GuardsGroup(spark)) == {"response": {"i1": "D"}}
    assert analysis.path_report(GuardsJoin(spark)) == {"response": {"i1": "A", "i2": "A"}}
    assert analysis.path_report(GuardsDelete(spark)) == {"response": {"i1": "A", "i2": "D", "dguard": "D"}}
    for use, guarded in ((("ls", "rs"), False), (("lt", "rs"), False), (("lt", "rt"), True)):
        p = type("One", (Sides,), {"use": use})(spark)
        assert {x for x in analysis.channel_races(p) if x[2] == "result"} == {("lchan", "rchan", "result", guarded), ("rchan", "lchan", "result", guarded)}


class Sum(P.Program):
    inp = P.scratch("v long")
    limit = P.lmax()
    under = P.scratch("v long, top long")

    @P.rules
    def body(p):
        p.limit <= p.inp
        p.under <= p.inp.with_cell(p.limit, "top").where("v < top")


def test_cells_within_expressions(spark):
    p = Sum(spark, trace=True)
    p.tick({"inp": [(1,), (5,)]})
    assert p.rows("under") == [(1, 5)]
    p.tick({"inp": [(3,), (9,)]})
    assert p.rows("under") == [(3, 9)]
    assert sorted(tuple(r) for r in trace.contents(p, "under").collect()) == [(0, 1, 5), (1, 3, 9)]


def test_dependency_analysis(spark):
    p = Tc(spark)
    deps = spark.createDataFrame([(d.rule, d.lhs, d.op, d.body, d.nm) for d in p.depends()], analysis.DEPENDS)
    report = analysis.dependency_report(deps, spark.createDataFrame([("link", True), ("rest", False), ("lost", True)], "pred string, input boolean"), p.storage)
    assert {r.pred for r in report["cycle"].collect()} == {"path"}
    assert {r.pred for r in report["source"].collect()} == {"link", "lost"} and {r.pred for r in report["sink"].collect()} == {"rest"}
    assert {(r.pred, r.input) for r in report["underspecified"].collect()} == {("lost", True)}
    tags = analysis.path_tags(spark, deps, p.storage)
    assert {(r["from"], r.to, r.tag) for r in tags.collect()} >= {("link", "path", "M"), ("link", "rest", "N"), ("excl", "rest", "N")}
    found = analysis.divergence_report(analysis.labelled_paths(deps, p.storage), spark.createDataFrame([("link",), ("excl",)], "pred string"))
    assert {(r["from"], r.to, r.tag) for r in found["first"].collect()} >= {("link", "path", "M"), ("link", "rest", "N"), ("excl", "rest", "N")}
    assert found["turning_points"].count() == 0 and ("link", "path", "M") in {(r["from"], r.to, r.tag) for r in found["uniform"].collect()}
    far = spark.createDataFrame([(0, "b", "<~", "a", False), (1, "c", "<=", "b", False), (2, "d", "<=", "c", True), (3, "e", "<=", "d", False)], analysis.DEPENDS)
    found = analysis.divergence_report(analysis.labelled_paths(far, p.storage), spark.createDataFrame([("a",)], "pred string"))
    assert [(r["from"], r.up_to, r.path) for r in found["turning_points"].collect()] == [("a", ["a", "b"], ["a", "b", "c", "d"])]
    assert [r.path for r in found["first"].where("tag = 'D'").collect()] == [["a", "b", "c", "d"]]
    bounds = analysis.tag_bounds()
    assert bounds["M", "A"] == "A" and bounds["A", "N"] == "D" and bounds["N", "A"] == "A" and bounds["D", "M"] == "D"
    assert "digraph" in analysis.dot(p) and 'label="stratum 0"' in analysis.dot(p) and "stratum" in p.explain()
    assert ("a@1", "b@2", "m") in analysis.space_time([("a", 1, "m", "b", 2), ("a", 3, "m", "b", 4)])


def test_streams_drive_programs(spark, tmp_path):
    from strata.streaming import batches

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    class Seen(P.Program):
        inp = P.scratch("id long")
        seen = P.table("id long")

        @P.rules
        def body(p):
            p.seen <= p.inp

    p = Seen(spark)
    for q in batches.drive(p, {"inp": stream().select("event_id")}, f"file://{tmp_path}/cp"):
        q.awaitTermination()
    assert len(p.rows("seen")) == events.count() and p.step == 3
    daily = batches.tumbling(stream(), "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), late="2 days")
    q = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp2").start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from daily").first()[0] == events.count()
