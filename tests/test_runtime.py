"""Threads, streams, snapshots, growth of tables, local recursion, and plans that must not end in one task."""

import os
import random
import signal
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from strata import trace
from strata.errors import KeyConstraintError
from strata.functions import aggs as A
from strata.operators import relational as O
from strata.operators.relational import L, R
from strata.plans import fixpoint
from strata.plans import program as P
from strata.plans.storage import Storage
from strata.sources.text import numbered_lines
from strata.streaming import batches
from strata.streaming.network import Network


def tasks_of(spark, run):
    """The numbers of tasks of the stages that run() takes."""
    group, tracker = uuid.uuid4().hex, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "test")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    return [info.numTasks for s in stages if (info := tracker.getStageInfo(s)) is not None]


class Kept(P.Program):
    inp = P.scratch("k long", "v long")
    kept = P.table("k long", "v long")
    best = P.lmax("long")
    later = P.table("k long")

    @P.rules
    def keep(p):
        p.kept <= p.inp
        p.best <= p.inp.select("v")
        p.later.next_(p.inp.select("k"))


# --- plans -------------------------------------------------------------------------------------------------------------------------


def test_reduce_reads_its_partitions_in_as_many_tasks(spark):
    df = spark.range(0, 4000, 1, 8).select((F.col("id") % 5).alias("k"))

    def step(memo, row):
        memo[row["k"]] = memo.get(row["k"], 0) + 1
        return memo

    def merge(a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}

    out = O.reduce(df, {}, step, merge, "k long, n long", fan_in=3)
    got = []
    tasks = tasks_of(spark, lambda: got.extend(out.collect()))
    assert max(tasks) >= 8 and {(r.k, r.n) for r in got} == {(k, 800) for k in range(5)}


def test_numbers_are_given_in_ranges(spark):
    class Numbered(P.Program):
        rows_ = P.scratch("x long")
        placed = P.scratch("x long, i long")

        @P.rules
        def number(p):
            p.placed <= p.rows_.sort("x").each_with_index()

    p = Numbered(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        xs = random.Random(1).sample(range(100_000), 5000)
        rows = spark.createDataFrame([(x,) for x in xs], "x long").repartition(8)
        tasks = tasks_of(spark, lambda: p.tick({"rows_": rows}))
        assert sorted(tasks)[-1] > 1
        assert p.placed.rows() == sorted(((x, i) for i, x in enumerate(sorted(xs))), key=repr)
        plan = p.placed.df()._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(x" not in plan  # no window over the rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_are_numbered_over_splits(spark, tmp_path, end):
    lines = [f" line {i} " + "x" * (i * 7 % 300) + " " for i in range(3000)] + ["", "last"]
    (tmp_path / "t.txt").write_bytes(end.join(lines).encode() + end.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = numbered_lines(spark, f"file://{tmp_path}/t.txt")
        got, tasks = [], []
        tasks += tasks_of(spark, lambda: got.extend(df.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.lineno, r.text) for r in got) == [(i, x.strip()) for i, x in enumerate(lines)]
    assert max(tasks) > 5


def test_host_aggregates(spark):
    class Median(A.HostAgg):
        def init(self, value):
            return [value]

        def trans(self, state, value):
            return [*state, value], A.IGNORE

        def merge(self, a, b):
            return a + b

        def final(self, state):
            return sorted(state)[len(state) // 2]


    class Two(A.HostAgg):
        """Keeps the rows of the two largest values."""

        def init(self, value):
            return [value]

        def trans(self, state, value):
            if value in state:
                return state, A.KEEP
            if len(state) < 2:
                return [*state, value], A.KEEP
            return (sorted([*state, value])[1:], (A.DELETE, [min(state)])) if value > min(state) else (state, A.IGNORE)

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(30), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    groups = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    got = {r.k: r.m for r in O.group_fold(df, ["k"], "v", Median(), "m", "long").collect()}
    assert got == {k: sorted(r[1] for r in own)[len(own) // 2] for k, own in groups.items()}
    got = sorted(tuple(r) for r in O.arg_fold(df.where("k IS NOT NULL"), ["k"], "v", Two()).collect())
    want = [r for k, own in groups.items() if k is not None for r in own if r[1] in sorted({x[1] for x in own})[-2:]]
    assert got == sorted(want)
    assert O.arg_fold(df.limit(0), ["k"], "v", Two()).count() == 0 == O.group_fold(df.limit(0), [], "v", Median(), "m", "long").count()


# --- recursion and growth --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 60, 5000])
def test_recursion_is_the_same_local_and_in_files(spark, monkeypatch, limit):
    """Rows on the driver, in files, and first the one, then the other."""
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", limit)
    rng = random.Random(3)
    edges = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(35)})
    edge = spark.createDataFrame(edges, "f long, t long")
    rounds = []
    step = lambda full, delta: {"x": [O.pairs(delta["x"], edge, {"t": "f"}, L["f"], R["t"])]}
    got = fixpoint.solve({"x": edge}, step, {"x": P.Schema(tuple(edge.schema.fields))}, Storage(spark), on_round=rounds.append)["x"]
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(rounds) > 2


def test_lattice_recursion_keeps_versions_apart(spark):
    """Improved values show in the end alone, and rules that read the whole collection see the best so far."""

    class Paths(P.Program):
        edge = P.scratch("f long, t long, c long")
        path = P.scratch("f long, t long", "c long", {"c": "lmin"})

        @P.rules
        def paths(p):
            p.path <= p.edge
            p.path <= (p.path * p.path).pairs({"t": "f"}, L["f"], R["t"], L["c"] + R["c"])

    rng = random.Random(4)
    edges = [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 50)) for _ in range(25)]
    p = Paths(spark)
    p.tick({"edge": edges})
    best = {}
    for f, t, c in edges:
        best[f, t] = min(c, best.get((f, t), c))
    for k in range(9):
        for i in range(9):
            for j in range(9):
                if (i, k) in best and (k, j) in best:
                    best[i, j] = min(best.get((i, j), 1 << 30), best[i, k] + best[k, j])
    assert {r[:2]: r[2] for r in p.path.rows()} == best


def test_a_table_grows_by_what_is_new(spark):
    p = Kept(spark)
    p.tick({"inp": [(i, i) for i in range(1000)]})
    p.tick({"inp": [(i, i) for i in range(990, 1005)]})
    assert [n for _, n in p._grown["kept"].runs] == [1000, 5] and p.kept.df().count() == 1005
    before = p.kept.df()
    p.tick({"inp": [(3, 3)]})
    assert p.contents("kept") is before  # nothing new: nothing written
    with pytest.raises(KeyConstraintError):
        p.tick({"inp": [(3, 4)]})
    q = Kept(spark)
    q.tick({"kept": [(1, 1), (2, 2)]})
    q.tick({"kept": [(3, 3)]})
    q["kept"].delete([(1, 1)])
    q.tick({"kept": [(4, 4)]})
    q["kept"].upsert([(2, 9)])
    q.tick()
    assert q.kept.rows() == [(2, 9), (3, 3), (4, 4)]


# --- threads, signals and networks -------------------------------------------------------------------------------------------------


def test_background_steps(spark):
    p = Kept(spark)
    p.run_bg(idle=0.01)
    assert p.sync_do(lambda p: p.insert("inp", [(1, 10)]) or "done") == "done"
    assert p.kept.rows() == [(1, 10)]
    waits = [p.async_do(lambda p, k=k: p.insert("inp", [(k, k)])) for k in range(2, 6)]
    assert [w.result(120) for w in waits] == [None] * 4
    threads = [threading.Thread(target=lambda k=k: p.sync_do(lambda p: p.insert("inp", [(k, k)]))) for k in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    wrong = p.async_do(lambda p: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        wrong.result(120)
    p.sync_do()
    assert {r[0] for r in p.kept.rows()} == {1, 2, 3, 4, 5, 10, 11, 12, 13}
    p.stop()
    assert p.failure is None and not p._thread.is_alive()


def test_a_failure_in_the_background_ends_it(spark):
    p = Kept(spark)
    p.run_bg(idle=0.01)
    p.async_do(lambda p: p.insert("inp", [(1, 10), (1, 11)]))
    p._thread.join(120)
    assert isinstance(p.failure, KeyConstraintError)
    p.stop()


def test_actions_wait_for_the_hosts_step(spark):
    p = Kept(spark)
    done = p.async_do(lambda p: p.insert("inp", [(1, 1)]))
    assert not done.done() and p.pending()
    p.run()
    assert done.done() and p.kept.rows() == [(1, 1)]


def test_shutdown_hooks_and_signals(spark):
    net, order = Network(), []
    p = Kept(spark, address="a", network=net)
    p.on_shutdown(lambda: order.append(("before", list(net.members))))
    p.on_post_shutdown(lambda: order.append(("after", list(net.members))))
    before = signal.getsignal(signal.SIGUSR1)
    p.stop_on_signals(signal.SIGUSR1)
    os.kill(os.getpid(), signal.SIGUSR1)
    assert p.stopped and order == [("before", ["a"]), ("after", [])]
    assert signal.getsignal(signal.SIGUSR1) == before


class Hop(P.Program):
    chn = P.channel("@to string, n long")
    got = P.table("n long")
    tick_ = P.scratch("x string")
    where = P.scratch("at string")

    @P.rules
    def hop(p):
        p.got <= p.chn.payloads()
        p.chn.async_(p.chn.where("n < 3").select(F.when(F.col("to") == "a", "b").otherwise("a"), F.col("n") + 1))
        p.where <= p.chn.select(p.here())
        p.localtick.async_(p.got.where("n >= 2").select(F.lit("again")))
        p.tick_ <= p.localtick


def test_network_deals_rows_out_once(spark):
    net = Network(trace=True)
    a, b = (Hop(spark, address=x, network=net, trace=True) for x in "ab")
    net.send("chn", "to", spark.createDataFrame([("a", 0), ("b", 0), ("nobody", 0), (None, 0)], "to string, n long"))
    for _ in range(5):
        for p in (a, b):
            p.tick()
    assert a.got.rows() == b.got.rows() == [(0,), (1,), (2,), (3,)]
    assert a.tick_.rows() == [("again",)]  # a row in localtick makes another step
    assert {x[3] for x in net.log} == {"a", "b"} and ("a", 0, "chn", "b", 0) in net.log
    sent, received = trace.messages(a, "sent"), trace.messages(a, "received")
    assert sent.where("pred = 'chn'").count() == 3 and received.where("pred = 'chn'").count() == 4


# --- streams -------------------------------------------------------------------------------------------------------------------------


class Both(P.Program):
    left, right = P.scratch("id long"), P.scratch("id long")
    lefts_, rights_ = P.table("id long"), P.table("id long")
    n = P.table("step long")
    total = P.lset("long")

    @P.rules
    def keep(p):
        p.lefts_ <= p.left
        p.rights_ <= p.right
        p.total <= p.left
        p.n <= p.left.apply(lambda df: df.select(F.lit(p.step).cast("long")), True)
        p.n <= p.right.apply(lambda df: df.select(F.lit(p.step).cast("long")), True)


def stream(spark, folder):
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_two_streams_take_turns(spark, tmp_path):
    spark.range(0, 60, 1, 4).write.parquet(f"file://{tmp_path}/l")
    spark.range(100, 160, 1, 3).write.parquet(f"file://{tmp_path}/r")
    p = Both(spark)
    for q in batches.drive(p, {"left": stream(spark, tmp_path / "l"), "right": stream(spark, tmp_path / "r")}, f"file://{tmp_path}/cp"):
        q.awaitTermination()
        assert q.exception() is None
    assert {r[0] for r in p.lefts_.rows()} == set(range(60)) and {r[0] for r in p.rights_.rows()} == set(range(100, 160))
    assert p.step == 7 and p.n.rows() == [(k,) for k in range(7)]


def test_a_program_resumes_with_its_stream(spark, tmp_path):
    """What tables and cells took from consumed batches is there after a restart; new files are read, old ones not again."""
    spark.range(0, 30, 1, 2).write.parquet(f"file://{tmp_path}/l")
    go = lambda p: [q.awaitTermination() for q in batches.drive(p, {"left": stream(spark, tmp_path / "l")}, f"file://{tmp_path}/cp")]
    first = Both(spark)
    go(first)
    first.close()
    spark.range(30, 50, 1, 1).write.mode("append").parquet(f"file://{tmp_path}/l")
    second = Both(spark)
    go(second)
    assert {r[0] for r in second.lefts_.rows()} == set(range(50)) == {r[0] for r in second.total.rows()}
    assert second.step == 3


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    p = Kept(spark)
    p.tick({"inp": [(1, 5), (2, 6)]})
    p.insert("kept", [(7, 7)])
    p.snapshot(f"file://{tmp_path}/s", {"x": 4})
    q = Kept(spark)
    assert q.restore(f"file://{tmp_path}/s") == {"x": 4}
    assert q.step == 1 and q.kept.rows() == [(1, 5), (2, 6)] and q.best.rows() == [(6,)]
    q.tick()
    assert q.kept.rows() == [(1, 5), (2, 6), (7, 7)] and q.later.rows() == [(1,), (2,)]
    assert Kept(spark).restore(f"file://{tmp_path}/none") is None


def test_latest_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 6), (1, 9)], "id long, at long").repartition(2).write.parquet(f"file://{tmp_path}/in")
    df = batches.last_seen(spark.readStream.schema("id long, at long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), "id", "at")
    df.writeStream.format("memory").queryName("latest_seen").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("latest_seen").collect()} == {(1, 9), (2, 6)}
