"""Static analysis of programs: dependencies, paths and their consistency labels.

A label says what may happen to a row's order on its way: N, a non-monotone step whose result depends on what has come so far; A, an
asynchronous step that lets rows come in any order; D, divergence: an order that is not fixed matters. Labels are the subsets of {N, A},
and D is both. Where ways meet, their labels join as sets. Along a way, a step that does nothing to order keeps the label; after
an asynchronous step, what follows is added to it; otherwise the step's label takes the place of the one before, for an order that
is fixed again by a non-monotone step can't be upset by what came earlier. So A then N is D, and N then A is A."""

from __future__ import annotations

from collections import deque
from enum import IntFlag
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import relational as O
from strata.operators.relational import L, R
from strata.plans import fixpoint
from strata.plans.program import CELL, CHANNEL, DURABLE, TABLE, Program
from strata.plans.stratify import components

DEPENDS = "rule long, lhs string, op string, body string, nm boolean"


def reflect(p: Program) -> dict[str, DataFrame]:
    """t_rules, t_depends, t_stratum, t_rule_stratum, t_provides, t_table_info, t_table_schema, t_cycle and t_underspecified."""
    s, (order, strata, of_rule) = p.spark, p.plan()
    deps = p.depends()
    now = {(d.lhs, d.body) for d in deps if d.op == "<="}
    cycles = [(n,) for c in order for n in c if len(c) > 1 or (n, n) in now]
    make = lambda rows, ddl: s.createDataFrame(rows, ddl)
    return {
        "t_rules": make([(i, b, lhs, op) for i, (lhs, op, _, b) in enumerate(p._rules) if op], "rule_id long, block string, lhs string, op string"),
        "t_depends": make([(d.rule, d.lhs, d.op, d.body, d.nm) for d in deps], DEPENDS),
        "t_stratum": make(sorted(strata.items()), "predicate string, stratum long"),
        "t_rule_stratum": make(sorted(of_rule.items()), "rule_id long, stratum long"),
        "t_provides": make(p.provides(), "interface string, input boolean"),
        "t_table_info": make([(n, d.kind) for n, d in p._decls.items()], "tab_name string, tab_type string"),
        "t_table_schema": make([(n, f.name, i, f.name in sc.key_cols) for n, sc in p._schemas.items() for i, f in enumerate(sc.fields)], "tab_name string, col_name string, ord long, is_key boolean"),
        "t_cycle": make(cycles, "predicate string"),
        "t_underspecified": make(p.underspecified(), "pred string, input boolean"),
    }


def dependency_closure(depends: DataFrame, storage) -> DataFrame:
    """lhs, body, via, neg and temporal: what each collection depends on, directly or not."""
    edge = depends.select("lhs", "body", F.col("nm").alias("neg"), F.col("op").rlike(r"^<[-+~]").alias("temporal")).distinct()
    base = edge.select("lhs", "body", F.col("body").alias("via"), "neg", "temporal")
    step = lambda delta: O.pairs(edge, delta, {"body": "lhs"}, L["lhs"].alias("lhs"), R["body"].alias("body"), L["body"].alias("via"), (L["neg"] | R["neg"]).alias("neg"), (L["temporal"] | R["temporal"]).alias("temporal"))
    return fixpoint.closure(base, step, storage)


def dependency_report(depends: DataFrame, providing: DataFrame, storage) -> dict[str, DataFrame]:
    """cycle, source, sink and underspecified, from the closure. providing: pred, input."""
    tc = dependency_closure(depends, storage)
    proper = tc.where("lhs <> body")
    inputs, outputs = providing.where("input"), providing.where("NOT input")
    return {
        "depends_tc": tc,
        "cycle": tc.where("lhs = body AND NOT (neg AND NOT temporal)").select(F.col("lhs").alias("pred"), "via", "neg", "temporal").distinct(),
        "source": O.notin(inputs, tc.select("lhs"), {"pred": "lhs"}).select("pred"),
        "sink": O.notin(outputs, tc.select("body"), {"pred": "body"}).select("pred"),
        "underspecified": O.notin(inputs, proper.select("body"), {"pred": "body"}).unionByName(O.notin(outputs, proper.select("lhs"), {"pred": "lhs"})).select("pred", "input"),
    }


class Label(IntFlag):
    """A path's effect on order: a subset of {N, A}."""

    M = 0
    N = 1
    A = 2
    D = N | A

    def then(self, step: Label) -> Label:
        """This way with one more step behind it."""
        if not step:
            return self
        return Label(self | step) if self & Label.A else step

    @property
    def letter(self) -> str:
        return ("M", "N", "A", "D")[self]


def joined(labels) -> Label:
    """Of ways that meet."""
    return fold(lambda a, b: a | b, labels, Label.M)


def tag_bounds() -> dict[tuple[str, str], str]:
    """The tag of a path from the tags of its first part and of the next rule."""
    return {(a.letter, b.letter): a.then(b).letter for a in map(Label, range(4)) for b in map(Label, range(4))}


def _letter(tag: Column) -> Column:
    return F.element_at(F.array(*(F.lit(Label(i).letter) for i in range(4))), tag + 1)


def labelled_paths(depends: DataFrame, storage) -> DataFrame:
    """from, to, path, and for each step of the path its op and the tag (a Label's number) up to it: every simple dependency path."""
    bits = F.when(F.col("nm"), int(Label.N)).otherwise(0).bitwiseOR(F.when(F.col("op") == "<~", int(Label.A)).otherwise(0))
    of_rule = depends.groupBy("rule").agg(F.bit_or(bits).alias("tag"))
    edge = depends.join(of_rule, "rule").select("body", F.col("lhs").alias("head"), "tag", "op").distinct()
    base = edge.select(F.col("body").alias("from"), F.col("head").alias("to"), F.array("body", "head").alias("path"), F.array("op").alias("ops"), F.array("tag").alias("tags"))

    def step(delta: DataFrame) -> DataFrame:
        so_far, more = F.element_at(L["tags"], -1), R["tag"]
        tag = F.when(more == 0, so_far).when(so_far.bitwiseAND(int(Label.A)) != 0, so_far.bitwiseOR(more)).otherwise(more)
        longer = O.pairs(delta, edge, {"to": "body"}, L["from"].alias("from"), R["head"].alias("to"), L["path"].alias("path"), F.array_append(L["ops"], R["op"]).alias("ops"), F.array_append(L["tags"], tag).alias("tags"))
        return longer.where(~F.array_contains("path", F.col("to"))).withColumn("path", F.array_append("path", F.col("to")))

    return fixpoint.closure(base, step, storage)


def path_tags(spark: SparkSession, depends: DataFrame, storage) -> DataFrame:
    """from, to, path, tag, lastop and len: every simple dependency path with its tag."""
    paths = labelled_paths(depends, storage)
    return paths.select("from", "to", "path", _letter(F.element_at("tags", -1)).alias("tag"), F.element_at("ops", -1).alias("lastop"), F.size("path").alias("len"))


def divergence_report(paths: DataFrame, inputs: DataFrame) -> dict[str, DataFrame]:
    """From labelled_paths() and the names of inputs (column pred). first: the shortest paths from each input for each tag.
    turning_points: paths from inputs that diverge in their last step, with the part of them up to the last asynchronous step, whose
    order it is that matters. uniform: pairs of collections all of whose paths have one tag."""
    last = F.element_at("tags", -1)
    own = O.lefts(paths, inputs, {"from": "pred"}).select("from", "to", "path", "ops", "tags", last.alias("tag"), F.size("path").alias("len"))
    shortest = own.groupBy("from", "tag").agg(F.min("len").alias("len"))
    turned = own.where((F.col("tag") == int(Label.D)) & ((F.size("tags") == 1) | (F.element_at("tags", -2) != int(Label.D))))
    earlier = F.filter(F.transform(F.slice("ops", 1, F.size("ops") - 1), lambda op, i: F.when(op == "<~", i + 1)), lambda i: i.isNotNull())
    each = paths.groupBy("from", "to").agg(F.min(last).alias("tag"), F.max(last).alias("most"), F.count(F.lit(1)).alias("n"))
    return {
        "first": own.join(shortest, ["from", "tag", "len"], "left_semi").select("from", "to", "path", _letter(F.col("tag")).alias("tag"), "len"),
        "turning_points": turned.withColumn("at", F.array_max(earlier)).select("from", "to", F.slice("path", 1, F.coalesce(F.col("at"), F.lit(0)) + 1).alias("up_to"), "path"),
        "uniform": each.where("tag = most").select("from", "to", _letter(F.col("tag")).alias("tag"), "n"),
    }


def _state_of(p: Program, name: str) -> str:
    return p._decls[name].kind if name in p._decls else "none"


def _ports(p: Program) -> tuple[set[str], set[str]]:
    """Inputs and outputs."""
    provides = p.provides()
    return {n for n, is_input in provides if is_input}, {n for n, is_input in provides if not is_input}


def flows(p: Program) -> list[tuple[str, str, tuple[str, ...], Label, str]]:
    """(input, output, a shortest way, label, reason) for each label with which rows of an input reach an output that nothing reads.

    Labels spread over the graph of strongly connected components, so the work grows with its edges, not with its paths; a
    component with inner edges is passed by one of their labels. Channels that are inputs get an asynchronous step before them.
    An output that two channels reach without stored state on both ways is divergent (reason `unguarded`)."""
    steps: dict[tuple[str, str], set[Label]] = {}
    for d in p.depends():
        steps.setdefault((d.body, d.lhs), set()).add(Label.A if d.op == "<~" else Label.N if d.nm else Label.M)
    inputs, outputs = _ports(p)
    edges: dict[str, set[str]] = {}
    for a, b in steps:
        edges.setdefault(a, set()).add(b)
    divergent = divergent_outputs(p, edges)
    for n in inputs:
        if _state_of(p, n) == CHANNEL:
            steps[f"{n}_INPUT", n] = {Label.A}
            edges.setdefault(f"{n}_INPUT", set()).add(n)
    whole = {n: ",".join(c) for c in components({n for e in steps for n in e}, edges) for n in c}
    within: dict[str, set[Label]] = {}
    across: dict[str, set[tuple[str, Label]]] = {}
    for (a, b), labels in steps.items():
        if whole[a] == whole[b]:
            within.setdefault(whole[a], set()).update(labels)
        else:
            across.setdefault(whole[a], set()).update((whole[b], x) for x in labels)
    reached = {to for found in across.values() for to, _ in found}
    out = []
    for source in sorted(across.keys() - reached):
        if not (source in inputs or source.removesuffix("_INPUT") in inputs):
            continue
        ways: dict[tuple[str, Label], tuple[str, ...]] = {(source, Label.M): (source,)}
        work = deque(ways)
        while work:  # by length, so the first way found with a label is a shortest
            node, label = work.popleft()
            for to, step in sorted(across.get(node, ())):
                for inner in sorted(within.get(to, {Label.M})):
                    mark = (to, label.then(step).then(inner))
                    if mark not in ways:
                        ways[mark] = (*ways[node, label], to)
                        work.append(mark)
        for (node, label), way in ways.items():
            if node in outputs and node not in across and len(way) > 1:
                out.append((source, node, way, Label.D, "unguarded") if node in divergent else (source, node, way, label, "way"))
    return sorted(out)


def channel_races(p: Program, edges: dict[str, set[str]] | None = None) -> set[tuple[str, str, str, bool]]:
    """(channel, partner, where they meet, guarded): pairs of channels of which neither feeds the other and that meet in one
    collection; guarded if both ways pass through stored state."""
    if edges is None:
        edges = {}
        for d in p.depends():
            edges.setdefault(d.body, set()).add(d.lhs)
    reach: dict[str, dict[str, bool]] = {}
    for n, d in p._decls.items():
        if d.kind == CHANNEL:
            # For each collection: whether stored state lies on a way from the channel to it.
            found: set[tuple[str, bool]] = set()
            work = [(n, False)]
            while work:
                x, kept = work.pop()
                for to in edges.get(x, ()):
                    mark = (to, kept or _state_of(p, to) in (TABLE, DURABLE, CELL))
                    if mark not in found:
                        found.add(mark)
                        work.append(mark)
            reach[n] = {}
            for to, kept in found:
                reach[n][to] = reach[n].get(to, False) or kept
    out = set()
    for a, to_a in reach.items():
        for b, to_b in reach.items():
            if a != b and b not in to_a:
                out |= {(a, b, x, to_a[x] and to_b[x]) for x in to_a.keys() & to_b.keys()}
    return out


def divergent_outputs(p: Program, edges: dict[str, set[str]]) -> set[str]:
    bad = {x for _, _, x, guarded in channel_races(p) if not guarded}
    work = list(bad)
    while work:
        for to in edges.get(work.pop(), ()):
            if to not in bad:
                bad.add(to)
                work.append(to)
    return bad


def _name(label: Label) -> str:
    return label.letter if label else "Bot"


def output_report(p: Program) -> dict[str, str]:
    """The label of each output over all inputs' ways to it."""
    found = flows(p)
    return {to: _name(joined(x[3] for x in found if x[1] == to)) for to in {x[1] for x in found}}


def path_report(p: Program) -> dict[str, dict[str, str]]:
    """For each output and input, the label of all ways between them."""
    found = flows(p)
    return {to: {a: _name(joined(x[3] for x in found if x[:2] == (a, to))) for a in {x[0] for x in found if x[1] == to}} for to in {x[1] for x in found}}


def dot(p: Program, tick: int | None = None) -> str:
    """The dataflow as GraphViz text: collections by kind, in a box for each stratum, edges by rule (dashed if deferred, dotted if
    asynchronous). tick: with the rows that each collection held in that step, of a program made with trace=True."""
    held = {n: k for t, n, k in p.trace_log or [] if t == tick}
    shape = {TABLE: "box", DURABLE: "box", CELL: "hexagon", CHANNEL: "cds"}
    lines = ["digraph program {", "  rankdir=LR;"]
    used = {n for d in p.depends() for n in (d.lhs, d.body)}
    strata = p.plan()[1]
    for level in sorted({strata.get(n, 0) for n in used}):
        lines.append(f'  subgraph "cluster_{level}" {{ label="stratum {level}";')
        for n in sorted(x for x in used if strata.get(x, 0) == level):
            lines.append(f'    "{n}" [shape={shape.get(_state_of(p, n), "ellipse")}, label="{n}{f"\\n{held[n]} rows" if n in held else ""}"];')
        lines.append("  }")
    for a, b, op, nm in sorted({(d.body, d.lhs, d.op, d.nm) for d in p.depends()}):
        style = "dotted" if op == "<~" else "dashed" if op != "<=" else "solid"
        lines.append(f'  "{a}" -> "{b}" [style={style}, label="{op}{" not" if nm else ""}"];')
    return "\n".join([*lines, "}"])


def space_time(log: list[tuple[str, int, str, str, int]]) -> list[tuple[str, str, str]]:
    """Edges of a space-time diagram from messages (sender, its step, channel, receiver, its step): message edges and the
    succession of each program's steps with messages."""
    steps: dict[str, set[int]] = {}
    edges = []
    for a, i, name, b, j in log:
        steps.setdefault(a, set()).add(i)
        steps.setdefault(b, set()).add(j)
        edges.append((f"{a}@{i}", f"{b}@{j}", name))
    for n, at in steps.items():
        ordered = sorted(at)
        edges += [(f"{n}@{x}", f"{n}@{y}", "") for x, y in zip(ordered, ordered[1:])]
    return sorted(set(edges))
