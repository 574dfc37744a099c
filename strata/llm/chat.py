"""Chat formatting with minimum-cost role repair.

A legal conversation follows an automaton over turns: an optional system turn first, then user and assistant turns in
alternation, beginning with a user turn. An input turn may be kept with its role, relabelled, or merged into the turn before
it of the role it ends up with; an empty turn may be inserted before it. Each has a cost, and dynamic programming over the
automaton's states finds the cheapest legal sequence. Ties go to the action that comes first in ACTIONS.

Costs combine by (min, +) products of small matrices, and these are associative: a conversation's turns are cut into blocks
of bounded size (in turns and in bytes of text; a longer turn is a block of its own), each block is reduced to one matrix of states, the matrices of a conversation are combined in order, and
each block then finds its own actions between the states in which it is entered and left. So a conversation of any length is
spread over tasks; only the matrices of its blocks meet.

Roles are read without regard to case or blanks around them; `human` counts as user, `ai`, `bot`, `model` and `gpt` as
assistant, and `developer` as system. A null or unknown role costs nothing to relabel; a null text counts as empty. Turns are
ordered by turn (null first), then role and text, so ties and repeated rows have a fixed order; null conversation ids form one
conversation. Extra columns are dropped. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._common import by_task, parts_for, stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state as a new turn.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RELABEL, MERGE, INSERT = 4, 1, 2
#: Turns of a block, and bytes of its texts, at most; bytes that a turn counts for beside its text.
BLOCK, BLOCK_BYTES, TURN_BYTES = 4096, 4 << 20, 64
INFINITE = 1 << 40

ALIASES = {"human": "user", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant", "developer": "system"}


def _actions() -> list[tuple[str, int, int, int]]:
    """(name, state before, state after, cost without relabelling), in order of preference."""
    out = [("keep", a, b, 0) for a, b in sorted(LEGAL)]
    out += [("merge", s, s, MERGE) for s in (SYSTEM, USER, ASSISTANT)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            if (a, b) not in LEGAL:
                for between in (USER, ASSISTANT):
                    if (a, between) in LEGAL and (between, b) in LEGAL:
                        out.append((f"insert_{ROLES[between - 1]}", a, b, INSERT))
    return out


ACTIONS = _actions()


def _step(role: int) -> np.ndarray:
    """The least cost from each state to each state over one turn of this role (0: unknown)."""
    m = np.full((4, 4), INFINITE, np.int64)
    for _, a, b, cost in ACTIONS:
        m[a, b] = min(m[a, b], cost + (0 if role in (0, b) else RELABEL))
    return m


STEPS = np.stack([_step(r) for r in range(4)])


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.minimum((x[:, :, None] + y[None, :, :]).min(1), INFINITE)


IDENTITY = np.where(np.eye(4, dtype=bool), 0, INFINITE)


def reduce_block(roles: list[int]) -> np.ndarray:
    m = IDENTITY
    for r in roles:
        m = product(m, STEPS[r])
    return m


def solve_block(roles: list[int], enter: int, leave: int | None) -> list[int]:
    """The number (in ACTIONS) of each turn's action on the cheapest way from state `enter` to `leave` (None: any)."""
    cost = np.full((len(roles) + 1, 4), INFINITE, np.int64)
    cost[0, enter] = 0
    for i, r in enumerate(roles):
        cost[i + 1] = np.minimum((cost[i][:, None] + STEPS[r]).min(0), INFINITE)
    state = int(cost[-1].argmin()) if leave is None else leave
    out = []
    for i in range(len(roles) - 1, -1, -1):
        before = int((cost[i] + STEPS[roles[i]][:, state]).argmin())
        relabel = 0 if roles[i] in (0, state) else RELABEL
        out.append(next(k for k, (_, a, b, c) in enumerate(ACTIONS) if (a, b) == (before, state) and c + relabel == STEPS[roles[i]][before, state]))
        state = before
    return out[::-1]


def role_number(role: Column) -> Column:
    name = F.lower(F.trim(role))
    for k, v in ALIASES.items():
        name = F.when(name == k, v).otherwise(name)
    out = F.lit(0)
    for i, r in enumerate(ROLES):
        out = F.when(name == r, i + 1).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("int")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input turn: conv_id, turn, position (0, 1, ... in the conversation's order), role_in, action, role_out,
    cost, and rendered: what the turn adds to the conversation's text. Rendered strings joined in order give that text."""
    spark = turns.sparkSession
    size = F.coalesce(F.octet_length(F.col(text).cast("string")).cast("long"), F.lit(0)) + TURN_BYTES
    n_parts = parts_for(spark, turns.agg(F.sum(size)).first()[0] or 0, 16 << 20)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role_in"), F.col(text).cast("string").alias("text"), role_number(F.col(role).cast("string")).alias("r"))
    # Ranges of (conversation, turn): a long conversation is cut over many partitions.
    order = ["conv_id", "turn", "role_in", "text"]
    ordered = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    layout = "part int, place long, block int, conv_id long, turn long, role_in string, text string, r int"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, own, held, n_bytes = TaskContext.get().partitionId(), -1, object(), 0, 0, 0
        for batch in batches:
            places, blocks = [], []
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(3)), 0).to_pylist()
            for c, n in zip(batch.column(0).to_pylist(), sizes):
                if c != last:
                    place, own, held, n_bytes, last = -1, 0, 0, 0, c
                elif held == block or n_bytes + n + TURN_BYTES > block_bytes:
                    own, held, n_bytes = own + 1, 0, 0
                place, held, n_bytes = place + 1, held + 1, n_bytes + n + TURN_BYTES
                places.append(place)
                blocks.append(own)
            yield pa.record_batch([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places, pa.int64()), pa.array(blocks, pa.int32()), *batch.columns], names=[x.split()[0] for x in layout.split(", ")])

    dealt = stored(ordered.mapInArrow(number, layout), "turns")
    # Of a partition's conversations only the first and the last can reach into others; and few have more than a block in it.
    each = dealt.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("last"))
    own_parts = Window.partitionBy("conv_id")
    spans = (
        each.withColumn("first", F.sum("n").over(own_parts.orderBy("part")) - F.col("n"))
        .withColumn("parts", F.count(F.lit(1)).over(own_parts))
        .where("parts > 1 OR last > 0")
        .select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "first")
    )
    spanned = dealt.join(spans, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    placed = spanned.select("conv_id", "part", "block", (F.col("place") + F.coalesce("first", F.lit(0))).alias("position"), F.col("p").isNotNull().alias("long"), "turn", "role_in", "text", "r")

    # Conversations of more than one block: a matrix for each block, then the states between blocks.
    in_long = placed.where("long").select("conv_id", "part", "block", "position", "r")

    def reduce(t: pa.Table) -> pa.Table:
        m = reduce_block(t.sort_by("position").column("r").to_pylist())
        return pa.table({**{c: t.column(c)[:1] for c in ("conv_id", "part", "block")}, "m": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})

    def enter(t: pa.Table) -> pa.Table:
        """The states in which each block of a conversation is entered and left on the cheapest way."""
        t = t.sort_by([("part", "ascending"), ("block", "ascending")])
        ms = [np.array(x).reshape(4, 4) for x in t.column("m").to_pylist()]
        cost = [np.where(np.arange(4) == START, 0, INFINITE)]
        for m in ms:
            cost.append(np.minimum((cost[-1][:, None] + m).min(0), INFINITE))
        states = [int(cost[-1].argmin())]
        for i in range(len(ms) - 1, -1, -1):
            states.append(int((cost[i] + ms[i][:, states[-1]]).argmin()))
        states.reverse()
        return pa.table({"c": t.column("conv_id"), "p": t.column("part"), "b": t.column("block"), "enter": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32())})

    entered = in_long.groupBy("conv_id", "part", "block").applyInArrow(reduce, "conv_id long, part int, block int, m array<long>").groupBy("conv_id").applyInArrow(enter, "c long, p int, b int, enter int, leave int")

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_task(batches, ["conv_id", "part", "block"]):
            roles, enter, leave = t.column("r").to_pylist(), t.column("enter")[0].as_py(), t.column("leave")[0].as_py()
            actions, costs, rendered, out = [], [], [], []
            for k, r, x in zip(solve_block(roles, START if enter is None else enter, leave), roles, t.column("text").to_pylist()):
                name, a, b, cost = ACTIONS[k]
                actions.append(name + "_relabel" * (r != b))
                out.append(ROLES[b - 1])
                costs.append(cost + RELABEL * (r not in (0, b)))
                rendered.append(render(name, a, b, x or ""))
            yield from pa.table({**{c: t.column(c) for c in ("conv_id", "turn", "position", "role_in")}, "action": pa.array(actions, pa.string()), "role_out": pa.array(out, pa.string()), "cost": pa.array(costs, pa.int64()), "rendered": pa.array(rendered, pa.string())}).combine_chunks().to_batches()

    key = ("conv_id", "part", "block")
    ready = placed.join(entered, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")), "left").drop("c", "p", "b", "long")
    return ready.repartition(n_parts, *key).sortWithinPartitions(*key, "position").mapInArrow(act, "conv_id long, turn long, position long, role_in string, action string, role_out string, cost long, rendered string")


def render(name: str, before: int, after: int, text: str) -> str:
    """What a turn adds: its header (and that of an inserted empty turn) or, merged, a blank line; then its text.

    The mark of a header within a text is escaped, so that texts can't forge turns."""
    text = text.replace("<|", "<\\|")
    if name == "merge":
        return f"\n\n{text}"
    end = "" if before == START else "<|end|>\n"
    if name.startswith("insert_"):
        end += f"<|{name.removeprefix('insert_')}|>\n<|end|>\n"
    return f"{end}<|{ROLES[after - 1]}|>\n{text}"


def conversation_costs(repaired: DataFrame) -> DataFrame:
    """conv_id, n_turns_in, n_turns_out and cost of each conversation."""
    inserted = F.col("action").startswith("insert_").cast("long")
    return repaired.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns_in"), F.sum(F.when(F.col("action").startswith("merge"), 0).otherwise(1) + inserted).alias("n_turns_out"), F.sum("cost").alias("cost"))
