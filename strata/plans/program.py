"""Programs: collections, lattice cells and rules, evaluated one timestep at a time.

A program is a class: class attributes declare collections, methods marked with @rules hold rules, and subclasses override rule
blocks by name. An instance is a running engine. A step has three phases. Setup: deferred deletes, upserts and inserts take
effect, scratches are emptied, messages and timer rows arrive. Logic: `<=` rules run to a fixpoint, component by component in
order of strata. Transition: deferred and asynchronous rules are evaluated once on the final state.

Rules are Rel expressions, so each component is an ordinary DataFrame plan; state that outlives a step is written by Storage."""

from __future__ import annotations

import datetime as dt
import signal
import threading
import uuid
from collections import ChainMap, Counter, defaultdict, deque
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import CompileError, IllegalSourceError, KeyConstraintError, ShutdownWithCallbacksError, TypeMismatchError
from strata.functions import lattices as lat
from strata.plans import fixpoint
from strata.plans.rel import ColumnRef, Literal, Product, Rel, Scan
from strata.plans.storage import Storage
from strata.plans.stratify import Depends, stratify
from strata.schema import Schema

TABLE, SCRATCH, TEMP, INPUT, OUTPUT, CHANNEL, LOOPBACK, PERIODIC, TERMINAL, READONLY, DURABLE, CELL = "table", "scratch", "temp", "input", "output", "channel", "loopback", "periodic", "terminal", "readonly", "durable", "cell"

#: Which kinds take which rules.
LEGAL = {
    "<=": {TABLE, SCRATCH, TEMP, INPUT, OUTPUT, DURABLE, CELL},
    "<+": {TABLE, SCRATCH, TEMP, INPUT, OUTPUT, DURABLE, CELL},
    "<-": {TABLE, DURABLE},
    "<+-": {TABLE},
    "<~": {CHANNEL, LOOPBACK, TERMINAL},
}


class Decl:
    """A declared collection; on an instance, each access is a new scan of it."""

    def __init__(self, kind: str, keys=None, vals=None, lattices=None, **options) -> None:
        self.kind, self.args, self.options, self.name = kind, (keys, vals, lattices), options, None

    def __set_name__(self, owner, name: str) -> None:
        self.name = name

    def __get__(self, program, owner=None):
        return self if program is None else program[self.name]

    def schema(self) -> Schema:
        if self.kind == CELL:
            return _cell_schema(*self.args[:2])
        keys, vals, lattices = self.args
        if isinstance(keys, Schema):
            return keys
        return Schema.of(keys, vals, {k: lat.BY_NAME[v] if isinstance(v, str) else v for k, v in (lattices or {}).items()}, self.kind == CHANNEL)


def _cell_schema(kind, type_) -> Schema:
    name = kind if isinstance(kind, str) else kind.name
    if name in ("lmax", "lmin"):
        return Schema.of("", f"v {type_}", {"v": lat.BY_NAME[name]})
    if name == "lbool":
        return Schema.of("", "v boolean", {"v": lat.lbool})
    if name in ("lset", "lpset"):
        return Schema.of(type_ if " " in type_ else f"elem {type_}")
    if name == "lbag":
        return Schema.of(f"elem {type_}", "v long", {"v": lat.lmax})
    if name.startswith("lmap"):
        key, value, lattice = type_
        return Schema.of(f"k {key}", f"v {value}", {"v": lat.BY_NAME[lattice] if isinstance(lattice, str) else lattice})
    return Schema.of("", f"v {type_}", {"v": kind})


def table(keys=None, vals=None, lattices=None):
    return Decl(TABLE, keys, vals, lattices)


def scratch(keys=None, vals=None, lattices=None):
    return Decl(SCRATCH, keys, vals, lattices)


def interface(direction: str, keys=None, vals=None):
    if direction not in (INPUT, OUTPUT):
        raise CompileError("an interface is input or output")
    return Decl(direction, keys, vals)


def channel(keys="@address string, val string", vals=None):
    return Decl(CHANNEL, keys, vals)


def loopback(keys=None, vals=None):
    return Decl(LOOPBACK, keys, vals)


def periodic(seconds: float):
    return Decl(PERIODIC, "key string", "val timestamp", seconds=seconds)


def terminal():
    return Decl(TERMINAL, "line string")


def file_reader(path: str):
    return Decl(READONLY, "lineno long", "text string", path=path)


def coll_expr(make: Callable[[], DataFrame | list], keys=None, vals=None):
    """Evaluated anew in each step."""
    return Decl(READONLY, keys, vals, make=make)


def watched(path: str):
    """The files of a folder as rows (name, value), looked at anew in each step."""
    return Decl(READONLY, "name string", "value string", watch=path)


def readonly(keys=None, vals=None):
    return Decl(READONLY, keys, vals, make=list)


def durable(path: str, keys=None, vals=None):
    """A table that outlives the program: a folder with a snapshot for each step that changed it."""
    return Decl(DURABLE, keys, vals, path=path)


def lmax(type_="long"):
    return Decl(CELL, "lmax", type_)


def lmin(type_="long"):
    return Decl(CELL, "lmin", type_)


def lbool():
    return Decl(CELL, "lbool", "boolean")


def lset(type_="string"):
    """type_: the element's type, or DDL of the columns of structured elements."""
    return Decl(CELL, "lset", type_)


def lpset(type_="long"):
    return Decl(CELL, "lpset", type_)


def lbag(type_="string"):
    return Decl(CELL, "lbag", type_)


def lmap(key="string", value="long", lattice="lmax"):
    return Decl(CELL, "lmap", (key, value, lattice))


def cell(lattice: lat.Lattice, type_: str):
    """A cell of a lattice of one's own."""
    return Decl(CELL, lattice, type_)


#: Collections that every program has, declared when they are first named. localtick: a row sent to it starts another step.
BUILTIN: dict[str, Callable[[Program], Decl]] = {
    "localtick": lambda p: loopback("col1 string"),
    "periodics_tbl": lambda p: coll_expr(lambda: [(n, float(d.options["seconds"])) for n, d in p._decls.items() if d.kind == PERIODIC], "pername string", "period double"),
}


def rules(f):
    """Marks a method as a block of rules; a subclass's method of that name takes its place."""
    f._strata_rules = True
    return f


def bootstrap(f):
    """Marks a method that runs once, before the first step."""
    f._strata_bootstrap = True
    return f


class Coll(Scan):
    """A collection of a program, as it is named in rules."""

    def __init__(self, program: Program, name: str) -> None:
        decl = program._decls[name]
        super().__init__(name, program._schemas[name].key_cols if name in program._schemas else None)
        self.program, self.decl_kind = program, decl.kind
        kind = decl.args[0] if decl.kind == CELL else ""
        self.kind = kind if isinstance(kind, str) else kind.name
        if decl.kind == CELL and self.schema.lattices:
            self.value_lattice = self.schema.lattices["v"]

    @property
    def schema(self) -> Schema:
        return self.program._schemas[self.name]

    def __getitem__(self, column: str) -> ColumnRef:
        if column not in self.schema.cols:
            raise CompileError(f"{self.name} has no column {column}")
        return ColumnRef(self.name, column)

    def __le__(self, rel) -> bool:
        self.program._rule(self, "<=", rel)
        return True

    def next_(self, rel) -> None:
        """<+ : merged at the next step."""
        self.program._rule(self, "<+", rel)

    def delete_(rel_self, rel) -> None:
        """<- : equal rows go at the next step."""
        rel_self.program._rule(rel_self, "<-", rel)

    def upsert_(self, rel) -> None:
        """<+- : rows with the same keys go and these come, at the next step."""
        self.program._rule(self, "<+-", rel)

    def async_(self, rel) -> None:
        """<~ : sent, to arrive in some later step."""
        self.program._rule(self, "<~", rel)

    def payloads(self) -> Rel:
        """A channel's rows without the address."""
        loc = self.schema.location
        return self.select(*[c for c in self.schema.cols if c != loc]) if loc else self

    def null_tuple(self) -> Rel:
        s = self.schema
        return Literal(lambda: s.rows(self.program.spark, [()]))

    # host side
    def insert(self, rows) -> None:
        self.program.insert(self.name, rows)

    def delete(self, rows) -> None:
        self.program._defer("<-", self.name, rows)

    def upsert(self, rows) -> None:
        self.program._defer("<+-", self.name, rows)

    def df(self) -> DataFrame:
        return self.program.contents(self.name)

    def rows(self) -> list[tuple]:
        return sorted((tuple(r) for r in self.df().collect()), key=repr)


class _Module:
    """An imported program: its collections under a prefix."""

    def __init__(self, program: Program, prefix: str) -> None:
        self.__dict__.update(_program=program, _prefix=prefix)

    def __getattr__(self, name: str):
        full = f"{self._prefix}{name}"
        if full in self._program._decls:
            return self._program[full]
        if full in self._program._modules:
            return self._program._modules[full]
        raise AttributeError(name)


class Program:
    """Options: address and network (for channels), clock, stdin and stdout (callables), channel_filter, trace (keep what each step
    held and what was sent and received), trace_folder (write that as files), check_keys, strict (joins of at most two instances of a
    collection), max_rounds, state_folder.

    Steps, inserts and deliveries exclude each other, so threads and streams may share a program."""

    imports: dict[str, type] = {}
    #: Collections declared elsewhere that are inputs or outputs too: name to `input` or `output`.
    interfaces: dict[str, str] = {}

    def __init__(self, spark: SparkSession, *, address: str = "local", network=None, clock: Callable[[], dt.datetime] | None = None, stdout: Callable[[str], None] = print, channel_filter: Callable[[str, DataFrame], tuple[DataFrame, DataFrame]] | None = None, trace: bool = False, trace_folder: str | None = None, check_keys: bool = True, strict: bool = False, max_rounds: int = fixpoint.MAX_ROUNDS, state_folder: str | None = None) -> None:
        self.spark, self.address, self.network, self.stdout = spark, address, network, stdout
        self.channel_filter, self.check_keys, self.strict, self.max_rounds = channel_filter, check_keys, strict, max_rounds
        self._clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.storage, self.step, self.clock, self.stopped, self.paused = Storage(spark, state_folder), 0, None, False, False
        self._decls: dict[str, Decl] = {}
        self._schemas: dict[str, Schema] = {}
        self._modules: dict[str, _Module] = {}
        self._rules: list[tuple[str, str, Rel, str]] = []
        self._block: str | None = None
        self._state: dict[str, DataFrame] = {}
        self._deferred: dict[str, dict[str, list[DataFrame]]] = {op: defaultdict(list) for op in ("<+", "<-", "<+-")}
        self._inbox: dict[str, list[DataFrame]] = defaultdict(list)
        self._callbacks: dict[int, tuple[str, Callable[[DataFrame], None]]] = {}
        self._shutdown: list[Callable[[], None]] = []
        self._due: dict[str, dt.datetime] = {}
        self._files_read: set[str] = set()
        self._stdin: list[str] = []
        self._waiting = False
        self._plan = None
        self._started = False
        self._marks: dict[str, bool] = {}
        self._lock, self._wake, self._actions = threading.RLock(), threading.Event(), deque()
        self._thread: threading.Thread | None = None
        self._after_shutdown: list[Callable[[], None]] = []
        self.failure: BaseException | None = None
        self._grown: dict[str, fixpoint.Runs] = {}
        self.trace_log: list[tuple[int, str, int]] | None = [] if trace or trace_folder else None
        self.trace_folder = trace_folder
        #: (sent, received or slept, step, collection, rows, time), where tracing is on.
        self.message_log: list[tuple[str, int, str, DataFrame | None, float]] = []
        self.trace_states: list[tuple[int, dict[str, DataFrame]]] = []
        self.tick_times: list[float] = []
        self._declare(type(self), "")
        self._declare_system()
        if network is not None:
            network.join(self)
        self._collect(type(self), self, "")

    # --- declarations and rules
    def _declare(self, cls: type, prefix: str) -> None:
        for base in reversed(cls.__mro__):
            for name, d in vars(base).items():
                if isinstance(d, Decl):
                    self._add(prefix + name, d)
        for base in reversed(cls.__mro__):
            for name, direction in vars(base).get("interfaces", {}).items():
                if direction not in (INPUT, OUTPUT):
                    raise CompileError("an interface is input or output")
                if prefix + name not in self._decls:
                    raise CompileError(f"no collection {name}")
                self._marks[prefix + name] = direction == INPUT
        for name, module in getattr(cls, "imports", {}).items():
            self._modules[prefix + name] = _Module(self, f"{prefix}{name}.")
            self._declare(module, f"{prefix}{name}.")

    def _declare_system(self) -> None:
        if "halt" not in self._decls:
            self._add("halt", scratch("command string"))
        if sum(d.kind == TERMINAL for d in self._decls.values()) > 1:
            raise CompileError("a program has one terminal at most")

    def _add(self, name: str, decl: Decl) -> None:
        self._decls[name] = decl
        if decl.kind != TEMP:
            self._schemas[name] = decl.schema()

    def _collect(self, cls: type, owner, prefix: str) -> None:
        for name, module in getattr(cls, "imports", {}).items():
            self._collect(module, self._modules[prefix + name], f"{prefix}{name}.")
        for name in dir(cls):
            f = getattr(cls, name, None)
            if callable(f) and getattr(f, "_strata_rules", False):
                self._block = prefix + name
                f(owner)
        self._block = None

    def __getitem__(self, name: str) -> Coll:
        if name not in self._decls and name in BUILTIN:
            decl = BUILTIN[name](self)
            decl.name = name
            self._add(name, decl)
            self._plan = None
        if name not in self._decls:
            raise CompileError(f"no collection {name}")
        return Coll(self, name)

    def __getattr__(self, name: str):
        modules = self.__dict__.get("_modules", {})
        if name in modules:
            return modules[name]
        decls = self.__dict__.get("_decls", {})
        if name in decls or (decls and name in BUILTIN):
            return self[name]
        raise AttributeError(name)

    def temp(self, name: str, rel) -> Coll:
        """A scratch declared where it is defined, with the columns of its expression."""
        if name in self._decls:
            raise CompileError(f"{name} is declared already")
        self._add(name, Decl(TEMP))
        self._decls[name].name = name
        c = self[name]
        self._rule(c, "<=", rel)
        return self[name]

    def declare(self, name: str, decl: Decl) -> Coll:
        """Adds a collection to a running program."""
        if name in self._decls:
            raise CompileError(f"{name} is declared already")
        decl.name = name
        self._add(name, decl)
        self._plan = None
        return self[name]

    def add_rules(self, name: str, f: Callable[[Program], None]) -> list[int]:
        """Adds a block of rules to a running program; returns their numbers."""
        n = len(self._rules)
        self._block = name
        try:
            f(self)
        finally:
            self._block = None
        self._plan = None
        return list(range(n, len(self._rules)))

    def remove_rule(self, number: int) -> None:
        lhs, op, rel, block = self._rules[number]
        self._rules[number] = (lhs, "", rel, block)
        self._plan = None

    def _rule(self, lhs: Coll, op: str, rel) -> None:
        if self._block is None:
            raise CompileError(f"{op} outside a block of rules; use insert() from the host")
        kind = lhs.decl_kind
        if kind not in LEGAL[op]:
            raise CompileError(f"{lhs.name} is a {kind} and takes no {op}")
        if isinstance(rel, Product):
            rel = rel.combos()
        elif isinstance(rel, (list, tuple)):
            rows, schema = list(rel), self._schemas.get(lhs.name)
            rel = Literal(lambda: schema.rows(self.spark, rows))
        elif isinstance(rel, DataFrame):
            frame = rel
            rel = Literal(lambda: frame)
        if not isinstance(rel, Rel):
            raise CompileError(f"not a relation: {rel!r}")
        if self.strict and max(Counter(s.name for s, _ in rel.scans()).values(), default=0) > 2:
            raise CompileError("a collection is read more than twice in one rule; rename() it")
        self._rules.append((lhs.name, op, rel, self._block))

    # --- reflection
    def depends(self) -> list[Depends]:
        seen = {}
        for i, (lhs, op, rel, _) in enumerate(self._rules):
            for s, nm in rel.scans():
                if op:
                    key = (i, lhs, op, s.name)
                    seen[key] = seen.get(key, False) or nm or op in ("<-", "<+-")
        return [Depends(*k, nm) for k, nm in seen.items()]

    def plan(self):
        """(components in order, stratum of each collection, stratum of each rule); a CompileError if there is none."""
        if self._plan is None:
            self._plan = stratify(self._decls, self.depends())
        return self._plan

    def provides(self) -> list[tuple[str, bool]]:
        """Inputs (true) and outputs, by their declaration or marked by `interfaces`."""
        return [(n, self._marks.get(n, d.kind == INPUT)) for n, d in self._decls.items() if d.kind in (INPUT, OUTPUT) or n in self._marks]

    def underspecified(self) -> list[tuple[str, bool]]:
        """Inputs that no rule reads, and outputs that no rule writes."""
        read, written = {d.body for d in self.depends()}, {r[0] for r in self._rules if r[1]}
        return [(n, is_input) for n, is_input in self.provides() if n not in (read if is_input else written)]

    def explain(self) -> str:
        order, strata, of_rule = self.plan()
        lines = [f"stratum {strata[c[0]]}: {', '.join(c)}" for c in order if c[0] in self._decls]
        lines += [f"rule {i} [{block}] stratum {of_rule.get(i, 0)}: {lhs} {op} {', '.join(('!' if nm else '') + s.name for s, nm in rel.scans()) or 'literal'}" for i, (lhs, op, rel, block) in enumerate(self._rules) if op]
        return "\n".join(lines)

    # --- host side
    def insert(self, name: str, rows) -> None:
        """Rows (or a DataFrame) to merge at the next step; into a channel or terminal, to send."""
        if self._block is not None:
            raise CompileError("insert() is for the host, not for rules")
        self[name]
        kind = self._decls[name].kind
        if kind in (READONLY, PERIODIC):
            raise CompileError(f"{name} is read-only")
        df = self._frame(name, rows)
        with self._lock:
            if kind == CHANNEL:
                self._send(name, df)
            elif kind == LOOPBACK:
                self._inbox[name].append(self._keep(df, name))
            elif kind == TERMINAL:
                self._print(df)
            else:
                self._deferred["<+"][name].append(self._keep(df, name))
        self._wake.set()

    def type_line(self, line: str) -> None:
        """A line that the terminal reads in the next step."""
        self._stdin.append(line)
        self._wake.set()

    def _defer(self, op: str, name: str, rows) -> None:
        if self._decls[name].kind not in LEGAL[op]:
            raise CompileError(f"{name} takes no {op}")
        with self._lock:
            self._deferred[op][name].append(self._keep(self._frame(name, rows), name))
        self._wake.set()

    def _frame(self, name: str, rows) -> DataFrame:
        if isinstance(rows, DataFrame):
            return self._schemas[name].align(rows)
        if not isinstance(rows, Iterable) or isinstance(rows, str):
            raise TypeMismatchError(f"not a collection of rows: {rows!r}")
        return self._schemas[name].rows(self.spark, rows)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.storage.write(df, name)

    def contents(self, name: str) -> DataFrame:
        """The collection as the last step left it."""
        if name in self._state:
            return self._state[name]
        if name not in self._schemas:
            raise IllegalSourceError(f"{name} has no rows before the first step")
        return self._empty(name)

    def rows(self, name: str) -> list[tuple]:
        return self[name].rows()

    def _empty(self, name: str) -> DataFrame:
        return self._schemas[name].frame(self.spark, [])

    def on(self, name: str, f: Callable[[DataFrame], None]) -> int:
        """Calls f with the collection's rows at the end of each step in which it has any; returns a number for off()."""
        number = max(self._callbacks, default=-1) + 1
        self[name]
        self._callbacks[number] = (name, f)
        return number

    def off(self, number: int) -> None:
        del self._callbacks[number]

    def on_shutdown(self, f: Callable[[], None]) -> None:
        """f is called when the program stops, while it is still on its network."""
        self._shutdown.append(f)

    def on_post_shutdown(self, f: Callable[[], None]) -> None:
        """f is called when the program has stopped and left its network."""
        self._after_shutdown.append(f)

    def stop_on_signals(self, *numbers: int) -> None:
        """Stops at these signals (SIGINT and SIGTERM if none is given), until then in the place of their handlers."""
        numbers = numbers or (signal.SIGINT, signal.SIGTERM)
        before = {n: signal.getsignal(n) for n in numbers}
        for n in numbers:
            signal.signal(n, lambda *_: self.stop())
        self.on_post_shutdown(lambda: [signal.signal(n, f) for n, f in before.items()])

    def sync_do(self, f: Callable[[Program], object] | None = None) -> object:
        """Host code between steps, then a step; returns what f returns when that step is done."""
        if self._in_background():
            done: Future = Future()
            self._actions.append((f, done))
            self._wake.set()
            return done.result()
        with self._lock:
            out = f(self) if f else None
            self.tick()
        return out

    def async_do(self, f: Callable[[Program], object] | None = None) -> Future:
        """Host code before the next step, which is taken soon in the background or else when the host takes one. Doesn't wait."""
        done: Future = Future()
        self._actions.append((f, done))
        self._wake.set()
        return done

    def _in_background(self) -> bool:
        return self._thread is not None and self._thread.is_alive() and threading.current_thread() is not self._thread

    def run_bg(self, idle: float = 0.05) -> None:
        """Steps in a thread of its own while something waits to happen, until stop(). idle: seconds between looks at timers."""
        if self._thread is not None and self._thread.is_alive():
            raise IllegalSourceError("the program runs in the background already")

        def loop() -> None:
            first = True
            while not self.stopped:
                if not self.paused and (first or self.pending() or self._timer_due()):
                    first = False
                    try:
                        self.tick()
                    except BaseException as e:  # noqa: BLE001  kept for the host, which sees that the thread has ended
                        self.failure = e
                        break
                else:
                    if self.trace_log is not None:
                        self.message_log.append(("slept", self.step, "", None, self._clock().timestamp()))
                    self._wake.wait(idle)
                    self._wake.clear()
            for _, done in self._actions:
                done.cancel()

        self._thread = threading.Thread(target=loop, daemon=True, name=f"program-{self.address}")
        self._thread.start()

    def _timer_due(self) -> bool:
        return any(d.kind == PERIODIC and (n not in self._due or self._clock() >= self._due[n]) for n, d in self._decls.items())

    def sync_callback(self, name: str, rows, out: str, max_ticks: int = 100) -> list[tuple]:
        """Inserts rows and steps until `out` has rows; returns them."""
        self.insert(name, rows)
        return self.delta(out, max_ticks)

    def delta(self, out: str, max_ticks: int = 100) -> list[tuple]:
        """The rows of `out` in the next step that has any."""
        if self._in_background():
            done: Future = Future()
            number = self.on(out, lambda df: done.done() or done.set_result(sorted((tuple(r) for r in df.collect()), key=repr)))
            self._shutdown.append(lambda: done.done() or done.set_exception(ShutdownWithCallbacksError(f"stopped while waiting for {out}")))
            self._wake.set()
            try:
                return done.result()
            finally:
                self.off(number)
        self._waiting = True
        try:
            for _ in range(max_ticks):
                if self.stopped:
                    raise ShutdownWithCallbacksError(f"stopped while waiting for {out}")
                self.tick()
                if found := self.rows(out):
                    return found
            raise ShutdownWithCallbacksError(f"no rows in {out} after {max_ticks} steps")
        finally:
            self._waiting = False

    def run(self, max_ticks: int | None = None) -> int:
        """Steps while something waits to happen; returns the number of steps."""
        n = 0
        while not (self.stopped or self.paused) and (max_ticks is None or n < max_ticks) and (n == 0 or self.pending()):
            self.tick()
            n += 1
        return n

    def pending(self) -> bool:
        return bool(any(any(x.values()) for x in self._deferred.values()) or any(self._inbox.values()) or self._stdin or self._actions)

    def pause(self) -> None:
        self.paused = True

    def start(self) -> None:
        self.paused = False

    def stop(self) -> None:
        """No step follows; waits for one that is under way in the background."""
        if not self.stopped:
            self.stopped = True
            self._wake.set()
            if self._in_background():
                self._thread.join()
            for f in self._shutdown:
                f()
            if self.network is not None:
                self.network.leave(self)
            for f in self._after_shutdown:
                f()

    def close(self) -> None:
        """stop(), and deletes the program's state files."""
        self.stop()
        self.storage.drop()

    def __enter__(self) -> Program:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- values that rules may use, fixed within a step
    def now(self) -> Column:
        if self.clock is None:
            raise CompileError("the clock has a value within a step alone")
        return F.lit(self.clock)

    def time(self) -> Column:
        return F.lit(self.step)

    def here(self) -> Column:
        """The program's own address."""
        return F.lit(self.address)

    def at_step(self, f: Callable[[Program], list | DataFrame], keys=None, vals=None) -> Rel:
        """A relation that is made anew in each step, from the step's own time and clock."""
        schema = Schema.of(keys, vals)
        return Literal(lambda: (lambda x: schema.align(x) if isinstance(x, DataFrame) else schema.rows(self.spark, x))(f(self)))

    # --- a step
    def tick(self, inputs: dict[str, object] | None = None) -> None:
        """One timestep. inputs: rows for collections, as by insert()."""
        with self._lock:
            self._tick(inputs)

    def _tick(self, inputs: dict[str, object] | None) -> None:
        if self.stopped:
            raise IllegalSourceError("the program has stopped")
        actions = [self._actions.popleft() for _ in range(len(self._actions))]
        made = []
        for f, done in actions:
            try:
                made.append((done, f(self) if f else None))
            except Exception as e:  # noqa: BLE001  it is the caller's
                done.set_exception(e)
        began = dt.datetime.now()
        if not self._started:
            self._started = True
            self._boot()
        for name, rows in (inputs or {}).items():
            self.insert(name, rows)
        self.clock = self._clock()
        order, _, _ = self.plan()
        base = self._setup()
        state, before = self._logic(order, base), self._state
        self._state = state
        self._transition(state, before)
        for name, f in list(self._callbacks.values()):
            if not state[name].isEmpty():
                f(state[name])
        if self.trace_log is not None:
            self._trace(state)
        halted = "halt" in state and self._has_rules("halt", "<=") and not state["halt"].isEmpty()
        self.step += 1
        self.clock = None
        self.tick_times.append((dt.datetime.now() - began).total_seconds())
        for done, value in made:
            done.set_result(value)
        if halted:
            self.stop()

    def _trace(self, state: dict[str, DataFrame]) -> None:
        """Keeps what each collection holds in this step; in files, where a folder was given for that."""
        if self.trace_folder is None:
            self.trace_log += [(self.step, n, df.count()) for n, df in state.items()]
            self.trace_states.append((self.step, dict(state)))
            return
        files = Storage(self.spark, self.trace_folder)
        kept = {n: files.counted_at(df, f"{self.trace_folder}/contents/{n}/tick={self.step}") for n, df in state.items()}
        rows = [(self.step, n, k) for n, (_, k) in kept.items()]
        self.spark.createDataFrame(rows, "tick long, table_name string, n long").coalesce(1).write.parquet(f"{self.trace_folder}/cardinalities/tick={self.step}")
        self.trace_log += rows
        self.trace_states.append((self.step, {n: df for n, (df, _) in kept.items()}))

    def _has_rules(self, name: str, op: str) -> bool:
        return any(r[0] == name and r[1] == op for r in self._rules)

    def _load_durable(self) -> None:
        for name, d in self._decls.items():
            if d.kind == DURABLE:
                from strata.sources.durable import latest

                found = latest(self.spark, d.options["path"], self._schemas[name].struct)
                if found is not None:
                    self._state[name] = found

    def _boot(self) -> None:
        self._load_durable()
        for name in dir(type(self)):
            f = getattr(type(self), name, None)
            if callable(f) and getattr(f, "_strata_bootstrap", False):
                f(self)
        for prefix, module in self._modules.items():
            cls = self._module_class(prefix)
            for name in dir(cls):
                f = getattr(cls, name, None)
                if callable(f) and getattr(f, "_strata_bootstrap", False):
                    f(module)

    def _module_class(self, path: str) -> type:
        cls = type(self)
        for part in path.split("."):
            cls = cls.imports[part]
        return cls

    def _setup(self) -> dict[str, DataFrame]:
        base = {}
        deferred, self._deferred = self._deferred, {op: defaultdict(list) for op in ("<+", "<-", "<+-")}
        inbox, self._inbox = self._inbox, defaultdict(list)

        def arrive(name: str) -> None:
            d = self._decls[name]
            s = self._schemas[name]
            new = deferred["<+"][name] + deferred["<+-"][name]
            if d.kind in (TABLE, DURABLE, CELL):
                old = self._state.get(name)
                changed = bool(new)
                if old is not None:
                    for gone in deferred["<-"][name]:
                        old, changed = fixpoint.added(old, gone), True
                    for up in deferred["<+-"][name]:
                        if s.key_cols:
                            on = fold(lambda a, b: a & b, (F.col(f"n.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in s.key_cols))
                            old = old.alias("n").join(up.alias("o"), on, "left_anti")
                        else:
                            old = old.limit(0)
                        changed = True
                if changed and old is not None and old is self._state.get(name):
                    base[name] = self._more(name, old, new)
                    return
                df = self._union(name, [*([old] if old is not None else []), *new])
                base[name] = self._settled(name, df) if changed else df
            elif d.kind in (SCRATCH, INPUT, OUTPUT, TEMP):
                df = self._union(name, new)
                base[name] = self._settled(name, df) if new else df
            elif d.kind in (CHANNEL, LOOPBACK):
                base[name] = self._arrivals(name, inbox[name])
            elif d.kind == PERIODIC:
                base[name] = self._timer(name, d.options["seconds"])
            elif d.kind == TERMINAL:
                lines, self._stdin = self._stdin, []
                base[name] = s.rows(self.spark, [(x,) for x in lines])
            elif d.kind == READONLY:
                base[name] = self._read(name, d)

        self._side_by_side(arrive, [n for n in self._decls if n in self._schemas])
        return base

    def _union(self, name: str, dfs: list[DataFrame]) -> DataFrame:
        return fold(lambda a, b: a.unionByName(b), dfs) if dfs else self._empty(name)

    def _more(self, name: str, old: DataFrame, new: list[DataFrame]) -> DataFrame:
        """A table with more rows: only those that it doesn't have are written, as one more run of files, and only their keys are
        checked; `old` itself where there are none."""
        s, runs = self._schemas[name], self._grown.get(name)
        if s.lattices or runs is None or runs.df() is not old:
            return self._settled(name, self._union(name, [old, *new]))
        fresh, n = self.storage.counted(fixpoint.added(self._union(name, new).distinct(), old), name)
        if not n:
            return old
        if self.check_keys and s.plain_vals:
            same = old.alias("o").join(fresh.alias("n"), fixpoint.same_row(s.key_cols), "left_semi") if s.key_cols else old
            s.check(fresh.unionByName(same), name)
        runs.add(fresh, n)
        return runs.df()

    def _settled(self, name: str, df: DataFrame) -> DataFrame:
        """df as the set that a collection holds, written and with its key checked."""
        s = self._schemas[name]
        if self._decls[name].kind in (TABLE, DURABLE) and not s.lattices:
            out, n = self.storage.counted(s.merged(df), name)
            self._grown[name] = fixpoint.Runs(self.storage, name, out, n)
            out = self._grown[name].df()
        else:
            out = self._keep(s.merged(df), name)
        if self.check_keys:
            s.check(out, name)
        kind = self._decls[name].args[0]
        if self._decls[name].kind == CELL and kind == "lpset" and not out.where(F.col(s.cols[0]) < 0).isEmpty():
            raise TypeMismatchError(f"{name} holds no negative numbers")
        return out

    def _arrivals(self, name: str, dfs: list[DataFrame]) -> DataFrame:
        df = self._union(name, dfs)
        if dfs and self.channel_filter is not None and self._decls[name].kind == CHANNEL:
            df, later = self.channel_filter(name, df)
            if later is not None and not later.isEmpty():
                self._inbox[name].append(self._keep(later, name))
        return self._settled(name, df) if dfs else df

    def _timer(self, name: str, seconds: float) -> DataFrame:
        due = self._due.get(name)
        rows = []
        if due is None or self.clock >= due:
            self._due[name] = self.clock + dt.timedelta(seconds=seconds)
            rows = [(uuid.uuid4().hex, self.clock)] if due is not None or seconds == 0 else []
        return self._schemas[name].rows(self.spark, rows)

    def _read(self, name: str, d: Decl) -> DataFrame:
        s = self._schemas[name]
        if "path" in d.options:
            if name in self._files_read:
                return self._empty(name)  # a file is read once
            self._files_read.add(name)
            from strata.sources.text import numbered_lines

            return self._keep(s.align(numbered_lines(self.spark, d.options["path"])), name)
        if "watch" in d.options:
            from strata.sources.durable import watch

            return self._keep(s.align(watch(self.spark, d.options["watch"])), name)
        made = d.options["make"]()
        return s.align(made) if isinstance(made, DataFrame) else s.rows(self.spark, made)

    def _logic(self, order: list[list[str]], base: dict[str, DataFrame]) -> dict[str, DataFrame]:
        state: dict[str, DataFrame] = dict(base)
        readers: dict[str, int] = defaultdict(int)
        for _, op, rel, _ in self._rules:
            for s, _ in rel.scans() if op else ():
                readers[s.name] += 1
        now = [(lhs, rel) for lhs, op, rel, _ in self._rules if op == "<="]
        def evaluate(component: list[str]) -> None:
            own = [(lhs, rel) for lhs, rel in now if lhs in component]
            inside = set(component)
            recursive = any(s.name in inside for _, rel in own for s, _ in rel.scans())
            env = self._env(state)
            for name in component:
                if name not in self._schemas:  # a temp takes the columns of what defines it
                    found = next(rel for lhs, rel in own if lhs == name).build(env)
                    self._schemas[name] = Schema(tuple(T.StructField(f.name if not f.name.startswith("_") else f"c{i}", f.dataType) for i, f in enumerate(found.schema.fields)))
                    state[name] = self._empty(name)
            flat = {n: [state[n]] + [self._schemas[n].align(rel.build(env)) for lhs, rel in own if lhs == n and not any(s.name in inside for s, _ in rel.scans())] for n in component}
            if not recursive:
                (name,) = component
                s, kind = self._schemas[name], self._decls[name].kind
                if kind in (TABLE, DURABLE) and len(flat[name]) > 1:
                    state[name] = self._more(name, flat[name][0], flat[name][1:])
                    return
                df = self._union(name, flat[name])
                lasting = kind in (TABLE, DURABLE, CELL) or readers[name] > 1 or (self.check_keys and s.plain_vals)
                state[name] = self._settled(name, df) if lasting else s.merged(df)
                return
            looping = [(lhs, rel) for lhs, rel in own if any(s.name in inside for s, _ in rel.scans())]

            def step(full, delta):
                out: dict[str, list[DataFrame]] = {n: [] for n in inside}
                for lhs, rel in looping:
                    places = [s for s, _ in rel.scans() if s.name in inside]
                    if len({id(s) for s in places}) < len(places):  # one expression in two places can't be told apart
                        out[lhs].append(rel.build(self._env(ChainMap(full, state))))
                        continue
                    for place in places:  # one term for each recursive scan, with the delta in its place
                        if place.name in delta:
                            out[lhs].append(rel.build(self._env(ChainMap(full, state), {id(place): delta[place.name]})))
                return out

            grown: dict[str, fixpoint.Runs] = {}
            solved = fixpoint.solve({n: self._union(n, dfs) for n, dfs in flat.items()}, step, {n: self._schemas[n] for n in component}, self.storage, self.max_rounds, grown=grown)
            self._grown.update({n: r for n, r in grown.items() if self._decls[n].kind in (TABLE, DURABLE)})
            for name, df in solved.items():
                if self.check_keys:
                    self._schemas[name].check(df, name)
                state[name] = df

        # Components that don't depend on each other run side by side: their jobs are often small.
        reads: dict[str, set[str]] = defaultdict(set)
        for lhs, rel in now:
            reads[lhs] |= {s.name for s, _ in rel.scans()}
        depth: dict[str, int] = {}
        levels: dict[int, list[list[str]]] = defaultdict(list)
        for component in order:
            if not any(n in reads or any(lhs == n for lhs, _ in now) for n in component):
                continue
            level = max([0, *(depth[b] + 1 for n in component for b in reads[n] if b in depth and b not in component)])
            depth.update(dict.fromkeys(component, level))
            levels[level].append(component)
        for _, found in sorted(levels.items()):
            self._side_by_side(evaluate, found)
        return state

    def _side_by_side(self, f: Callable, items: list) -> list:
        if len(items) < 2:
            return [f(x) for x in items]
        with ThreadPoolExecutor(min(len(items), 8)) as pool:
            return list(pool.map(f, items))

    def _env(self, state: dict[str, DataFrame], instead: dict[int, DataFrame] | None = None):
        def env(scan: Scan) -> DataFrame:
            if instead and id(scan) in instead:
                return instead[id(scan)]
            if scan.name not in state:
                raise CompileError(f"{scan.name} is read before it is defined")
            return state[scan.name]

        env.write = self.storage.write
        return env

    def _transition(self, state: dict[str, DataFrame], before: dict[str, DataFrame]) -> None:
        env = self._env(state)
        sends: dict[str, list[DataFrame]] = defaultdict(list)

        def defer(rule) -> None:
            lhs, op, rel, _ = rule
            df = self._schemas[lhs].align(rel.build(env))
            if op == "<~":
                sends[lhs].append(df)
                return
            kept, n = self.storage.counted(df.distinct(), lhs)
            if n:
                self._deferred[op][lhs].append(kept)

        self._side_by_side(defer, [r for r in self._rules if r[1] not in ("", "<=")])
        for lhs, dfs in sends.items():
            df, kind = self._union(lhs, dfs), self._decls[lhs].kind
            if kind == TERMINAL:
                self._print(df)
                continue
            df = self._settled(lhs, df)
            if df.isEmpty():
                continue
            if kind == LOOPBACK:
                self._inbox[lhs].append(df)
            else:
                self._send(lhs, df)
        for name, d in self._decls.items():
            if d.kind == DURABLE and name in state and state[name] is not before.get(name):
                from strata.sources.durable import commit

                commit(state[name], d.options["path"])

    def _send(self, name: str, df: DataFrame) -> None:
        loc = self._schemas[name].location
        self._log_messages("sent", name, df)
        if self.network is None:
            own, n = self.storage.counted(df.where(F.col(loc) == self.address), name)
            if n:
                self._log_messages("received", name, own)
                self._inbox[name].append(own)
        else:
            self.network.send(name, loc, df, self)

    def _log_messages(self, kind: str, name: str, df: DataFrame) -> None:
        if self.trace_log is not None:
            self.message_log.append((kind, self.step, name, df, self._clock().timestamp()))

    def _print(self, df: DataFrame) -> None:
        for row in df.toLocalIterator():
            self.stdout(row[0])

    def deliver(self, name: str, df: DataFrame, written: bool = False) -> None:
        """Messages from the network or a stream, for the next step. written: df reads from files already."""
        if name not in self._decls or self._decls[name].kind not in (CHANNEL, LOOPBACK):
            raise IllegalSourceError(f"{name} receives no messages")
        df = self._schemas[name].align(df)
        with self._lock:
            self._inbox[name].append(df if written else self._keep(df, name))
            self._log_messages("received", name, self._inbox[name][-1])
        self._wake.set()

    # --- snapshots
    def snapshot(self, folder: str, marks: dict[str, int] | None = None) -> None:
        """Writes what outlives a step (tables, cells, what is deferred or has arrived, the step's number) and some numbers of the
        caller's to a new version below folder. It counts once all of it is written."""
        from strata.sources.durable import commit_manifest

        with self._lock:
            frames = [("state", n, df) for n, df in self._state.items() if self._decls[n].kind in (TABLE, CELL)]
            frames += [(op, n, df) for op, of in self._deferred.items() for n, dfs in of.items() for df in dfs]
            frames += [("inbox", n, df) for n, dfs in self._inbox.items() for df in dfs]
            commit_manifest(self.spark, folder, frames, {"step": self.step, **{f"mark.{k}": v for k, v in (marks or {}).items()}})

    def restore(self, folder: str) -> dict[str, int] | None:
        """Takes the last snapshot of a program with these declarations; returns its numbers, or None if there is no snapshot."""
        from strata.sources.durable import read_manifest

        found = read_manifest(self.spark, folder)
        if found is None:
            return None
        frames, numbers = found
        with self._lock:
            for kind, name, path in frames:
                df = self.spark.read.schema(self._schemas[name].struct).parquet(path)
                if kind == "state":
                    self._state[name] = df
                elif kind == "inbox":
                    self._inbox[name].append(df)
                else:
                    self._deferred[kind][name].append(df)
            self.step, self._started = numbers["step"], True
            self._load_durable()
        return {k.removeprefix("mark."): v for k, v in numbers.items() if k.startswith("mark.")}


__all__ = ["Program", "Coll", "KeyConstraintError", "table", "scratch", "interface", "channel", "loopback", "periodic", "terminal", "file_reader", "coll_expr", "readonly", "watched", "durable", "lmax", "lmin", "lbool", "lset", "lpset", "lbag", "lmap", "cell", "rules", "bootstrap"]
