"""A prompt for programs that grow while they run: python -m strata.repl

Lines are declarations (`link = table("from string, to string")`), rules (`path <= link`), or commands that begin with /."""

from __future__ import annotations

import cmd
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strata import analysis
from strata.errors import StrataError
from strata.functions import aggs
from strata.operators.relational import L, R, S
from strata.plans import program as P


class Repl(cmd.Cmd):
    prompt, intro = "strata> ", "/help lists commands."

    def __init__(self, spark: SparkSession, out=print) -> None:
        super().__init__()
        self.program, self.out, self.stop_at = P.Program(spark, stdout=out), out, set()
        self.texts: dict[int, str] = {}

    def _names(self) -> dict:
        found = {n: self.program[n] for n in self.program._decls}
        return {**{k: getattr(P, k) for k in P.__all__}, "F": F, "L": L, "R": R, "S": S, "aggs": aggs, "p": self.program, **found}

    def default(self, line: str) -> None:
        try:
            if line.startswith("/"):
                name, *rest = line[1:].split()
                return getattr(self, f"cmd_{name}", lambda *_: self.out(f"no command {name}"))(*rest)
            declared = re.match(r"(\w+)\s*=\s*(\w+\(.*\))$", line)
            if declared:
                self.program.declare(declared[1], eval(declared[2], self._names()))
            else:
                code = compile(line, "<rule>", "eval")
                for n in self.program.add_rules("repl", lambda p: eval(code, self._names())):
                    self.texts[n] = line
        except (StrataError, SyntaxError, NameError, TypeError, AttributeError) as e:
            self.out(f"{type(e).__name__}: {e}")

    def cmd_help(self, *_) -> None:
        self.out("/tick [n]  /run  /stop  /lsrules  /rmrule n  /lscollections  /dump name  /break name  /dot  /explain  /quit")

    def cmd_tick(self, n="1", *_) -> None:
        for _ in range(int(n)):
            self.program.tick()
            hit = [x for x in self.stop_at if not self.program.contents(x).isEmpty()]
            if hit:
                self.out(f"stopped at step {self.program.step}: {', '.join(hit)}")
                break

    def cmd_run(self, *_) -> None:
        self.out(f"{self.program.run()} steps")

    def cmd_break(self, name, *_) -> None:
        self.stop_at.add(name)

    def cmd_stop(self, *_) -> None:
        self.program.pause()

    def cmd_lsrules(self, *_) -> None:
        for i, (lhs, op, _, block) in enumerate(self.program._rules):
            if op:
                self.out(f"{i}: {self.texts.get(i, f'{block}: {lhs} {op} ...')}")

    def cmd_rmrule(self, n, *_) -> None:
        self.program.remove_rule(int(n))

    def cmd_lscollections(self, *_) -> None:
        for n, d in self.program._decls.items():
            self.out(f"{d.kind} {n}")

    def cmd_dump(self, name, *_) -> None:
        for row in self.program.rows(name):
            self.out(str(row))

    def cmd_dot(self, *_) -> None:
        self.out(analysis.dot(self.program))

    def cmd_explain(self, *_) -> None:
        self.out(self.program.explain())

    def cmd_quit(self, *_) -> bool:
        self.program.close()
        return True


if __name__ == "__main__":
    Repl(SparkSession.builder.getOrCreate()).cmdloop()
