"""Gates: clauses on counters, the first one that trips in the order given."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a clause may name.
TOKENS = ("added", "removed", "changed", "moved", "moved+changed", "dropped-toggled", "dropped-toggled:to-dropped", "dropped-toggled:to-kept", "unknown")
AXES = ("api-changed", "logic-changed", "syntax-changed")
COLUMN = {"moved+changed": "moved_changed", "dropped-toggled": "dropped_toggled", "dropped-toggled:to-dropped": "to_dropped", "dropped-toggled:to-kept": "to_kept"}
CLAUSE = re.compile(r"^(?P<token>.*?)(?::(?P<op>>=|<=|==|>)(?P<n>\d+))?$")


class BadGate(ValueError):
    pass


@dataclass(frozen=True)
class Clause:
    token: str
    op: str = ">"
    limit: int = 0

    @property
    def text(self) -> str:
        return self.token if (self.op, self.limit) == (">", 0) else f"{self.token}:{self.op}{self.limit}"


def parse(value: str, wide: bool = False) -> list[Clause]:
    """`changed,added:>3`. The command line knows > only; `wide` also takes >=, == and <=."""
    out = []
    for part in value.split(","):
        part = part.strip()
        m = CLAUSE.match(part)
        if not part or not m or m["token"] not in (*TOKENS, *AXES) or (m["op"] not in (None, ">") and not wide):
            raise BadGate(f"no such gate: {part!r}")
        out.append(Clause(m["token"], m["op"] or ">", int(m["n"] or 0)))
    return out


def evaluate(clauses: list[Clause], counters: DataFrame) -> DataFrame:
    """counters, one row -> (ord, clause, observed, tripped), in order; the gate's answer is the first tripped one."""
    if not clauses:
        raise BadGate("a gate needs a clause")
    test = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "<=": lambda a, b: a <= b}
    rows = []
    for i, c in enumerate(clauses):
        seen = F.col(COLUMN.get(c.token, c.token.replace("-", "_"))).cast("long")
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(c.text).alias("clause"), seen.alias("observed"), test[c.op](seen, F.lit(c.limit)).alias("tripped")))
    return counters.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def first_tripped(result: DataFrame) -> DataFrame:
    return result.where("tripped").orderBy("ord").limit(1)


def axis_counts(deltas: DataFrame) -> DataFrame:
    """Changes, moved or not, in which an axis moved."""
    return deltas.agg(*(F.count_if(F.col(f"flags.{a.replace('-', '_')}")).alias(a.replace("-", "_")) for a in AXES))
