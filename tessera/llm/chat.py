"""Chat formatting: roles recovered by a hidden Markov model, turns rendered in one form.

The lines of a conversation, row after row in order of (turn, role, text), are the observations; the states are ROLES. A
line shows a speaker marker ("Human:", "### Assistant:", "[bot]:" and the like) and a shape: its length's class, whether
it asks, whether it begins a row. Start, transition and emission probabilities are relative frequencies over all rows of
conversations with a known role, with added counts; the tables' size does not depend on the input. Viterbi gives the most
likely roles; of equally likely paths the one with the smallest roles in order from the end.

The query recovers every role from the text alone: the table's role column only trains, and comes back beside the
recovered one. With trust=True a known role stands as a marker before its row's first line instead, so only the others
are recovered.

A turn is a run of lines of one role in a row; a marker begins a new one. Its text loses its markers and becomes
`<|im_start|>role\\ntext<|im_end|>\\n`. One row comes back for each turn.

A conversation may be very long: it is cut into blocks of `block` turn numbers. Each block's best scores between any two
roles at its edges form a max-plus matrix; chaining these small matrices gives each block its entry and exit role, and the
blocks are decoded apart from each other, with the same result as over the whole.

Nulls: a row with a null conv_id is a conversation of its own, from which nothing is learned; a null turn comes first; a
null text is one empty line; a null or unknown role trains nothing. Ties: rows of one turn number are in order of role and
text, nulls first, in learning as in decoding. Repeated rows are turns of their own. Rows with equal turn numbers, null ones too,
lie in one block, and a block, like a very long text, lies whole in a task's memory (some 200 bytes a line). An empty
table gives an empty one. Other columns, whatever their names, are not read. Without any known role, all probabilities are even.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import frugal

ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": ("system", "instruction", "instructions", "context", "developer"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "gpt", "response"),
}
KIND = {word: role for role, words in MARKERS.items() for word in words}
MARKER = re.compile(r"^[ \t]*(?:#{1,6}[ \t]*|\*{1,2}|[\[<(|]+)?[ \t]*([A-Za-z]+)[ \t]*(?:[\])>|]+|\*{1,2})?[ \t]*:(?:\*{1,2})?[ \t]*")
SHAPES = 6 * 2 * 2
LINE = ("none", *ROLES)
TURNS = "conv_id long, turn long, part int, role string, n_lines int, rendered string, given string"
#: Ascending, nulls first.
ORDER = ("turn", "role", "text")


def marker_of(line: str) -> tuple[str, str]:
    """The marked role, or none, and the line without the marker."""
    m = MARKER.match(line)
    role = KIND.get(m[1].lower()) if m else None
    return (role, line[m.end() :]) if role else ("none", line)


def lines_of(role: str | None, text: str | None) -> list[tuple[str, int, str]]:
    """(marker, shape, rest) of a row's lines."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        marker, rest = marker_of(line)
        if i == 0 and role in ROLES:
            marker = role
        size = min(5, int(math.log2(len(rest) + 1)) // 2)
        out.append((marker, size * 4 + 2 * rest.rstrip().endswith("?") + (i == 0), rest))
    return out


class Hmm:
    """Log probabilities: start[r], move[first line of a row?][r, s], mark[r, marker], shape[r, shape]."""

    def __init__(self, start, move, mark, shape):
        self.start, self.move, self.mark, self.shape = start, move, mark, shape

    @staticmethod
    def of(counts: dict[tuple[str, str, str], int]) -> "Hmm":
        n = len(ROLES)
        start, mark, shape = np.full(n, 1.0), np.full((n, len(LINE)), 0.05), np.full((n, SHAPES), 0.5)
        move = np.full((2, n, n), 0.5)
        move[0] = np.eye(n) * 2 + 0.01  # within a row the role stays, unless a marker speaks against it
        for (kind, a, b), c in counts.items():
            i = ROLES.index(a)
            if kind == "start":
                start[i] += c
            elif kind == "move":
                move[1, i, ROLES.index(b)] += c
            elif kind == "mark":
                mark[i, LINE.index(b)] += c
            else:
                shape[i, int(b)] += c
        # a marker names its own role but for one in a thousand; how often there is none comes from the data
        none = mark[:, :1] / mark.sum(axis=1, keepdims=True)
        own = np.full((n, n), 0.001)
        np.fill_diagonal(own, 1 - 0.001 * (n - 1))
        none = np.clip(none, 0.01, 0.99)
        mark = np.hstack([none, own * (1 - none)])
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return Hmm(log(start), log(move), np.log(mark), log(shape))

    def emit(self, lines: list[tuple[str, int, str]]) -> np.ndarray:
        """[line, role]"""
        return np.array([self.mark[:, LINE.index(m)] + self.shape[:, s] for m, s, _ in lines])

    def steps(self, lines) -> list[np.ndarray]:
        """From role to role, up to and with each line's emission."""
        return [self.move[s & 1] + e[None, :] for (_, s, _), e in zip(lines, self.emit(lines), strict=True)]

    def between(self, lines) -> np.ndarray:
        """Best score from the role before the block to the role of its last line."""
        steps = self.steps(lines)
        best = steps[0]
        for step in steps[1:]:
            best = (best[:, :, None] + step[None, :, :]).max(axis=1)
        return best

    def decode(self, lines, entry: int | None, last: int | None) -> list[int]:
        """Roles, given that of the line before (None: the conversation begins) and of the last line (None: any)."""
        steps = self.steps(lines)
        score = self.start + self.emit(lines[:1])[0] if entry is None else steps[0][entry]
        back = []
        for step in steps[1:]:
            total = score[:, None] + step
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        path = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _placed(rows: DataFrame, block: int) -> DataFrame:
    span = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 40))))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("block", span.cast("long"))


def fit(rows: DataFrame, block: int = 512) -> Hmm:
    """Counts over all rows of conversations whose role is known. Moves between blocks are counted from one row for each
    block. Rows without a conv_id are not learned from."""
    own = F.when(F.col("role").isin(*ROLES), F.col("role"))
    placed = _placed(rows, block).where("conv_id is not null").withColumn("known", own)
    before = F.lag("known").over(Window.partitionBy("conv_id", "block").orderBy(*ORDER))
    inside = placed.select(before.alias("a"), F.col("known").alias("b"))
    # as ORDER has them: a null is less than all in a struct
    order = F.struct("turn", "role", "text")
    ends = placed.groupBy("conv_id", "block").agg(F.min(F.struct(order.alias("o"), "known"))["known"].alias("b"), F.max(F.struct(order.alias("o"), "known"))["known"].alias("last"))
    across = ends.select(F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")).alias("a"), "b")
    pairs = inside.unionByName(across).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("kind", F.lit("move"))
    first = placed.groupBy("conv_id").agg(F.min(F.struct(order.alias("o"), F.col("known").alias("a"))).alias("x")).where("x.a is not null").groupBy("x.a").agg(F.count("*").alias("n")).select("a", F.lit("").alias("b"), "n", F.lit("start").alias("kind"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for marker, shape, _ in lines_of(None, text):
                    seen["mark", role, marker] += 1
                    seen["shape", role, str(shape)] += 1
        yield pa.record_batch([pa.array([k[i] for k in seen], pa.string()) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], names=["kind", "a", "b", "n"])

    lines = placed.where("known is not null").select(F.col("known").alias("role"), "text").mapInArrow(frugal(count), "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    every = pairs.select("kind", "a", "b", "n").unionByName(first.select("kind", "a", "b", "n")).unionByName(lines)
    return Hmm.of({(r.kind, r.a, r.b): r.n for r in every.collect()})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one conversation and block; rows without a conversation one by one."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv_id"] is None or (row["conv_id"], row["block"]) != (held[0]["conv_id"], held[0]["block"])):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def turns(rows: DataFrame, hmm: Hmm, block: int = 512, trust: bool = False) -> DataFrame:
    """rows(conv_id, turn, role, text, ...) -> conv_id, turn, part, role, n_lines, rendered, given (the row's own role)."""
    sent = rows.sparkSession.sparkContext.broadcast(hmm)
    placed = _placed(rows, block)
    order = ["conv_id", "block", *ORDER]
    shown = lambda r: lines_of(r["role"] if trust else None, r["text"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in _groups(batches):
            lines = [x for r in group for x in shown(r)]
            begin = sent.value.start + sent.value.emit(lines[:1])[0]
            rest = sent.value.between(lines[1:]) if len(lines) > 1 else None
            alone = begin if rest is None else (begin[:, None] + rest).max(axis=0)
            out.append((group[0]["conv_id"], group[0]["block"], sent.value.between(lines).ravel().tolist(), alone.tolist()))
        yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["conv_id", "block", "m", "alone"])

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        rows_ = sorted(table.to_pylist(), key=lambda r: r["block"])
        n, back = len(ROLES), []
        score = np.array(rows_[0]["alone"])
        for r in rows_[1:]:
            total = score[:, None] + np.array(r["m"]).reshape(n, n)
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pa.table({"conv_id": [r["conv_id"] for r in rows_], "block": [r["block"] for r in rows_], "entry": pa.array([None, *path[:-1]], pa.int32()), "last": pa.array(path, pa.int32())}, schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            lines, of = [], []
            for i, r in enumerate(group):
                own = shown(r)
                lines += own
                of += [i] * len(own)
            roles = sent.value.decode(lines, group[0]["entry"], group[0]["last"])
            at, part = 0, 0
            while at < len(lines):
                end = at + 1
                while end < len(lines) and of[end] == of[at] and roles[end] == roles[at] and lines[end][0] == "none":
                    end += 1
                part = 0 if at == 0 or of[at - 1] != of[at] else part + 1
                role, text = ROLES[roles[at]], "\n".join(x[2] for x in lines[at:end]).strip()
                row = group[of[at]]
                out.append((row["conv_id"], row["turn"], part, role, end - at, f"<|im_start|>{role}\n{text}<|im_end|>\n", row["role"]))
                at = end
            if len(out) >= 2000:
                yield _turn_batch(out)
                out = []
        yield _turn_batch(out)

    # only conversations of several blocks have edges to chain
    long = placed.where("conv_id is not null").groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("z")).where("a <> z").select("conv_id")
    dealt = placed.join(long, "conv_id", "left_semi").repartition("conv_id", "block").sortWithinPartitions(*order)
    found = dealt.mapInArrow(frugal(edges), "conv_id long, block long, m array<double>, alone array<double>")
    several = found.groupBy("conv_id").applyInArrow(chain, "conv_id long, block long, entry int, last int").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "last")
    known = placed.join(several, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    return known.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(frugal(render), TURNS)


def _turn_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in TURNS.split(", ")])


def query(spark, sf_dir: str) -> DataFrame:
    """The turns with the roles that the text shows; agrees says whether the table has the same, null where it has none."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = turns(rows, fit(rows))
    return found.withColumn("agrees", F.when(F.col("given").isin(*ROLES), F.col("role") == F.col("given")))
