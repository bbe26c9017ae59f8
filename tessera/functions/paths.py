"""Paths and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    """Empty for a bare file name."""
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def extension(p: Column) -> Column:
    """Lower-cased, with its dot; empty without one."""
    return F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1))


def join_posix(base: Column, rest: Column) -> Column:
    """base/rest with . and .. resolved; null where that leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(base != "", base), rest), "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("fine"))

    def step(state: Column, part: Column) -> Column:
        up, path = part == "..", state["path"]
        kept = F.when(~up, F.concat(path, F.array(part))).when(F.size(path) > 0, F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
        return F.struct(kept.alias("path"), (state["fine"] & (~up | (F.size(path) > 0))).alias("fine"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["fine"], F.array_join(s["path"], "/")))


def violation(p: Column, symbol_path: bool = False) -> Column:
    """Why a path cannot stand in a document, or null."""
    segment = lambda s: F.array_contains(F.split(p, "/"), s)
    out = (
        F.when(p.isNull() | (p == ""), "empty")
        .when(F.contains(p, F.lit("\\")), "backslash")
        .when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), "absolute")
        .when(segment(".."), "parent-segment")
        .when((p != ".") & segment("."), "dot-segment")
    )
    return out.when(p.rlike("[:#]"), "separator") if symbol_path else out


def glob_regex(pattern: str) -> str:
    """A glob with **, *, ? and {a,b} as an anchored regular expression for paths; names with a leading dot match too."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def matches_any(p: Column, patterns: list[str]) -> Column:
    """One alternation for all patterns; false for none. A negated pattern (!x) takes back earlier ones."""
    out, run = F.lit(False), []
    for pattern in [*patterns, None]:
        if pattern is not None and not pattern.startswith("!"):
            run.append(glob_regex(pattern))
            continue
        if run:
            out = out | p.rlike("|".join(run))
            run = []
        if pattern is not None:
            out = out & ~p.rlike(glob_regex(pattern[1:]))
    return out


def gitignore_patterns(text: str) -> list[str]:
    """Globs of a .gitignore's lines; ! negates, a leading / anchors, a trailing / takes what lies inside."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        mark, body = ("!", line[1:]) if line.startswith("!") else ("", line)
        body = body[1:] if body.startswith("/") else f"**/{body}"
        out.append(mark + (body + "**" if body.endswith("/") else body))
    return out
