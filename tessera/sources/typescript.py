"""Symbols, rules, calls and imports of TypeScript and JavaScript files.

There is no parser library here, so files are cut into tokens whose brackets are paired, and declarations, statements and
call chains are read off the tokens. It covers module-level declarations, classes and their members, decorators, documentation
comments, signatures, control flow and calls. Type-level syntax is kept as text. Files run in Arrow batches; a file that
cannot be cut is reported and the others go on.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Methods whose module-level calls become symbols.
PROMOTED = frozenset(("get", "post", "put", "patch", "delete", "all", "use", "route", "listen", "param", "engine", "set", "enable", "disable"))
NOT_CALLED = frozenset("if for while switch catch function return typeof await new in of instanceof void delete case do else throw yield import async".split())
MODIFIERS = frozenset("public private protected static readonly abstract override async declare get set accessor".split())
TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<number>\d[\w.]*)|(?P<name>#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=?|===?|!==?|>>>?=|<<=|<=|>=|&&=?|\|\|=?|\+\+|--|\*\*=?|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#])",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


#: Files whose symbols a task holds at once.
BATCH = 256


class Unreadable(ValueError):
    pass


class Source:
    """Tokens (kind, text, start, end) of a file, without space and comments; pair[i] is a bracket's other end."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, str, int, int]] = []
        self.docs: dict[int, str] = {}  # documentation comments in front of a token
        self.breaks: list[bool] = []  # whether a line ends in front of a token
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self._cut()
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "op" and t in "({[":
                stack.append(i)
            elif kind == "op" and t in ")}]":
                if not stack or self.tokens[stack[-1]][1] != {")": "(", "}": "{", "]": "["}[t]:
                    raise Unreadable(f"line {self.line(i)}: a bracket has no other end")
                j = stack.pop()
                self.pair[i], self.pair[j] = j, i
        if stack:
            raise Unreadable(f"line {self.line(stack[-1])}: a bracket is never closed")

    def _cut(self) -> None:
        text, at, docs, broke = self.text, 0, [], False
        while at < len(text):
            last = self.tokens[-1] if self.tokens else None
            value = last is not None and (last[0] in ("number", "string", "template", "regex") or last[1] in (")", "]", "}") or (last[0] == "name" and last[1] not in NOT_CALLED))
            if text[at] == "`":
                end = self._template(at)
                m_kind, t = "template", text[at:end]
            elif text[at] == "/" and not value and (m := REGEX.match(text, at)):
                end, m_kind, t = m.end(), "regex", m[0]
            else:
                m = TOKEN.match(text, at)
                if m is None:
                    at += 1
                    continue
                end, m_kind, t = m.end(), m.lastgroup, m[0]
            if m_kind in ("space", "comment"):
                broke |= "\n" in t
                if t.startswith("/**"):
                    docs.append(t)
            else:
                if docs:
                    self.docs[len(self.tokens)] = "\n".join(docs)
                    docs = []
                self.tokens.append((m_kind, t, at, end))
                self.breaks.append(broke)
                broke = False
            at = end

    def _template(self, at: int) -> int:
        i = at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 2
                continue
            if c == "`":
                return i + 1
            if self.text.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(self.text) and depth:
                    if self.text[i] == "`":
                        i = self._template(i)
                        continue
                    if self.text[i] in "'\"" and (m := TOKEN.match(self.text, i)) and m.lastgroup == "string":
                        i = m.end()
                        continue
                    depth += (self.text[i] == "{") - (self.text[i] == "}")
                    i += 1
                continue
            i += 1
        raise Unreadable("a template is never closed")

    def t(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return bisect(self.lines, self.tokens[min(i, len(self.tokens) - 1)][2]) + 1 if self.tokens else 1

    def raw(self, a: int, b: int) -> str:
        """Text of tokens a to b, b not included."""
        return self.text[self.tokens[a][2] : self.tokens[b - 1][3]] if a < b else ""

    def skip_angles(self, i: int) -> int:
        """Behind a <...> at i, or i where it is none."""
        if self.t(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.tokens):
            t = self.t(j)
            if t in "({[" and self.kind(j) == "op":
                j = self.pair[j]
            elif t in (";", "&&", "||") or (self.kind(j) == "op" and t in ")}]"):
                return i
            elif t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif t in (">>", ">>>"):
                depth -= len(t)
            if depth <= 0:
                return j + 1
            j += 1
        return i

    def statement_end(self, i: int, end: int) -> int:
        """Behind the statement that begins at i."""
        j = i
        while j < end:
            t, kind = self.t(j), self.kind(j)
            if kind == "op" and t == ";":
                return j + 1
            if kind == "op" and t in "({[":
                j = self.pair[j] + 1
            elif kind == "op" and t in ")}]":
                return j
            else:
                j += 1
            if j < end and self.breaks[j]:
                before, after = self.tokens[j - 1], self.tokens[j]
                open_ = before[0] == "op" and before[1] not in (")", "]", "}", "++", "--") or before[1] in ("extends", "implements", "in", "of", "instanceof", "typeof", "await", "new", "as", "from")
                goes_on = after[0] == "op" and after[1] not in ("{", "@", "++", "--", "!", "~", "#", "}") or after[1] in ("instanceof", "in", "as", "satisfies")
                if not open_ and not goes_on:
                    return j
        return end


def chain(s: Source, i: int) -> tuple[int, str, bool] | None:
    """The callee whose last token is i: where it begins, its dotted name, whether its receiver is an expression."""
    parts, dynamic, j = [], False, i
    while True:
        t, kind = s.t(j), s.kind(j)
        if kind == "name":
            parts.append(t)
            start = j
        elif kind == "op" and t == "]":
            dynamic = True
            j = s.pair[j] - 1
            if s.t(j) == "?.":
                j -= 1
            continue
        elif kind == "op" and t == ")":
            dynamic = True
            inner = s.pair[j]
            k = inner - 1
            if s.kind(k) == "op" and s.t(k) == "?.":
                k -= 1
            if s.kind(k) == "name" and s.t(k) not in NOT_CALLED or s.t(k) in (")", "]"):
                j = k
                continue
            parts.append(s.raw(inner + 1, j) or "()")
            start = inner
        elif kind == "op" and t == "!" and j > 0:
            j -= 1
            continue
        elif kind in ("string", "template", "number", "regex"):
            parts.append(t)
            dynamic, start = True, j
        else:
            return None
        if s.t(start - 1) in (".", "?.") and start >= 2 and s.kind(start - 1) == "op":
            j = start - 2
            continue
        return start, ".".join(reversed(parts)), dynamic


def literal(s: Source, a: int, b: int) -> str | None:
    return s.t(a).strip("'\"`") if b - a == 1 and s.kind(a) in ("string", "number") or (b - a == 1 and s.kind(a) == "template" and "${" not in s.t(a)) else (s.t(a) if b - a == 1 and s.t(a) in ("true", "false", "null") else None)


def arguments(s: Source, open_: int) -> list[tuple[int, int]]:
    """Token ranges between the commas of a bracket."""
    out, a, j, end = [], open_ + 1, open_ + 1, s.pair[open_]
    while j < end:
        if s.kind(j) == "op" and s.t(j) in "({[":
            j = s.pair[j]
        elif s.t(j) == "<" and s.skip_angles(j) > j and s.kind(j - 1) == "name" and s.t(s.skip_angles(j)) in (",", ")", ">", "=", "[", "|"):
            j = s.skip_angles(j) - 1
        elif s.kind(j) == "op" and s.t(j) == ",":
            if j > a:
                out.append((a, j))
            a = j + 1
        j += 1
    return [*out, (a, end)] if end > a else out


def calls_in(s: Source, a: int, b: int, skip: list[tuple[int, int]] = ()) -> list[dict]:
    out = []
    for i in range(a, b):
        if any(x <= i < y for x, y in skip):
            continue
        if s.kind(i) == "name" and s.t(i) == "new" and s.t(i - 1) not in (".", "?."):
            j = i + 1
            while s.kind(j) == "name" or s.t(j) == ".":
                j += 1
            if j > i + 1:
                k = s.skip_angles(j)
                args = arguments(s, k) if s.t(k) == "(" and s.kind(k) == "op" else []
                out.append({"target": s.raw(i + 1, j).replace(" ", ""), "line": s.line(i), "in_new": True, "in_await": s.t(i - 1) == "await", "dynamic": False, "args": args, "at": i, "end": (s.pair[k] + 1 if args or s.t(k) == "(" else j)})
            continue
        if s.kind(i) != "op" or s.t(i) != "(":
            continue
        j = i - 1
        if s.t(j) == ">":
            k = j
            while k > a and s.skip_angles(k) != i:
                k -= 1
            if s.t(k) != "<":
                continue
            j = k - 1
        if s.t(j) == "?." and s.kind(j) == "op":
            j -= 1
        name = s.t(j)
        if s.kind(j) == "name" and name in NOT_CALLED and s.t(j - 1) not in (".", "?."):
            continue
        found = chain(s, j)
        if found is None or (s.kind(j) == "op" and s.t(j) == ")" and s.t(s.pair[j] - 1) in ("if", "while", "for", "switch", "catch", "with")):
            continue
        start, target, dynamic = found
        if s.t(start - 1) in ("function", "new", "*") and s.t(start - 1) != "*" or s.t(start - 1) == "function":
            continue
        after = s.pair[i] + 1
        if s.kind(j) == "name" and start == j and s.t(start - 1) in ("{", ",", "}", ";", "async", "get", "set", "static", "*", "public", "private", "protected", "override", "readonly") and _has_body(s, after):
            continue
        out.append({"target": target, "line": s.line(start), "in_new": False, "in_await": s.t(start - 1) == "await", "dynamic": dynamic, "args": arguments(s, i), "at": start, "end": after})
    return out


def _has_body(s: Source, i: int) -> bool:
    """Whether a parameter list that ends before i belongs to a declaration with a body."""
    if s.t(i) == ":":
        i += 1
        while i < len(s.tokens) and s.t(i) not in ("{", ";", "=>", ",", ")"):
            i = s.skip_angles(i) if s.t(i) == "<" and s.skip_angles(i) > i else (s.pair[i] + 1 if s.t(i) in "([" and s.kind(i) == "op" else i + 1)
    return s.t(i) == "{" and s.kind(i) == "op"


def strip_parens(t: str) -> str:
    t = t.strip()
    return t[1:-1].strip() if t.startswith("(") and t.endswith(")") else t


def trivial(s: Source, a: int, b: int) -> bool:
    """A literal, a name, members of one, with signs or brackets around."""
    while a < b and s.t(a) in ("!", "-", "+", "~", "++", "--", "typeof", "void"):
        a += 1
    while b > a and s.t(b - 1) in ("++", "--"):
        b -= 1
    if a >= b:
        return False
    if s.t(a) == "(" and s.pair.get(a) == b - 1:
        return trivial(s, a + 1, b - 1)
    if b - a == 1:
        return s.kind(a) in ("name", "number", "string")
    if s.kind(a) != "name" or s.t(a) in NOT_CALLED:
        return False
    i = a + 1
    while i < b:
        if s.t(i) in (".", "?.") and s.kind(i + 1) == "name":
            i += 2
        elif s.t(i) == "[":
            i = s.pair[i] + 1
        else:
            return False
    return True


def walk(s: Source, a: int, b: int) -> tuple[list[dict], list[dict]]:
    """Rules and calls of a body. Handlers of failures are passed over, so that rewriting one leaves the logic alone."""
    rules: list[dict] = []
    skip: list[tuple[int, int]] = []
    loops: set[int] = set()
    rule = lambda kind, i, **f: rules.append({"type": kind, "line": s.line(i), "condition": None, "what": None, "expr": None, "loop_kind": None, **f})
    i = a
    while i < b:
        t = s.t(i)
        word = s.kind(i) == "name" and s.t(i - 1) not in (".", "?.") and s.t(i + 1) not in (":", "=", ",") or t in ("return", "throw") and s.t(i - 1) not in (".", "?.")
        nxt = s.t(i + 1)
        if word and t == "if" and nxt == "(":
            close = s.pair[i + 1]
            then = (close + 1, s.pair[close + 1] + 1) if s.t(close + 1) == "{" else (close + 1, s.statement_end(close + 1, b))
            if early_exit(s, *then):
                rule("guard", i, condition=strip_parens(s.raw(i + 1, close + 1)))
        elif word and t == "throw":
            end = s.statement_end(i + 1, b)
            last = end - (s.t(end - 1) == ";")
            what = s.raw(i + 1, last)
            if nxt == "new":
                what = re.match(r"new\s+([\w$.]+)", what)[1]
            rule("throw", i, what=what)
        elif word and t == "return" and i + 1 < b and not s.breaks[i + 1] and nxt not in (";", "}"):
            end = s.statement_end(i + 1, b)
            last = end - (s.t(end - 1) == ";")
            whole = any(c["at"] == i + 1 and c["end"] == last for c in calls_in(s, i + 1, last))
            if not whole and not trivial(s, i + 1, last):
                rule("return", i, expr=" ".join(s.raw(i + 1, last).split()))
        elif word and t == "for" and nxt in ("(", "await"):
            rule("loop", i, loop_kind="for")
        elif word and t == "while" and nxt == "(" and i not in loops:
            rule("loop", i, loop_kind="while")
        elif word and t == "do" and nxt == "{":
            rule("loop", i, loop_kind="do")
            loops.add(s.pair[i + 1] + 1)
        elif word and t == "try" and nxt == "{":
            rule("try", i)
        elif word and t == "switch" and nxt == "(":
            rule("switch", i, condition=strip_parens(s.raw(i + 1, s.pair[i + 1] + 1)))
        elif word and t in ("catch", "finally") and s.t(i - 1) == "}":
            open_ = s.pair[i + 1] + 1 if nxt == "(" else i + 1
            if s.t(open_) == "{":
                skip.append((i, s.pair[open_] + 1))
                i = s.pair[open_] + 1
                continue
        i += 1
    return rules, calls_in(s, a, b, skip)


def early_exit(s: Source, a: int, b: int) -> bool:
    return any(s.kind(i) == "name" and s.t(i) in ("return", "throw", "continue", "break") and s.t(i - 1) not in (".", "?.") or s.t(i) == "exit" and s.t(i - 2) == "process" and s.t(i + 1) == "(" for i in range(a, b))


def parameters(s: Source, open_: int) -> list[dict]:
    out = []
    for a, b in arguments(s, open_):
        while a < b and (s.t(a) in MODIFIERS and s.kind(a + 1) == "name" or s.t(a) == "@"):
            if s.t(a) == "@":
                a += 2
                while s.t(a) == ".":
                    a += 2
                if s.t(a) == "(":
                    a = s.pair[a] + 1
            else:
                a += 1
        end = s.pair[a] + 1 if s.kind(a) == "op" and s.t(a) in "{[" else a + 1 + (s.t(a) == "...")
        name = s.raw(a, end).lstrip(".")
        if s.t(end) == "?":
            end += 1
        kind, stop = "unknown", b
        if s.t(end) == ":":
            depth = end + 1
            while depth < b and not (s.t(depth) == "=" and s.kind(depth) == "op"):
                depth = s.pair[depth] + 1 if s.kind(depth) == "op" and s.t(depth) in "({[" else depth + 1
            stop = depth
            kind = " ".join(s.raw(end + 1, stop).split())
        out.append({"name": name, "type": kind})
    return out


def declaration(s: Source, i: int) -> tuple[list[str], int, str | None, int]:
    """From a name's end: type parameters, parameter list's bracket, result type, and the body's first token or end."""
    k = s.skip_angles(i)
    types = [x.split()[0] for x in re.split(r",(?![^<]*>)", s.raw(i + 1, k - 1)) if x.strip()] if k > i else []
    if s.t(k) != "(":
        return types, -1, None, k
    j, result = s.pair[k] + 1, None
    if s.t(j) == ":":
        a = j + 1
        j = a
        while j < len(s.tokens) and not (s.kind(j) == "op" and s.t(j) in (";", "=>", ",", ")", "}")) and not (s.t(j) == "{" and j > a and s.t(j - 1) not in (":", "|", "&", "=>", "<", ",")):
            if s.breaks[j] and j > a and s.kind(j) == "name" and s.t(j - 1) not in ("|", "&", "is", "keyof", "typeof"):
                break
            nxt = s.skip_angles(j) if s.t(j) == "<" else j
            j = nxt if nxt > j else (s.pair[j] + 1 if s.kind(j) == "op" and s.t(j) in "({[" else j + 1)
        result = " ".join(s.raw(a, j).split())
    return types, k, result, j


def decorators_at(s: Source, i: int) -> tuple[list[dict], int]:
    out = []
    while s.t(i) == "@" and s.kind(i) == "op":
        a, j = i, i + 1
        while s.kind(j) == "name" or s.t(j) == ".":
            if s.kind(j) == "name" and s.t(j + 1) != ".":
                j += 1
                break
            j += 1
        name, args = s.raw(a + 1, j), []
        if s.t(j) == "(" and s.kind(j) == "op":
            args = [s.raw(x, y) for x, y in arguments(s, j)]
            j = s.pair[j] + 1
        out.append({"name": name.split(".")[-1], "raw": s.raw(a, j), "arguments": args, "boundary": False, "line": s.line(a)})
        i = j
    return out, i


class File:
    """Extraction of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.s = path, Source(text.removeprefix("﻿"))
        self.symbols: list[dict] = []
        self.seen: dict[str, int] = {}
        self.imports = self._imports()
        self._statements(0, len(self.s.tokens), [])
        self.symbols.sort(key=lambda x: x["id"].encode("utf-16-be"))

    def _emit(self, name: str, kind: str, a: int, b: int, body: tuple[int, int] | None, visibility: str, derived: list[str], marks: list[dict], signature: dict | None = None, **more) -> None:
        s = self.s
        rules, calls = walk(s, *body) if body else ([], [])
        text = " ".join(t[1] for t in s.tokens[(body or (a, b))[0] : (body or (a, b))[1]])
        inner = s.raw(*body) if body else ""
        jsx = re.search(r"(?:return|=>|[(?:&,])\s*\(?\s*<(?:([A-Za-z][\w.]*)|>)", inner) if body and re.search(r"x$", self.path) else None
        if signature is not None:
            doc = s.docs.get(a, "")
            tags = re.findall(r"@(?:throws|exception)\s+\{?([\w$.]+)\}?", doc)
            signature = {**signature, "throws": sorted({r["what"] for r in rules if r["type"] == "throw"} | set(tags)), "inferred_throws": []}
        own = [{"target": c["target"], "line": c["line"], "argument_count": len(c["args"]), "in_await": c["in_await"], "in_new": c["in_new"], "literal_args": [literal(s, *r) for r in c["args"]], "dynamic_receiver": c["dynamic"]} for c in calls]
        own.sort(key=lambda c: (c["line"], c["target"]))
        self.symbols.append(
            {
                "id": f"ts:{self.path}#{name}", "kind": kind, "name": name, "visibility": visibility, "decorators": marks, "signature": signature, "rules": rules, "calls": own, "start_line": s.line(a), "end_line": s.line(max(a, b - 1)), "derived_by": derived,
                "normalized": text or name, "has_body": body is not None, "empty_body": body is not None and body[1] - body[0] <= 2, "has_jsx": jsx is not None, "returned_jsx": (re.search(r"return\s*\(?\s*<([A-Za-z][\w.]*)", inner) or [None, None])[1] if jsx else None,
                "wrapper": None, "fields_only": False, "constants_only": False, "method": None, "argument_shapes": [], **more,
            }
        )

    def _imports(self) -> list[dict]:
        s, out = self.s, []

        def add(i, source, symbols, star=False, space=None, dynamic=False):
            if source:
                out.append({"source": source, "symbols": symbols, "is_star": star, "line": s.line(i), "dynamic": dynamic, "namespace_binding": space})

        for i in range(len(s.tokens)):
            t = s.t(i)
            if s.kind(i) != "name" or t not in ("import", "export") or s.t(i - 1) in (".", "?."):
                continue
            if t == "import" and s.t(i + 1) == "(":
                add(i, s.t(i + 2).strip("'\"`") if s.kind(i + 2) == "string" else "", [], dynamic=True)
                continue
            if t == "import" and s.kind(i + 1) == "string":
                add(i, s.t(i + 1).strip("'\""), [])
                continue
            j = i + 1 + (s.t(i + 1) == "type" and s.t(i + 2) != "from")
            names, star, space = [], False, None
            while j < len(s.tokens) and s.t(j) != "from":
                if s.t(j) == "{":
                    for a, b in arguments(s, j):
                        a += s.t(a) == "type" and b - a > 1 and s.t(a + 1) != "as"
                        names.append(" ".join(x[1] for x in s.tokens[a:b]))
                    j = s.pair[j] + 1
                elif s.t(j) == "*":
                    star = True
                    space = s.t(j + 2) if s.t(j + 1) == "as" else None
                    j += 3 if space else 1
                elif s.kind(j) == "name" and t == "import":
                    names.append(s.t(j))
                    j += 1
                elif s.t(j) == ",":
                    j += 1
                else:
                    break
            if s.t(j) == "from" and s.kind(j + 1) == "string":
                add(i, s.t(j + 1).strip("'\""), names, star, space)
        keyed = {(x["line"], x["source"], x["dynamic"], tuple(sorted(x["symbols"]))): x for x in reversed(out)}
        return sorted(keyed.values(), key=lambda x: (x["line"], x["source"]))

    def _statements(self, i: int, end: int, outer: list[str]) -> None:
        s = self.s
        while i < end:
            start = i
            marks, i = decorators_at(s, i)
            tags, default = [], False
            if s.t(i) == "export" and s.kind(i) == "name":
                i += 1
                tags = ["export-keyword"]
                if s.t(i) == "default":
                    i, default, tags = i + 1, True, ["export-default"]
                more, i = decorators_at(s, i)
                marks += more
            while s.t(i) in ("declare", "abstract", "async") and s.kind(i + 1) == "name" and not s.breaks[i + 1]:
                i += 1
            visible = "public" if tags else "internal"
            i = max(self._statement(start, i, end, outer, marks, tags, default, visible), start + 1)

    def _statement(self, start, i, end, outer, marks, tags, default, visible) -> int:
        s, t = self.s, self.s.t(i)
        name = lambda n: ".".join([*outer, n])
        if t == "function" and s.kind(i) == "name":
            gen = s.t(i + 1) == "*"
            j = i + 1 + gen
            own = s.t(j) if s.kind(j) == "name" else "<default>"
            return self._function(start, j + (own != "<default>"), name(own), tags, marks, visible, s.t(i - 1) == "async", gen)
        if t == "class" and s.kind(i) == "name":
            own = s.t(i + 1) if s.kind(i + 1) == "name" and s.t(i + 1) not in ("extends", "implements") else "<default>"
            j = i + 1
            while s.t(j) != "{" and j < end:
                j = s.skip_angles(j) if s.t(j) == "<" and s.skip_angles(j) > j else j + 1
            if j >= end:
                return end
            self._class(start, j, name(own), tags, marks, visible, own == "<default>")
            return s.pair[j] + 1
        if t in ("interface", "enum", "namespace", "module") and s.kind(i + 1) in ("name", "string") or (t == "const" and s.t(i + 1) == "enum"):
            i += t == "const"
            t = s.t(i)
            j = i + 1
            while s.t(j) != "{" and j < end:
                j = s.skip_angles(j) if s.t(j) == "<" and s.skip_angles(j) > j else j + 1
            if j >= end:
                return end
            kind, tag = {"interface": ("interface", "interface-declaration"), "enum": ("enum", "enum-declaration")}.get(t, ("namespace", "namespace-declaration"))
            own = s.raw(i + 1, j).split("<")[0].split(" extends")[0].strip().strip("'\"")
            self._emit(name(own), kind, start, s.pair[j] + 1, None, visible, [tag], marks)
            if kind == "namespace":
                self._statements(j + 1, s.pair[j], [*outer, own])
            return s.pair[j] + 1
        if t == "type" and s.kind(i + 1) == "name" and s.t(s.skip_angles(i + 2)) == "=":
            stop = s.statement_end(i, end)
            self._emit(name(s.t(i + 1)), "type", start, stop, None, visible, ["type-alias"], marks)
            return stop
        if t in ("const", "let", "var") and s.kind(i) == "name":
            return self._variables(start, i + 1, end, outer, tags, marks, visible)
        if default:
            stop = s.statement_end(i, end)
            arrow = self._arrow(i, stop)
            if arrow is not None:
                self._callable(start, stop, name("<default>"), arrow, tags, marks, visible)
            return stop
        if s.kind(i) == "op" and t == "{":
            return s.pair[i] + 1
        stop = s.statement_end(i, end)
        if not outer and not tags:
            self._promote(i, stop)
        return stop

    def _signature(self, open_: int, result: str | None, types: list[str], is_async: bool, gen: bool) -> dict:
        return {"inputs": parameters(self.s, open_) if open_ >= 0 else [], "outputs": [result] if result else [], "throws": [], "inferred_throws": [], "async": is_async, "generator": gen, "type_parameters": types}

    def _function(self, start, j, own, tags, marks, visible, is_async, gen, kind="function", derived=None) -> int:
        s = self.s
        types, open_, result, at = declaration(s, j)
        body = (at, s.pair[at] + 1) if s.t(at) == "{" and s.kind(at) == "op" else None
        stop = body[1] if body else min(at + (s.t(at) == ";"), len(s.tokens))
        base = derived if derived is not None else ["function-declaration"]
        self._emit(own, kind, start, max(stop, start + 1), body, visible, [*base, *tags], marks, self._signature(open_, result, types, is_async, gen))
        return max(stop, j)

    def _arrow(self, a: int, b: int):
        """Of an arrow function or function expression in a..b: async, types, parameter bracket or a lone name, result, body."""
        s, i = self.s, a
        is_async = s.t(i) == "async" and s.kind(i) == "name" and s.t(i + 1) != "=>"
        i += is_async
        if s.t(i) == "function":
            gen = s.t(i + 1) == "*"
            j = i + 1 + gen
            j += s.kind(j) == "name"
            types, open_, result, at = declaration(s, j)
            return (is_async, gen, types, open_, None, result, (at, s.pair[at] + 1)) if s.t(at) == "{" else None
        if s.kind(i) == "name" and s.t(i + 1) == "=>":
            at, types, open_, lone, result = i + 2, [], -1, s.t(i), None
        else:
            types, open_, result, at = declaration(s, i)
            if open_ < 0 or s.t(at) != "=>":
                return None
            at, lone = at + 1, None
        body = (at, s.pair[at] + 1) if s.t(at) == "{" and s.kind(at) == "op" else (at, b - (s.t(b - 1) == ";"))
        return is_async, False, types, open_, lone, result, body

    def _callable(self, start, stop, own, arrow, tags, marks, visible, derived=("function-declaration",)) -> None:
        is_async, gen, types, open_, lone, result, body = arrow
        sig = self._signature(open_, result, types, is_async, gen)
        if lone:
            sig["inputs"] = [{"name": lone, "type": "unknown"}]
        self._emit(own, "function", start, stop, body, visible, [*derived, *tags], marks, sig)

    def _variables(self, start, i, end, outer, tags, marks, visible) -> int:
        s = self.s
        stop = s.statement_end(i, end)
        last = stop - (s.t(stop - 1) == ";")
        a = i
        while a < last:
            b = a
            while b < last and not (s.kind(b) == "op" and s.t(b) == ","):
                nxt = s.skip_angles(b) if s.t(b) == "<" and s.kind(b - 1) == "name" else b
                b = nxt if nxt > b else (s.pair[b] + 1 if s.kind(b) == "op" and s.t(b) in "({[" else b + 1)
            if s.kind(a) == "name":
                eq = a + 1
                while eq < b and not (s.kind(eq) == "op" and s.t(eq) == "="):
                    eq = s.pair[eq] + 1 if s.kind(eq) == "op" and s.t(eq) in "({[" else eq + 1
                own = ".".join([*outer, s.t(a)])
                arrow = self._arrow(eq + 1, b) if eq < b else None
                if arrow is not None:
                    self._callable(start, b, own, arrow, tags, marks, visible, ("variable-assigned-function",))
                else:
                    made = calls_in(s, eq + 1, b) if eq < b else []
                    first = next((c["target"] for c in made if c["at"] == eq + 1), None)
                    self._emit(own, "const", start, b, None, visible, list(tags), marks, wrapper=first)
            a = b + 1
        return stop

    def _class(self, start, open_, own, tags, marks, visible, anonymous) -> None:
        s, end = self.s, self.s.pair[open_]
        members, fields, methods, constant = [], 0, 0, True
        i = open_ + 1
        while i < end:
            a = i
            m, i = decorators_at(s, i)
            words = set()
            while s.t(i) in MODIFIERS and s.kind(i) == "name" and s.t(i + 1) not in ("(", "=", ":", ";", "?", "<", "}"):
                words.add(s.t(i))
                i += 1
            gen = s.t(i) == "*"
            i += gen
            if s.t(i) == ";":
                i += 1
                continue
            n = s.t(i).strip("'\"")
            j = s.pair[i] + 1 if s.kind(i) == "op" and s.t(i) == "[" else i + 1
            j += s.t(j) in ("?", "!")
            if s.t(s.skip_angles(j)) == "(" and s.t(i) != "{":
                methods += 1
                types, p, result, at = declaration(s, j)
                body = (at, s.pair[at] + 1) if s.t(at) == "{" and s.kind(at) == "op" else None
                members.append((a, i, n, words, gen, types, p, result, body, m))
                i = body[1] if body else max(at + (s.t(at) == ";"), j)
            else:
                stop = s.statement_end(i, end)
                if s.t(i) != "{":
                    fields += 1
                    eq = next((k for k in range(i, stop) if s.t(k) == "=" and s.kind(k) == "op"), None)
                    constant &= bool(words & {"static", "readonly"}) and eq is not None and s.kind(eq + 1) in ("string", "number", "template")
                i = max(stop, i + 1)
        tag = ["class-declaration", *tags]
        self._emit(own, "class", start, end + 1, (open_, end + 1), visible, tag, marks, fields_only=methods == 0 and fields > 0, constants_only=methods == 0 and fields > 0 and constant)
        if anonymous:
            return
        for a, i, n, words, gen, types, p, result, body, m in members:
            static = "static" in words
            seen = "private" if n.startswith("#") or "private" in words else "protected" if "protected" in words else "public"
            kind = "constructor" if n == "constructor" else "method"
            derived = ["static-method" if static else "class-method", *(["constructor-declaration"] if kind == "constructor" else [])]
            self._emit(f"{own}{'::' if static else '.'}{n}", kind, a, body[1] if body else i + 1, body, seen, derived, m, self._signature(p, result, types, "async" in words, gen))

    def _promote(self, a: int, b: int) -> None:
        s = self.s
        top = [c for c in calls_in(s, a, b) if c["at"] in (a, a + (s.t(a) == "await"))]
        if not top:
            return
        call = max(top, key=lambda c: c["end"])
        parts = call["target"].split(".")
        if len(parts) < 2 or parts[-1] not in PROMOTED or s.kind(a) != "name":
            return
        path = s.t(call["args"][0][0])[1:-1] if call["args"] and s.kind(call["args"][0][0]) == "string" and call["args"][0][1] - call["args"][0][0] == 1 else None
        slug = "".join("$" if c == "/" else "Z" if c == ":" else c if re.match(r"[A-Za-z0-9_$]", c) else "_" for c in path or "")
        base = f"{parts[0]}__{parts[-1]}" + (f"__{slug}" if slug else "")
        n = self.seen[base] = self.seen.get(base, -1) + 1
        shapes = []
        for x, y in call["args"]:
            arrow = self._arrow(x, y)
            kind = "string" if s.kind(x) == "string" and y - x == 1 else "function" if arrow else "identifier" if s.kind(x) == "name" and y - x == 1 else "other"
            shapes.append({"kind": kind, "arity": (1 if arrow[4] else len(arguments(s, arrow[3]))) if arrow else None})
        tags = [f"call-statement:{parts[0]}.{parts[-1]}", *(["chained-call"] if call["dynamic"] else []), *([f"path-literal:{path}"] if path is not None else [])]
        self._emit(f"{base}__d{n}", "call", a, b, None, "internal", tags, [], method=parts[-1], argument_shapes=shapes)


SYMBOL = (
    "struct<id:string,kind:string,name:string,visibility:string,decorators:array<struct<name:string,raw:string,arguments:array<string>,boundary:boolean,line:int>>,"
    "signature:struct<inputs:array<struct<name:string,type:string>>,outputs:array<string>,throws:array<string>,inferred_throws:array<string>,async:boolean,generator:boolean,type_parameters:array<string>>,"
    "rules:array<struct<type:string,line:int,condition:string,what:string,expr:string,loop_kind:string>>,"
    "calls:array<struct<target:string,line:int,argument_count:int,in_await:boolean,in_new:boolean,literal_args:array<string>,dynamic_receiver:boolean>>,"
    "start_line:int,end_line:int,derived_by:array<string>,normalized:string,has_body:boolean,empty_body:boolean,has_jsx:boolean,returned_jsx:string,wrapper:string,fields_only:boolean,constants_only:boolean,method:string,argument_shapes:array<struct<kind:string,arity:int>>>"
)
IMPORT = "struct<source:string,symbols:array<string>,is_star:boolean,line:int,dynamic:boolean,namespace_binding:string>"


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}[type(kind)]


def extract(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, symbols, imports, error (null where the file could be read)."""
    from ..schema import struct

    schema = struct(f"path string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, error string")
    kinds = [_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    f = File(path, text or "")
                    rows.append((path, f.symbols, f.imports, None))
                except Exception as e:  # noqa: BLE001  one file's fault stays that file's
                    rows.append((path, [], [], f"{type(e).__name__}: {e}"))
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    # a table of many small texts is read in few tasks, while cutting them takes most of the time
    spread = files.select("path", "text").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(run, schema)


def imports(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", "i.*")
