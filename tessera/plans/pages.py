"""The full page of a difference. Every line is a row made beside its symbol; the page is their order by ORDER.

entries(section, part, key, at, lines) say what stands where; a section or part without entries has no heading either. No
entry holds more than one symbol, edge, component or file, so a page is as distributed as the difference itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import looks_like_symbol
from ..operators.diff import Diff
from .project import badge, call_row, code, effect_row, rule_row, signature_line, summary_line

#: Sections in order: name, title, whether it is folded.
SECTIONS = (
    ("api", "API changes", False),
    ("logic", "Logic changes", False),
    ("slices", "Slices", False),
    ("added", "Added", False),
    ("removed", "Removed", False),
    ("unknown", "Unknown", False),
    ("not-compared", "Not compared", False),
    ("moved+changed", "Moved and changed", False),
    ("moved", "Moved", True),
    ("components", "Components", False),
    ("dependencies", "Dependencies", False),
    ("dropped-toggled", "Dropped toggled", True),
    ("syntax", "Syntax only", True),
)
NAMES = tuple(s[0] for s in SECTIONS)
#: Titles of parts; {n} is the number of entries. A part that is not named here has no heading.
PARTS = {
    ("slices", 2): "### Standalone changes ({n})",
    ("components", 0): "### Added", ("components", 1): "### Removed", ("components", 2): "### Changed",
    ("dependencies", 0): "### Between components, added", ("dependencies", 1): "### Between components, removed",
    ("dependencies", 2): "### Between symbols, added", ("dependencies", 3): "### Between symbols, removed",
    ("dependencies", 4): "### Unknown: the other side did not read one end",
    ("dropped-toggled", 0): "**{n} to-dropped**", ("dropped-toggled", 1): "**{n} to-kept**",
}
ORDER = ("section", "part", "key", "at", "n")
LAST = 1 << 30


def _none() -> Column:
    return F.array().cast("array<string>")


def _s(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _tick(c: Column) -> Column:
    return _s("`", c, "`")


def _if(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(_none())


def _some(array: Column) -> Column:
    return F.size(F.coalesce(array, _none())) > 0


def _place(s: Column) -> Column:
    return _s("`", s["source"]["file"], ":", s["source"]["start_line"], "`")


def _heading(s: Column) -> list[Column]:
    return [_s("### `", s["name"], "` _(", s["kind"], ")_"), _s("File: ", _place(s))]


def _sorted(array: Column, key) -> Column:
    return F.transform(F.array_sort(F.transform(array, lambda x, i: F.struct(*key(x), i.alias("i"), x.alias("x")))), lambda y: y["x"])


def symbol_block(s: Column) -> Column:
    """What is known of a symbol below its heading: decorators, signature, rules, effects (own by line, then far ones by id
    and target), calls, fingerprints. What is empty or null has no lines."""
    far = lambda e: F.coalesce(e["propagated"], F.lit(False))
    by_line = lambda x: (x["line"].alias("k"),)
    effects = _sorted(s["effects"], lambda e: (far(e).alias("far"), F.when(far(e), 0).otherwise(F.coalesce(e["line"], F.lit(0))).alias("k"), F.when(far(e), e["id"]).alias("id"), F.when(far(e), e["target"]).alias("target")))
    rows = lambda title, array, one: F.when(F.size(array) > 0, F.concat(F.array(F.lit(title)), F.transform(array, one))).otherwise(_none())
    marks = F.transform(s["decorators"], lambda d: _s("- `@", F.coalesce(d["raw"], d["name"]), "`", F.when(d["boundary"], " (boundary)").otherwise("")))
    sig = _if(s["signature"].isNotNull(), _s("Signature: ", code(signature_line(s["name"], s["signature"]))))
    print_ = s["fingerprint"]
    parts = (F.coalesce(marks, _none()), sig, rows("Rules:", _sorted(s["rules"], by_line), rule_row), rows("Effects:", effects, effect_row), rows("Calls:", _sorted(s["calls"], by_line), call_row), _if(print_.isNotNull(), _s("api `", print_["api"], "` · logic `", print_["logic"], "` · syntax `", print_["syntax"], "`")))
    return F.concat(*(F.coalesce(p, _none()) for p in parts))


def _detail(r: Column) -> Column:
    detail = F.coalesce(r["condition"], r["what"], r["expr"])
    return _s(r["type"], F.when(detail.isNull(), "").otherwise(_s(": ", _tick(detail))), " (line ", r["line"], ")")


DESCRIBE = {
    "rules": _detail,
    "effects": lambda e: _s(e["id"], " ", _tick(e["target"]), F.when(e["line"].isNull(), "").otherwise(_s(" (line ", e["line"], ")")), badge(e["confidence"])),
    "calls": lambda c: _s(_tick(c["target"]), " (line ", c["line"], ")"),
}


def _mark(how: str):
    return lambda d: _s(f"- decorator {how}: `@", d["name"] if how == "modified" else F.coalesce(d["raw"], d["name"]), "`")


def _indented(say):
    return lambda x: _s("  - ", say(x))


def delta_body() -> Column:
    """Lines of one row of symbol_deltas(): signature, decorators, rules, effects, calls, flags. Where a fingerprint moved
    and nothing else did, one line says which."""
    sig, flags, inputs = F.col("signature_delta"), F.col("flags"), F.col("inputs_delta")
    inline = lambda title, values: _if(_some(values), _s(f"- {title}: ", F.array_join(F.transform(values, _tick), ", ")))
    listed = lambda values: F.when(_some(values), F.array_join(values, " | ")).otherwise("none")
    out, throws = sig["outputs"], sig["throws"]
    parts = [
        _if(_some(out["added"]) | _some(out["removed"]), _s("- outputs: `", listed(out["removed"]), "` → `", listed(out["added"]), "`")),
        inline("outputs modified", out["modified"]),
        *(inline(f"throws {how}", throws[how]) for how in ("added", "removed")),
        *(inline(f"inputs {how}", F.transform(inputs[how], lambda p: _s(p["name"], ": ", p["type"]))) for how in ("added", "removed", "modified")),
        *(_if(sig[f"{f}_changed"], F.lit(f"- {f}: toggled")) for f in ("async", "generator")),
        _if(sig["type_parameters_changed"], F.lit("- type parameters: changed")),
    ]
    marks = F.col("decorators_delta")
    parts += [F.transform(marks[how], _mark(how)) for how in ("added", "removed", "modified")]
    for kind, say in DESCRIBE.items():
        for how in ("added", "removed", "modified"):
            values = F.col(f"{kind}_delta")[how]
            parts.append(F.when(F.size(values) > 0, F.concat(F.array(F.lit(f"- {kind} {how}:")), F.transform(values, _indented(say)))).otherwise(_none()))
    parts += [_if(flags[f"{f}_changed"], F.lit(f"- {f}: changed")) for f in ("component", "visibility")]
    rows = F.concat(*(F.coalesce(p, _none()) for p in parts))
    moved = F.when(flags["api_changed"], "api").when(flags["logic_changed"], "logic").when(flags["syntax_changed"], "syntax")
    return F.when(F.size(rows) > 0, rows).otherwise(_if(moved.isNotNull(), _s("- the ", moved, " fingerprint changed, no field did")))


def axes(flags: Column) -> Column:
    names = ("api", "logic", "syntax", "component", "visibility")
    found = F.array_compact(F.array(*(F.when(flags[f"{n}_changed"], n) for n in names)))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("no axis")


def _entry(df: DataFrame, section: str | Column, part: int | Column, key: Column, lines: Column, at: int | Column = 0) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    number = F.lit(NAMES.index(section)) if isinstance(section, str) else section
    return df.select(number.cast("int").alias("section"), lit(part).cast("int").alias("part"), key.alias("key"), lit(at).cast("int").alias("at"), lines.alias("lines"))


def of_deltas(deltas: DataFrame) -> DataFrame:
    """Changed symbols below the first of api, logic and syntax that changed; moved and changed ones in their own section
    too, with what they came from."""
    s, flags = F.col("head"), F.col("flags")
    no = NAMES.index
    whole = F.concat(F.array(*_heading(s)), F.array(F.lit("")), F.col("body"), F.array(F.lit("")))
    brief = F.array(_s("- ", _tick(s["name"]), " (", _place(s), ")"))
    first = F.when(flags["api_changed"], F.struct(F.lit(no("api")).alias("section"), whole.alias("lines"))).when(flags["logic_changed"], F.struct(F.lit(no("logic")).alias("section"), whole.alias("lines"))).when(flags["syntax_changed"], F.struct(F.lit(no("syntax")).alias("section"), brief.alias("lines")))
    moved = F.concat(F.array(_heading(s)[0], _s("Moved: `", F.col("base.source.file"), "` → `", s["source"]["file"], "` (`", F.coalesce("rationale", F.lit("")), "`)")), F.col("body"), F.array(F.lit("")))
    own = F.when(F.col("status") == "moved+changed", F.struct(F.lit(no("moved+changed")).alias("section"), moved.alias("lines")))
    rows = deltas.withColumn("body", delta_body()).select("head_id", F.explode(F.array_compact(F.array(first, own))).alias("r"))
    return _entry(rows, F.col("r.section"), 0, F.col("head_id"), F.col("r.lines"))


def of_pairs(full: DataFrame) -> DataFrame:
    """Mere moves, and symbols that were dropped or kept on one side only. One dropped without a reason is an error."""
    b, h = F.col("base"), F.col("head")
    moved = _s("- ", _tick(h["name"]), ": `", b["source"]["file"], "` → `", h["source"]["file"], "` (`", F.coalesce("rationale", F.lit("")), "`)")
    why = F.coalesce(h["drop_reason"], F.raise_error(_s(h["id"], " is dropped without a reason")).cast("string"))
    toggled = F.when(h["dropped"], _s("- ", _tick(h["id"]), ": ", why)).otherwise(_s("- ", _tick(h["id"])))
    out = _entry(full.where("status = 'moved'"), "moved", 0, F.col("head_id"), F.array(moved))
    return out.unionByName(_entry(full.where("status = 'dropped-toggled'"), "dropped-toggled", F.when(h["dropped"], 0).otherwise(1), F.col("head_id"), F.array(toggled)))


def unpaired(found: Diff) -> DataFrame:
    """found.left without dropped ones, with their symbol (struct s) from the side that has them."""
    side = lambda d, *status: found.left.where(~F.col("dropped") & ((F.col("status") == status[0]) | (F.col("absent_from") == status[1]))).select("id", "status", "absent_from", "reason").join(d.select("id", F.struct(*d.columns).alias("s")), "id")
    base, head = found.sides
    return side(base.symbols, "removed", "head").unionByName(side(head.symbols, "added", "base"))


def _why(side: Column, file: Column, reason: Column) -> Column:
    return _s("the ", side, " side did not read ", _tick(file), " (", reason, "), so it ", F.when(side == "head", "may still exist").otherwise("may not be new"))


def of_left(left: DataFrame) -> DataFrame:
    s = F.col("s")
    why = _if(F.col("status") == "unknown", _s("Why: ", _why(F.col("absent_from"), s["source"]["file"], F.col("reason"))))
    section = F.array_position(F.array(*map(F.lit, NAMES)), F.col("status")) - 1
    return _entry(left, section, 0, F.col("id"), F.concat(F.array(*_heading(s)), why, symbol_block(s), F.array(F.lit(""))))


def of_slices(found: Diff, left: DataFrame) -> DataFrame:
    """Slices of several symbols member by member, then those of one. A member without a change is an error."""
    lost = lambda s: F.size(F.filter(F.coalesce(s["calls"], F.array().cast("array<struct<target:string,line:int,resolved:string>>")), lambda c: c["resolved"].isNull()))
    told = lambda s, follow: (s["name"].alias("name"), _place(s).alias("place"), F.greatest(lost(s), F.lit(0)).alias("lost"), follow.alias("follow"))
    from ..operators.delta import flags

    h, s = F.col("head"), F.col("s")
    pair = F.when(F.col("status") == "dropped-toggled", F.when(h["dropped"], "to-dropped").otherwise("to-kept")).otherwise(axes(flags(F.col("base"), h)))
    a = found.full.where("status not in ('unchanged', 'moved')").select(F.col("head_id").alias("member"), "status", *told(h, pair))
    b = left.select(F.col("id").alias("member"), "status", *told(s, F.when(F.col("status") == "unknown", _why(F.col("absent_from"), s["source"]["file"], F.col("reason"))).otherwise(_s(F.col("status"), " symbol"))))
    members = found.slices.select("id", F.size("members").alias("size"), F.posexplode("members").alias("at", "member")).join(a.unionByName(b), "member", "left")
    name = F.coalesce("name", F.raise_error(_s("slice ", F.col("id"), " holds ", F.col("member"), ", which did not change")).cast("string"))
    calls = F.when(F.col("lost") == 0, "").when(F.col("lost") == 1, " · 1 unresolved call").otherwise(_s(" · ", F.col("lost"), " unresolved calls"))
    one = F.array(_s("- `", F.col("id"), "`: `", name, "` _(", F.col("status"), ")_", calls))
    several = F.array(_s("- `", name, "` _(", F.col("status"), ")_, ", F.col("place")), _s("  ↳ ", F.col("follow"), calls))
    alone = F.col("size") == 1
    rows = _entry(members, "slices", F.when(alone, 2).otherwise(1), F.col("id"), F.when(alone, one).otherwise(several), F.col("at") + 1)
    heads = found.slices.where("size(members) > 1")
    rows = rows.unionByName(_entry(heads, "slices", 1, F.col("id"), F.array(_s("### `", F.col("id"), "` (", F.size("members"), " members)"), F.lit("")))).unionByName(_entry(heads, "slices", 1, F.col("id"), F.array(F.lit("")), LAST))
    census = members.agg(F.count_if(F.col("lost") > 0).alias("n"), F.sum("lost").alias("calls")).where("calls > 0")
    return rows.unionByName(_entry(census, "slices", 0, F.lit(""), F.array(_s("> ", F.col("n"), " of the changed symbols make ", F.col("calls"), " calls that were not resolved, so a slice may be split."), F.lit(""))))


def of_components(changes: DataFrame) -> DataFrame:
    part = F.array_position(F.array(F.lit("added"), F.lit("removed"), F.lit("changed")), F.col("status")) - 1
    more = F.when(F.col("status") == "added", _s(": ", F.array_join(F.transform("roots", _tick), ", "))).when(F.col("status") == "changed", _s(": ", F.array_join("fields", ", "))).otherwise("")
    return _entry(changes, "components", part, F.col("id"), F.array(_s("- ", _tick(F.col("id")), more)))


def of_dependencies(changes: DataFrame) -> DataFrame:
    of_symbols = looks_like_symbol(F.col("from")) | looks_like_symbol(F.col("to"))
    part = F.when(F.col("status") == "unknown", 4).otherwise(F.when(of_symbols, 2).otherwise(0) + F.when(F.col("status") == "removed", 1).otherwise(0))
    lost = F.array_join(F.transform("lost", lambda f: _s(_tick(f["path"]), " (", f["reason"], ")")), ", ")
    more = F.when(F.col("status") == "unknown", _s(": the ", F.col("absent_from"), " side did not read ", lost)).otherwise("")
    key = F.concat_ws("\t", "from", "to", "via")
    return _entry(changes, "dependencies", part, key, F.array(_s("- `", F.col("from"), "` → `", F.col("to"), "` (`", F.col("via"), "`)", more)))


def of_not_compared(files: DataFrame) -> DataFrame:
    same = F.col("base_reason") == F.col("head_reason")
    why = F.when(same, _s(F.col("base_reason"), " on both sides")).otherwise(_s(F.col("base_reason"), " in base, ", F.col("head_reason"), " in head"))
    return _entry(files, "not-compared", 0, F.col("path"), F.array(_s("- ", _tick(F.col("path")), ": ", why)))


def entries(found: Diff) -> DataFrame:
    left = unpaired(found)
    parts = [of_deltas(found.deltas), of_pairs(found.full), of_left(left), of_slices(found, left), of_dependencies(found.dependencies), of_not_compared(found.not_compared)]
    parts += [of_components(found.components)] if found.components is not None else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lines(found_entries: DataFrame) -> DataFrame:
    """(section, part, key, at, n, line) of entries with the headings of what occurs; folded sections end in a line of
    their own. Headings are counted per section and part, a bounded number of rows."""
    body = found_entries.select("section", "part", "key", "at", F.posexplode("lines").alias("n", "line"))
    counts = found_entries.groupBy("section", "part").agg(F.count("*").alias("n")).select("section", "part", "n")
    by_part = F.lit(None).cast("string")
    for (section, part), title in PARTS.items():
        before, _, after = title.partition("{n}")
        text = _s(before, F.col("n"), after) if "{n}" in title else F.lit(title)
        by_part = F.when((F.col("section") == NAMES.index(section)) & (F.col("part") == part), text).otherwise(by_part)
    parts = counts.withColumn("line", by_part).where("line is not null").select("section", "part", F.lit("").alias("key"), F.lit(-1).alias("at"), F.posexplode(F.array(F.lit(""), F.col("line"), F.lit(""))).alias("n", "line"))
    titles = F.element_at(F.array(*(F.lit(s[1]) for s in SECTIONS)), F.col("section") + 1)
    folded = F.element_at(F.array(*(F.lit(s[2]) for s in SECTIONS)), F.col("section") + 1)
    one = counts.groupBy("section").agg(F.sum("n").alias("n")).withColumn("folded", folded)
    fold = F.when(F.col("folded"), F.array(_s("<details><summary>", F.col("n"), " entries</summary>"), F.lit(""))).otherwise(_none())
    first = one.select("section", F.lit(-1).alias("part"), F.lit("").alias("key"), F.lit(0).alias("at"), F.posexplode(F.concat(F.array(F.lit(""), _s("## ", titles), F.lit("")), fold)).alias("n", "line"))
    last = one.where("folded").select("section", F.lit(LAST).alias("part"), F.lit("").alias("key"), F.lit(0).alias("at"), F.posexplode(F.array(F.lit(""), F.lit("</details>"))).alias("n", "line"))
    return body.unionByName(parts).unionByName(first).unionByName(last)


def head_lines(found: Diff, base_ref: str, head_ref: str) -> list[str]:
    return [f"# Semantic diff: {base_ref}..{head_ref}", "", summary_line(found.summary).first().line]


def write(found: Diff, path: str, base_ref: str = "base", head_ref: str = "head") -> None:
    """The page as text files in a folder, whose names' order is the page's; for a difference of any size."""
    every = lines(entries(found))
    spark = every.sparkSession
    first = spark.createDataFrame([(-1, 0, "", 0, n, line) for n, line in enumerate(head_lines(found, base_ref, head_ref))], every.schema)
    every.unionByName(first).orderBy(*ORDER).select("line").write.mode("overwrite").text(path)


def save(found: Diff, path: str, base_ref: str = "base", head_ref: str = "head") -> None:
    """The page as one local file. Lines pass through the driver partition by partition."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in head_lines(found, base_ref, head_ref))
        f.writelines(f"{r.line}\n" for r in lines(entries(found)).orderBy(*ORDER).toLocalIterator())
