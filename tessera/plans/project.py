"""Markdown of snapshots and differences. Lines are made in DataFrames and joined in order at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mermaid_id, mermaid_label
from ..operators import aggregates
from ..operators.resolve import BUCKETS

SECTIONS = ("changed", "added", "removed", "unknown", "moved+changed", "moved", "dropped-toggled")
TITLES = {"changed": "Changed", "added": "Added", "removed": "Removed", "unknown": "Unknown", "moved+changed": "Moved and changed", "moved": "Moved", "dropped-toggled": "Dropped toggled"}


def badge(confidence: Column) -> Column:
    return F.when(confidence == "high", "").otherwise(F.concat(F.lit(" _("), confidence, F.lit(")_")))


def code(s: Column) -> Column:
    """Inline where it is short and of one line, else a block."""
    short = (F.length(s) <= aggregates.INLINE) & ~F.contains(s, F.lit("\n")) & ~F.contains(s, F.lit("`"))
    return F.when(short, F.concat(F.lit("`"), s, F.lit("`"))).otherwise(F.concat(F.lit("\n```\n"), s, F.lit("\n```")))


def rule_row(r: Column) -> Column:
    need = F.when(r["type"].isin("guard", "switch"), r["condition"]).when(r["type"] == "throw", r["what"]).when(r["type"] == "return", r["expr"]).when(r["type"] == "loop", r["loop_kind"]).otherwise(F.lit(""))
    value = F.coalesce(need, F.raise_error(F.concat(F.lit("a rule lacks its field: "), r["type"])).cast("string"))
    return F.concat(F.lit("- "), r["type"], F.when(value == "", "").otherwise(F.concat(F.lit(" "), code(value))), F.lit(" (line "), r["line"].cast("string"), F.lit(")"))


def effect_row(e: Column) -> Column:
    far = F.when(F.coalesce(e["propagated"], F.lit(False)), F.concat(F.lit(" from "), F.array_join(e["derived_from"], ", "))).otherwise("")
    return F.concat(F.lit("- "), e["id"], F.lit(" "), code(e["target"]), badge(e["confidence"]), far)


def call_row(c: Column) -> Column:
    return F.concat(F.lit("- "), code(c["target"]), F.when(c["resolved"].isNull(), "").otherwise(F.concat(F.lit(" -> "), c["resolved"])), F.lit(" (line "), c["line"].cast("string"), F.lit(")"))


def signature_line(name: Column, s: Column) -> Column:
    args = F.array_join(F.transform(s["inputs"], lambda i: F.concat(i["name"], F.lit(": "), i["type"])), ", ")
    out = F.when(F.size(s["outputs"]) > 0, F.concat(F.lit(": "), F.array_join(s["outputs"], ", "))).otherwise("")
    throws = F.when(F.size(s["throws"]) > 0, F.concat(F.lit(" throws "), F.array_join(s["throws"], ", "))).otherwise("")
    return F.concat(F.when(s["async"], "async ").otherwise(""), name, F.lit("("), args, F.lit(")"), out, throws)


def call_resolution_line(census: DataFrame) -> DataFrame:
    """One row: calls T · resolved R · unresolved U (bucket n · ...), empty buckets left out."""
    parts = F.array_compact(F.array(*(F.when(F.col(b.replace("-", "_")) > 0, F.concat(F.lit(b + " "), F.col(b.replace("-", "_")).cast("string"))) for b in BUCKETS)))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, " · "), F.lit(")"))).otherwise("")
    return census.select(F.concat(F.lit("calls "), F.col("total").cast("string"), F.lit(" · resolved "), F.col("resolved").cast("string"), F.lit(" · unresolved "), (F.col("total") - F.col("resolved")).cast("string"), tail).alias("line"))


def summary_line(summary: DataFrame) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("+"), n("added"), F.lit(" -"), n("removed"), F.lit(" ~"), n("changed"), F.lit(" ↔"), n("moved"), F.lit(" ⇄"), n("moved_changed"), F.when(F.col("unknown") > 0, F.concat(F.lit(" · ?"), n("unknown"), F.lit(" unknown"))).otherwise(""))
    return summary.select(line.alias("line"))


def lines_of_changes(changes: DataFrame) -> DataFrame:
    """(section, ord, id, line): a moved and changed symbol stands in both sections."""
    ord_ = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    also = F.when(F.col("status") == "moved+changed", F.array(F.lit("moved+changed"), F.lit("changed"))).otherwise(F.array("status"))
    rows = changes.select("id", "base_id", "status", F.explode(also).alias("section"))
    was = F.when(F.col("base_id").isNotNull() & (F.col("base_id") != F.col("id")), F.concat(F.lit(" (was `"), "base_id", F.lit("`)"))).otherwise("")
    return rows.select("section", ord_.alias("ord"), "id", F.concat(F.lit("- `"), "id", F.lit("`"), was).alias("line"))


def diff_markdown(changes: DataFrame, summary: DataFrame) -> str:
    """A page for people: one line a change, which is read to the driver section by section."""
    out = ["# Semantic diff", "", summary_line(summary).first().line, ""]
    section = None
    for r in lines_of_changes(changes).orderBy("ord", "id").toLocalIterator():
        if r.section != section:
            if section in ("moved", "dropped-toggled"):
                out += ["", "</details>"]
            section = r.section
            out += ["", f"## {TITLES[section]}", ""] if section not in ("moved", "dropped-toggled") else ["", f"<details><summary>{TITLES[section]}</summary>", ""]
        out.append(r.line)
    if section in ("moved", "dropped-toggled"):
        out += ["", "</details>"]
    return "\n".join(out) + "\n"


def mermaid(components: DataFrame, dependencies: DataFrame) -> list[str] | None:
    """The component graph, or None where it has too many nodes to draw."""
    nodes = components.select(mermaid_id(F.col("id")).alias("m"), mermaid_label(F.col("id")).alias("label")).orderBy("m").limit(aggregates.MERMAID_NODES + 1).collect()
    if len(nodes) > aggregates.MERMAID_NODES:
        return None
    known = components.select("id")
    edges = dependencies.join(known.toDF("from"), "from", "left_semi").join(known.toDF("to"), "to", "left_semi").select(mermaid_id(F.col("from")).alias("a"), mermaid_id(F.col("to")).alias("b")).distinct().orderBy("a", "b").collect()
    return ["```mermaid", "graph LR", *(f'  {n.m}["{n.label}"]' for n in nodes), *(f"  {e.a} --> {e.b}" for e in edges), "```"]


def workspace_markdown(tables: dict[str, DataFrame]) -> str:
    s = tables["symbols"]
    stats = aggregates.scan_stats(tables["stats"].first().total_files, s, tables["skipped"]).first()
    out = ["# Workspace", "", f"- files: {stats.parsed_files} of {stats.total_files}", f"- symbols: {stats.kept_symbols} kept, {stats.dropped_symbols} dropped", "", "## Components", ""]
    out += [f"- `{r.component}`: {r.n} symbols" for r in aggregates.per_component(s, tables["components"]).orderBy("component").toLocalIterator()]
    out += ["", *(mermaid(tables["components"], tables["dependencies"]) or ["(too many components to draw)"]), "", "## Effects", ""]
    effects = s.where("not dropped").select("component", F.explode("effects").alias("e")).select(F.col("e.id").alias("effect"), "component")
    out += [f"- {r.effect}: {r.n} ({', '.join(r.components)})" for r in aggregates.effect_surface(effects).collect()]
    out += ["", "## Skipped", ""]
    out += [f"- {r.reason}: {r.n} ({', '.join(r.paths)}{', ...' if r.n > len(r.paths) else ''})" for r in aggregates.by_reason(tables["skipped"], aggregates.LISTED).orderBy("reason").collect()]
    return "\n".join(out) + "\n"


def symbol_markdown(tables: dict[str, DataFrame], symbol: str) -> str:
    """One symbol's page with its callers."""
    from ..operators.resolve import callers

    one = tables["symbols"].where(F.col("id") == symbol)
    row = one.select("id", "kind", "dropped", "drop_reason", "confidence", F.when(F.col("signature").isNotNull(), signature_line(F.col("name"), F.col("signature"))).alias("sig"), F.transform("rules", rule_row).alias("rules"), F.transform("effects", effect_row).alias("effects"), F.transform("calls", call_row).alias("calls"), "fingerprint").first()
    if row is None:
        raise KeyError(symbol)
    out = [f"# `{row.id}`", "", f"{row.kind}{'' if row.confidence == 'high' else f' _({row.confidence})_'}", ""]
    if row.dropped:
        if row.drop_reason is None:
            raise ValueError(f"{symbol} is dropped without a reason")
        return "\n".join([*out, f"Dropped: {row.drop_reason}"]) + "\n"
    out += [f"`{row.sig}`", ""] if row.sig else []
    for title, rows in (("Rules", row.rules), ("Effects", row.effects), ("Calls", row.calls), ("Called by", [f"- `{r[0]}`" for r in callers(tables["dependencies"], symbol).toLocalIterator()])):
        out += [f"## {title}", "", *rows, ""] if rows else []
    f = row.fingerprint
    return "\n".join([*out, f"api `{f.api}` · logic `{f.logic}` · syntax `{f.syntax}`"]) + "\n"


def component_markdown(tables: dict[str, DataFrame], component: str) -> str:
    s = tables["symbols"].where(F.col("component") == component)
    out = [f"# {component}", "", "## Boundary", ""]
    out += [f"- `{r.id}`: {', '.join(f'{e.id} {e.target}' for e in r.effects)}" for r in aggregates.boundary_surface(s).orderBy("id").toLocalIterator()]
    file = None
    for r in s.where("not dropped").select(F.col("source.file").alias("file"), F.col("source.start_line").alias("line"), "id", "visibility").orderBy("file", "line", "id").toLocalIterator():
        if r.file != file:
            file = r.file
            out += ["", f"## {file}", ""]
        out.append(f"- `{r.id}` ({r.visibility}, line {r.line})")
    dropped = [f"- `{r.id}`: {r.drop_reason}" for r in s.where("dropped").select("id", "drop_reason").orderBy("id").toLocalIterator()]
    return "\n".join([*out, *(["", "<details><summary>Dropped</summary>", "", *dropped, "", "</details>"] if dropped else [])]) + "\n"
