"""The difference of two snapshots: changes, summary, components, dependencies, slices, what neither side read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import file_of
from ..schema import DEPENDENCIES, SKIPPED, shaped
from . import graph, match, resolve
from .delta import LINE_WINDOW, symbol_deltas
from .session import cut

COUNTERS = ("added", "removed", "changed", "moved", "moved_changed", "dropped_toggled", "unknown", "unchanged", "to_dropped", "to_kept", "dropped_added", "dropped_removed")


class NotComparable(ValueError):
    pass


@dataclass
class Snapshot:
    """One side: its tables. Missing ones count as empty."""

    symbols: DataFrame
    components: DataFrame | None = None
    dependencies: DataFrame | None = None
    skipped: DataFrame | None = None

    def skips(self) -> DataFrame:
        return shaped(self.skipped, SKIPPED) if self.skipped is not None else shaped(self.symbols.limit(0).select(F.lit("").alias("path")), SKIPPED)

    def edges(self) -> DataFrame:
        return shaped(self.dependencies, DEPENDENCIES) if self.dependencies is not None else shaped(self.symbols.limit(0).select(F.lit("").alias("from")), DEPENDENCIES)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check(side: str, snapshot: Snapshot) -> None:
    """Ids must be unique, or the pairs mean nothing."""
    tables = [("symbols", snapshot.symbols, ["id"]), ("components", snapshot.components, ["id"]), ("dependencies", snapshot.dependencies, ["from", "to", "via"])]
    for name, df, keys in tables:
        if df is not None and (row := duplicates(df, *keys).first()) is not None:
            raise NotComparable(f"{side}: {name} has {row.n} rows of {tuple(row[k] for k in keys)}")


def paired(base: DataFrame, head: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with structs base and head and their status."""
    side = lambda d, n: d.select(F.col("id").alias(f"{n}_id"), F.struct(*d.columns).alias(n))
    return pairs.join(side(base, "base"), "base_id").join(side(head, "head"), "head_id").withColumn("status", match.status(F.col("base"), F.col("head")))


def leftovers(base: DataFrame, head: DataFrame, pairs: DataFrame, base_skips: DataFrame, head_skips: DataFrame) -> DataFrame:
    """(id, status, dropped, absent_from, reason): added and removed, unknown where the other side did not read the file."""
    b = match.unclaimed(base, pairs, "base_id").select("id", "dropped", F.col("source.file").alias("path"), F.lit("removed").alias("status"), F.lit("head").alias("other"))
    h = match.unclaimed(head, pairs, "head_id").select("id", "dropped", F.col("source.file").alias("path"), F.lit("added").alias("status"), F.lit("base").alias("other"))
    lost = lambda d, s: d.join(s.groupBy("path").agg(F.min("reason").alias("reason")), "path", "left")
    every = lost(b, head_skips).unionByName(lost(h, base_skips))
    unknown = F.col("reason").isNotNull() & ~F.col("dropped")
    return every.select("id", F.when(unknown, "unknown").otherwise(F.col("status")).alias("status"), "dropped", F.when(unknown, F.col("other")).alias("absent_from"), F.when(unknown, F.col("reason")).alias("reason"))


def summary(full: DataFrame, left: DataFrame) -> DataFrame:
    """One row of counters. Dropped leftovers have counters of their own and are no changes."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    toggled = s == "dropped-toggled"
    a = full.agg(n(s == "changed").alias("changed"), n(s == "moved").alias("moved"), n(s == "moved+changed").alias("moved_changed"), n(toggled).alias("dropped_toggled"), n(toggled & F.col("head.dropped")).alias("to_dropped"), n(toggled & ~F.col("head.dropped")).alias("to_kept"), n(s == "unchanged").alias("unchanged"))
    live = ~F.col("dropped")
    b = left.agg(n((s == "added") & live).alias("added"), n((s == "removed") & live).alias("removed"), n(s == "unknown").alias("unknown"), n((s == "added") & ~live).alias("dropped_added"), n((s == "removed") & ~live).alias("dropped_removed"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").select(*COUNTERS)


def component_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, status, changed fields, roots of added ones): arrays compare in order, null as empty."""
    fields = ("roots", "public_api", "frameworks")
    empty = F.array().cast("array<string>")
    side = lambda d, p: d.select("id", *(F.coalesce(c, empty).alias(f"{p}_{c}") for c in fields), F.lit(True).alias(p))
    both = side(base, "b").join(side(head, "h"), "id", "full_outer")
    changed = F.array_compact(F.array(*(F.when(F.col(f"b_{c}") != F.col(f"h_{c}"), c) for c in fields)))
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select("id", status.alias("status"), F.when(status == "changed", changed).alias("fields"), F.when(status == "added", F.col("h_roots")).alias("roots")).where("status is not null")


def dependency_changes(base: Snapshot, head: Snapshot) -> DataFrame:
    """(from, to, via, status, direction, effect, absent_from, lost). Another direction or effect is one removed and one
    added edge; an edge of one side whose end lies in a file that the other side did not read is unknown: absent_from names
    that side, lost the files and why."""
    keys = ["from", "to", "via"]
    side = lambda d, p: d.select(*keys, F.struct("direction", "effect").alias(p))
    both = side(base.edges(), "b").join(side(head.edges(), "h"), keys, "full_outer").where("not (b <=> h)")
    rows = both.select(*keys, F.explode(F.array_compact(F.array(F.when(F.col("b").isNotNull(), F.struct(F.lit("removed").alias("status"), F.col("b").alias("x"), F.col("h").isNull().alias("alone"))), F.when(F.col("h").isNotNull(), F.struct(F.lit("added").alias("status"), F.col("h").alias("x"), F.col("b").isNull().alias("alone")))))).alias("r")).select(*keys, "r.status", "r.x.direction", "r.x.effect", "r.alone")
    gone = lambda snapshot, status, side: snapshot.skips().groupBy("path").agg(F.min("reason").alias("reason")).select(F.col("path").alias("p"), "reason", F.lit(status).alias("status"), F.lit(side).alias("side"))
    lost = gone(head, "removed", "head").unionByName(gone(base, "added", "base"))
    for end in ("from", "to"):
        file = F.when(F.col("p").isNotNull(), F.struct(F.col("p").alias("path"), "reason"))
        rows = rows.withColumn("p", file_of(F.col(end))).join(lost, ["p", "status"], "left").withColumn(f"lost_{end}", F.when(F.col("side").isNotNull(), file)).withColumn("absent_from", F.coalesce("absent_from", "side") if end == "to" else F.col("side")).drop("p", "reason", "side")
    unknown = F.col("alone") & F.col("absent_from").isNotNull()
    files = F.array_distinct(F.array_compact(F.array("lost_from", "lost_to")))
    return rows.select(*keys, F.when(unknown, "unknown").otherwise(F.col("status")).alias("status"), "direction", "effect", F.when(unknown, F.col("absent_from")).alias("absent_from"), F.when(unknown, files).alias("lost"))


def not_compared(base_skips: DataFrame, head_skips: DataFrame) -> DataFrame:
    return base_skips.select("path", F.col("reason").alias("base_reason")).join(head_skips.select("path", F.col("reason").alias("head_reason")), "path").orderBy("path")


@dataclass
class Diff:
    pairs: DataFrame
    changes: DataFrame
    deltas: DataFrame
    summary: DataFrame
    components: DataFrame | None
    dependencies: DataFrame
    slices: DataFrame
    not_compared: DataFrame
    #: Both sides as given, all pairs with their structs base and head, and what has no pair.
    sides: tuple[Snapshot, Snapshot]
    full: DataFrame
    left: DataFrame


def diff(base: Snapshot, head: Snapshot, renames: DataFrame | None = None, line_window: int = LINE_WINDOW) -> Diff:
    check("base", base)
    check("head", head)
    pairs = cut(match.match(base.symbols, head.symbols, renames))
    full = cut(paired(base.symbols, head.symbols, pairs))
    left = cut(leftovers(base.symbols, head.symbols, pairs, base.skips(), head.skips()))
    changed = full.where("status <> 'unchanged'").select(F.col("head_id").alias("id"), "status", F.col("base_id"), "rationale")
    apart = left.where("not dropped").select("id", "status", F.lit(None).cast("string").alias("base_id"), F.lit(None).cast("string").alias("rationale"))
    changes = cut(changed.unionByName(apart))
    edges = resolve.edges_of_document(base.symbols).unionByName(resolve.edges_of_document(head.symbols)).select(F.col("from").alias("u"), F.col("to").alias("v")).distinct()
    deltas = symbol_deltas(full.where("status in ('changed', 'moved+changed')"), line_window)
    comps = component_changes(base.components, head.components) if base.components is not None and head.components is not None else None
    return Diff(pairs, changes.orderBy("status", "id"), deltas, summary(full, left), comps, dependency_changes(base, head), graph.slices(changes, edges), not_compared(base.skips(), head.skips()), (base, head), full, left)
