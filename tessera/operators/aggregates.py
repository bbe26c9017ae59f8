"""Counts, top lists and order-dependent helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import file_of  # noqa: F401
from ..functions.text import kebab

#: Fixed values.
EFFECT_TOP = 10
MERMAID_NODES = 100
LISTED = 10
INLINE = 80
SKIP_RANK = ("parse-failed", "timeout", "over-size", "unreadable", "unroutable", "colliding-spelling")


def scan_stats(files: int, symbols: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: files, parsed, kept, dropped."""
    a = symbols.agg(F.count_if(~F.col("dropped")).alias("kept_symbols"), F.count_if("dropped").alias("dropped_symbols"))
    b = skipped.agg(F.count_distinct("path").alias("n"))
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")
    return both.select(F.lit(files).cast("long").alias("total_files"), (F.lit(files) - F.col("n")).cast("long").alias("parsed_files"), "kept_symbols", "dropped_symbols")


def effect_surface(effects: DataFrame, top: int = EFFECT_TOP) -> DataFrame:
    """effects(effect, component) -> the most frequent ones: count, components in order; ties by name."""
    return effects.groupBy("effect").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("component")).alias("components")).orderBy(F.desc("n"), "effect").limit(top)


def boundary_surface(symbols: DataFrame) -> DataFrame:
    """Kept symbols at a boundary or of a framework that have effects, effects by (id, target)."""
    at = F.exists("decorators", lambda d: F.coalesce(d["boundary"], F.lit(False))) | F.col("ext_kind").startswith("framework:")
    pairs = F.array_sort(F.transform("effects", lambda e: F.struct(e["id"].alias("id"), e["target"].alias("target"))))
    return symbols.where(~F.col("dropped") & F.coalesce(at, F.lit(False)) & (F.size("effects") > 0)).select("id", pairs.alias("effects"))


def per_component(symbols: DataFrame, components: DataFrame) -> DataFrame:
    n = symbols.where("not dropped and component is not null").groupBy("component").agg(F.count("*").alias("n"))
    return components.select(F.col("id").alias("component")).join(n, "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("n"))


def by_reason(skipped: DataFrame, listed: int | None = None) -> DataFrame:
    """(reason, n, paths); with `listed`, the first paths of each reason only, beside the full count."""
    if listed is None:
        return skipped.groupBy("reason").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    w = Window.partitionBy("reason").orderBy("path")
    ranked = skipped.withColumn("k", F.row_number().over(w)).where(F.col("k") <= listed)
    few = ranked.groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return few.join(skipped.groupBy("reason").agg(F.count("*").alias("n")), "reason").select("reason", "n", "paths")


def dominant_reason(skipped: DataFrame, order: tuple[str, ...] = SKIP_RANK) -> DataFrame:
    """The most frequent reason; ties by the given rank."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("reason")), F.lit(0)), F.lit(len(order) + 1))
    return skipped.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), place, "reason").limit(1)


def coverage_fault(total: Column, parsed: Column, floor: Column) -> Column:
    return F.when(total == 0, "nothing-discovered").when(parsed == 0, "nothing-parsed").when(parsed / total < floor, "below-floor")


def occurrence(partition: list[str], order: list) -> Column:
    """How many equal ones came before."""
    return (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long")


def streaks(events: DataFrame, keys: list[str], order: list[str], failed: Column, length: int) -> DataFrame:
    """Runs of at least `length` failures in a row: keys, run, n, begin, end; a success ends a run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = events.withColumn("__failed", failed).withColumn("run", F.sum(F.when(~failed, 1).otherwise(0)).over(w))
    bad = marked.where("__failed").groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("begin"), F.max(order[0]).alias("end"))
    return bad.where(F.col("n") >= length)


def resolved_ids(components: DataFrame) -> DataFrame:
    """components(root, id) with clashing ids told apart: first by the parent folder, then by number in order of root."""
    again = F.count("*").over(Window.partitionBy("id")) > 1
    parent = kebab(F.regexp_extract("root", r"([^/]+)/[^/]+$", 1))
    once = components.withColumn("id", F.when(again & (parent != ""), F.concat_ws("-", "id", parent)).otherwise(F.col("id")))
    w = Window.partitionBy("id").orderBy("root")
    return once.withColumn("k", F.row_number().over(w)).select("root", F.when(F.col("k") > 1, F.concat_ws("-", "id", F.col("k").cast("string"))).otherwise(F.col("id")).alias("id"))


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """candidates(root, tool, manifest, ord): one row a root with its tools and first manifest."""
    return candidates.groupBy("root").agg(F.array_sort(F.collect_set("tool")).alias("tools"), F.min_by("manifest", F.when(F.col("manifest").isNotNull(), F.col("ord"))).alias("manifest"))


def language_shares(files: DataFrame, at_least: int = 10, share: float = 0.05) -> DataFrame:
    """files(component, language) -> languages with enough files and share in each component."""
    n = files.where("language is not null").groupBy("component", "language").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("component"))
    return n.withColumn("share", F.col("n") / total).where((F.col("n") >= at_least) & (F.col("share") >= share))


def filenames(ids: DataFrame) -> DataFrame:
    """ids(id) -> a file name for each; those that clash get the first six digits of the id's SHA-256."""
    from ..functions.text import sanitized

    base = sanitized(F.col("id"))
    clash = F.count("*").over(Window.partitionBy("base")) > 1
    return ids.withColumn("base", base).select("id", F.when(clash, F.concat_ws("-", "base", F.substring(F.sha2("id", 256), 1, 6))).otherwise(F.col("base")).alias("filename"))
