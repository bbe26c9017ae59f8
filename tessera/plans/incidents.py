"""What a scan or a comparison could not read, told in lines. Each census is a DataFrame; only its few lines are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import LISTED, by_reason, coverage_fault, dominant_reason

#: Reasons in the order in which they are told, and what to do about them.
ADVICE = {
    "extraction-failed": "the plugin that read them failed",
    "parse-failed": "look at their syntax",
    "over-size": "raise maxFileSizeBytes, or ignore them",
    "unreadable": "scan again; they changed while they were read",
    "unroutable": "no language claims them",
    "timeout": "scan again",
}


def listed(paths: list[str], n: int) -> str:
    return ", ".join(paths[:LISTED]) + (f", and {n - LISTED} more" if n > LISTED else "")


def skipped_lines(skipped: DataFrame) -> list[str]:
    rank = {r: i for i, r in enumerate(ADVICE)}
    rows = sorted(by_reason(skipped, LISTED).collect(), key=lambda r: (rank.get(r.reason, len(rank)), r.reason))
    return [f"{r.n} file(s) skipped, {r.reason}{f' ({ADVICE[r.reason]})' if r.reason in ADVICE else ''}: {listed(r.paths, r.n)}" for r in rows]


def withdrawn_lines(withdrawn: DataFrame) -> list[str]:
    """Spellings of one path, which a document cannot tell apart."""
    n = withdrawn.count()
    return [f"{n} spelling(s) stand for a path with another one and were not read: {listed([r.spelling for r in withdrawn.orderBy('spelling').take(LISTED)], n)}"] if n else []


def fault(tables: dict[str, DataFrame], floor: float) -> str | None:
    """Why a scan does not count as one: nothing found, nothing read, or too little; with the reason of most losses."""
    said = tables["stats"].select(coverage_fault(F.col("total_files"), F.col("parsed_files"), F.lit(floor))).first()[0]
    most = dominant_reason(tables["skipped"]).first() if said else None
    return f"{said}, mostly {most.reason}" if most else said


def of_scan(tables: dict[str, DataFrame], withdrawn: DataFrame | None = None, floor: float = 0.0, label: str | None = None) -> list[str]:
    """The lines of one scan, the worst first."""
    first = fault(tables, floor)
    lines = [*([first] if first else []), *(withdrawn_lines(withdrawn) if withdrawn is not None else []), *skipped_lines(tables["skipped"])]
    return [f"{label}: {line}" if label else line for line in lines]


def doubt(stats: DataFrame, skipped: DataFrame | None) -> DataFrame:
    """(kind, n, paths): whether what is missing from a snapshot may have been lost. named-losses, with the first paths, where
    a list of skipped files has any; unnamed-losses where there is no list and fewer files were read than found; else no row."""
    if skipped is not None:
        return _named(skipped)
    return stats.select(F.lit("unnamed-losses").alias("kind"), (F.col("total_files") - F.col("parsed_files")).cast("long").alias("n"), F.array().cast("array<string>").alias("paths")).where("n > 0")


def of_comparison(sides: dict[str, dict[str, DataFrame]], not_compared: DataFrame) -> list[str]:
    """Faults that a side recorded, losses that it does not name, and files that neither side read."""
    out = []
    for side, tables in sides.items():
        failed = tables["skipped"].where("reason = 'extraction-failed'") if tables.get("skipped") is not None else None
        for r in _named(failed).collect() if failed is not None else ():
            out.append(f"{side}: a plugin failed on {r.n} file(s): {listed(r.paths, r.n)}")
        if failed is None:
            out += [f"{side}: {r.n} file(s) were not read and are not named, so their symbols count as {'removed' if side == 'head' else 'added'}" for r in doubt(tables["stats"], None).collect()]
    out += [f"{r.n} file(s) were read by neither side: {listed(r.paths, r.n)}" for r in _named(not_compared).collect()]
    return out


def _named(files: DataFrame) -> DataFrame:
    """At most one row: how many files, and the first of them by path. Both sides of the join are one row."""
    first = files.select("path").orderBy("path").limit(LISTED).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.lit(1).alias("one"))
    return files.agg(F.count("*").alias("n"), F.lit(1).alias("one")).where("n > 0").join(first, "one").select(F.lit("named-losses").alias("kind"), "n", "paths")
