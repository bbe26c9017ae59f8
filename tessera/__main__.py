"""python -m tessera scan|diff|explain|init: exit 0 well, 1 a fault while running, 2 bad input, 3 a gate tripped or files lost.
What could not be read is told on the error stream."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

OK, FAULT, INPUT, GATE = 0, 1, 2, 3


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("scan")
    p.add_argument("root")
    p.add_argument("--out", required=True, help="a folder of Parquet tables, or a .json document")
    p.add_argument("--markdown")
    p = commands.add_parser("diff")
    p.add_argument("base")
    p.add_argument("head")
    p.add_argument("--renames", help="lines of a name-status listing")
    p.add_argument("--fail-on")
    p.add_argument("--out", help="a folder of Parquet for the changes, or a .json document of the whole difference")
    p.add_argument("--markdown", help="a file, or with a trailing slash a folder, for the full page; without it the short one is printed")
    p = commands.add_parser("explain")
    p.add_argument("snapshot")
    p.add_argument("what")
    p = commands.add_parser("init")
    p.add_argument("root")
    p.add_argument("--output")
    p.add_argument("--force", action="store_true", help="overwrite a configuration that is there")
    args = parser.parse_args(argv)

    from . import plugins
    from .operators.diff import NotComparable
    from .operators.gate import BadGate, evaluate, first_tripped, parse
    from .sources import config
    from .sources.documents import BadDocument

    try:
        gate = parse(args.fail_on) if getattr(args, "fail_on", None) is not None else None
        settings = config.load(args.root) if args.command == "scan" else None
        loaded = plugins.load(settings, config.workspace_root(args.root) or args.root) if settings else None
        if args.command == "init":
            root = config.workspace_root(args.root) or Path(args.root)
            target = Path(args.output or root / config.NAMES[-1])
            if target.exists() and not args.force:
                raise config.BadConfig(f"{target} is there already; --force overwrites it")
    except (BadGate, config.BadConfig) as e:
        print(e, file=sys.stderr)
        return INPUT

    from .plans import engine, incidents, pages, project
    from .sources import documents

    spark = session()
    load = lambda p: documents.read(spark, p) if p.endswith(".json") else documents.read_tables(spark, p)
    try:
        tell = lambda lines: [print(line, file=sys.stderr) for line in lines]
        if args.command == "init":
            text, unmapped = config.rendered([r.asDict() for r in engine.detected(spark, str(root)).orderBy("id").toLocalIterator()])
            target.write_text(text, encoding="utf-8")
            print(json.dumps({"root": str(root), "written": str(target), "managers": [m["tool"] for m in config.managers(root)], "unmapped": unmapped}, indent=2))
            return OK
        if args.command == "scan":
            found = engine.scan(spark, args.root, settings, loaded=loaded)
            tables = found.tables
            documents.write_canonical(tables, args.out, "tessera.v1", True) if args.out.endswith(".json") else documents.write_tables(tables, args.out)
            if args.markdown:
                Path(args.markdown).write_text(project.workspace_markdown(tables), encoding="utf-8")
            tell(incidents.of_scan(tables, found.withdrawn, settings.min_parsed_ratio))
            lost = incidents.fault(tables, settings.min_parsed_ratio) or not found.withdrawn.isEmpty()
            return GATE if lost else OK
        if args.command == "explain":
            tables = load(args.snapshot)
            kind, ids = engine.explain(tables, args.what)
            print(project.symbol_markdown(tables, ids[0]) if kind == "single" else "\n".join([kind, *ids]))
            if kind == "not-found":
                tell(f"{r.n} file(s) were not read ({r.kind}), so it may be there: {incidents.listed(r.paths, r.n)}" for r in incidents.doubt(tables["stats"], tables["skipped"]).collect())
            return OK if kind == "single" else GATE if kind == "unknown" else INPUT
        renames = documents.renames(spark.read.text(args.renames)) if args.renames else None
        sides = {"base": load(args.base), "head": load(args.head)}
        found = engine.compare(sides["base"], sides["head"], renames)
        if args.out and args.out.endswith(".json"):
            documents.write_canonical_diff(found, args.out, "tessera.diff.v1", args.base, args.head, True)
        elif args.out:
            found.changes.write.mode("overwrite").parquet(args.out)
        if args.markdown:
            (pages.write if args.markdown.endswith("/") else pages.save)(found, args.markdown, args.base, args.head)
        else:
            print(project.diff_markdown(found.changes, found.summary))
        tell(incidents.of_comparison(sides, found.not_compared))
        if gate and (row := first_tripped(evaluate(gate, _counters(found))).first()) is not None:
            print(f"{row.clause}: {row.observed}", file=sys.stderr)
            return GATE
        return OK
    except (NotComparable, BadDocument, config.BadConfig) as e:
        print(e, file=sys.stderr)
        return INPUT
    except engine.Unsound as e:
        print(f"the snapshot breaks its rules: {e}", file=sys.stderr)
        return FAULT
    finally:
        spark.stop()


def _counters(found):
    from pyspark.sql import functions as F

    from .operators.gate import axis_counts

    return found.summary.withColumn("k", F.lit(1)).join(axis_counts(found.deltas).withColumn("k", F.lit(1)), "k").drop("k")


if __name__ == "__main__":
    sys.exit(main())
