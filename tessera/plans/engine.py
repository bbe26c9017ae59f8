"""The engine's front: scan a tree into a snapshot's tables, compare two of them, explain a symbol."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..functions import fingerprint
from ..functions.ids import symbol_id
from ..functions.text import nfc
from ..operators import classify, diff, graph, integrity, resolve
from ..operators.session import cut
from ..plugins import SYMBOL_FIELDS, Loaded
from ..schema import COMPONENTS, SKIPPED, SYMBOLS, shaped
from ..sources import components, typescript
from ..sources import files as tree
from ..sources.config import Config, managers


@dataclass
class Scan:
    tables: dict[str, DataFrame]
    calls: DataFrame
    imports: DataFrame
    unresolved: DataFrame
    faults: DataFrame
    #: Files of which two spellings have one normal path: (path, spelling, reason). They are neither read nor skipped.
    withdrawn: DataFrame


#: Languages that the built-in extraction reads.
OWN = ("ts", "tsx", "js", "jsx")
EFFECTS = dict((f.name, f.dataType.simpleString()) for f in SYMBOLS.fields)["effects"]


class Unsound(RuntimeError):
    """A snapshot that breaks the rules of integrity."""


def symbols_of(extracted: DataFrame, config: Config, names: tuple[str, ...], comps: DataFrame, loaded: Loaded | None = None) -> DataFrame:
    """Extracted files as symbols with frameworks, drops, effects and fingerprints, in one pass over each row. Texts are in
    normal form already. Loaded plugins answer before the built-in ones."""
    loaded = loaded or Loaded()
    s = extracted.select(nfc(F.col("path")).alias("file"), "imports", "content", F.explode("symbols").alias("s")).select("file", "imports", "content", "s.*")
    jsx = classify.react_symbol(F.col("kind"), F.col("name"), F.col("has_jsx"), F.coalesce("returned_jsx", F.lit("")), F.col("calls"), F.coalesce("wrapper", F.lit("")))
    express = classify.express_symbol(F.col("kind"), F.col("name"), F.coalesce("method", F.lit("")), F.col("argument_shapes"), F.col("content"), F.coalesce("wrapper", F.lit("")))
    plain = lambda c: F.when(c.isNotNull(), F.struct(c["ext_kind"].alias("ext_kind"), c["derived_by"].alias("derived_by"), c["confidence"].alias("confidence")))
    given = {name: F.col(name) for name in SYMBOL_FIELDS if name in s.columns}
    answers = [p.classify_symbol(given) for p in loaded.framework] + [classify.nest_symbol(F.col("kind"), F.col("decorators"), F.col("imports")), classify.next_symbol(F.col("kind"), F.col("name"), F.col("file"), F.col("derived_by")), jsx, express]
    s = s.withColumn("answer", F.coalesce(*map(plain, answers))).withColumn("ext_kind", F.lit(None).cast("string")).withColumn("confidence", F.lit("high"))
    known = F.array(*map(F.lit, (*classify.NEST_CLASS, *classify.NEST_HTTP, *classify.NEST_PATTERN, *classify.NEST_HANDLER)))
    marked = sorted({name for p in loaded.framework for name in getattr(p, "decorator_boundaries", ())})
    nest = F.coalesce(F.col("answer.ext_kind").startswith("framework:nestjs:"), F.lit(False)) | F.coalesce(F.col("answer.derived_by").startswith("framework:nestjs:"), F.lit(False))
    s = s.withColumn("decorators", F.transform("decorators", lambda d: F.struct(d["name"].alias("name"), d["raw"].alias("raw"), d["arguments"].alias("arguments"), ((nest & F.array_contains(known, d["name"])) | (d["name"].isin(*marked) if marked else F.lit(False))).alias("boundary"), d["line"].alias("line"))))
    s = classify.merged(s, "answer")
    boundary = F.exists("decorators", lambda d: d["boundary"])
    empty = ~F.col("has_body") | F.col("empty_body")
    reason = classify.drop_reason(F.col("kind"), boundary, empty & F.col("kind").isin("function", "method"), F.col("derived_by"), F.col("fields_only"), F.col("constants_only"))
    s = s.withColumn("drop_reason", reason).withColumn("dropped", reason.isNotNull())
    silent = (*classify.DROPPED_CALLS, *config.suppress, *(c for p in loaded.effects for c in getattr(p, "drop_callees", ())))
    live = F.filter("calls", lambda c: ~classify.dropped_call(c["target"], silent, tuple(config.keep)))

    def hit(c: Column) -> Column:
        own = classify.effect(c["target"], F.col("imports"), c["argument_count"], names)
        other = plugins.first_effect(loaded.effects, c["target"], F.col("imports"), c["argument_count"])
        return own if other is None else F.coalesce(other, own)

    both = F.transform(live, lambda c: F.struct(c.alias("c"), hit(c).alias("x")))
    s = s.withColumn("both", both)
    null = F.lit(None)
    effects = F.transform(F.filter("both", lambda b: b["x"].isNotNull()), lambda b: F.struct(b["x"]["effect"]["id"].alias("id"), b["c"]["target"].alias("target"), b["c"]["line"].alias("line"), b["x"]["plugin"].alias("plugin"), b["x"]["effect"]["confidence"].alias("confidence"), b["x"]["effect"]["derived_by"].alias("derived_by"), null.cast("boolean").alias("propagated"), null.cast("array<string>").alias("derived_from")))
    rest = F.transform(F.filter("both", lambda b: b["x"].isNull()), lambda b: F.struct(b["c"]["target"].alias("target"), b["c"]["line"].alias("line"), null.cast("string").alias("resolved")))
    dynamic = F.transform(F.filter("both", lambda b: b["x"].isNull()), lambda b: b["c"]["dynamic_receiver"])
    kept = ~F.col("dropped")
    s = s.withColumn("effects", F.when(kept, effects).otherwise(F.array().cast(EFFECTS))).withColumn("dynamic", F.when(kept, dynamic)).withColumn("calls", F.when(kept, rest).otherwise(F.array().cast("array<struct<target:string,line:int,resolved:string>>")))
    s = s.withColumn("rules", F.when(kept, F.col("rules")).otherwise(F.array().cast(dict((f.name, f.dataType.simpleString()) for f in SYMBOLS.fields)["rules"])))
    language = router(loaded, plugins.language_of).column(F.col("file"))
    s = s.withColumn("language", F.coalesce(language, F.lit("ts"))).withColumn("id", symbol_id(F.col("language"), F.col("file"), F.col("name")))
    s = with_component(s, comps)
    place = F.struct(F.col("file").alias("file"), "start_line", "end_line", null.cast("int").alias("start_column"), null.cast("int").alias("end_column"))
    return with_fingerprint(s.withColumn("source", place))


def with_component(symbols: DataFrame, comps: DataFrame) -> DataFrame:
    """symbols(file, ...) with the component whose longest root holds the file; null without one. Each file asks for the
    folders above it, so the join is on equal paths."""
    bare = F.regexp_replace("root", "/+$", "")
    roots = comps.select(F.col("id").alias("component"), F.explode("roots").alias("root")).select("component", F.when(bare == "", ".").otherwise(bare).alias("root"))
    steps = F.split("file", "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")))
    met = symbols.select("file").distinct().select("file", F.explode(above).alias("root")).join(roots, "root")
    best = met.groupBy("file").agg(F.max_by("component", F.struct(F.when(F.col("root") == ".", 0).otherwise(F.length("root")), "component")).alias("component"))
    return symbols.join(best, "file", "left")


def detected(spark: SparkSession, root: str) -> DataFrame:
    """The components of a folder's workspace, by its managers' own files."""
    below = lambda names=None: tree.read_tree(spark, root, names).select(nfc(F.col("spelling")).alias("path"), F.col("content"))
    manifests = below("{package,project}.json").select("path", F.decode("content", "UTF-8").alias("text"))
    return components.detect(below().select("path"), manifests, managers(root), Path(root).resolve().name)


def with_fingerprint(s: DataFrame) -> DataFrame:
    api = fingerprint.api(F.col("kind"), F.col("ext_kind"), F.col("name"), F.col("visibility"), F.col("decorators"), F.col("signature"))
    return s.withColumn("fingerprint", fingerprint.of_symbol(F.col("dropped"), api, fingerprint.logic(F.col("rules"), F.col("effects")), fingerprint.syntax(F.col("normalized"))))


def router(loaded: Loaded, called) -> tree.Router:
    """Extensions to languages, `ts` for the built-in ones; two plugins on one extension are an error."""
    return tree.Router({"ts": tuple(e for e, name in tree.LANGUAGES.items() if name in OWN)} | {called(p): tuple(p.extensions) for p in loaded.lang})


def extract(texts: DataFrame, loaded: Loaded) -> DataFrame:
    """texts(path, text), each read by the plugin that claims its extension, TypeScript and JavaScript by the built-in one."""
    if not loaded.lang:
        return typescript.extract(texts)
    routed = texts.withColumn("__by", router(loaded, plugins.name_of).column(F.col("path")))
    out = typescript.extract(routed.where("__by = 'ts'"))
    for p in loaded.lang:
        name = plugins.name_of(p)
        got = p.extract(routed.where(F.col("__by") == name).select("path", "text"))
        out = out.unionByName(got.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in out.schema.fields)))
    return out


def check(found: Scan, limit: int = 20) -> None:
    """Raises Unsound with the first violations of a snapshot's rules."""
    t = found.tables
    languages = t["symbols"].select("language").distinct()
    bad = integrity.violations(t["symbols"], t["components"], t["dependencies"], languages, t["skipped"], t["stats"]).orderBy("rule", "subject").limit(limit).collect()
    if bad:
        raise Unsound("; ".join(f"{r.rule}: {r.subject}: {r.message}" for r in bad))


def scan(spark: SparkSession, root: str, config: Config | None = None, names: tuple[str, ...] = tuple(classify.PLUGINS), hints: DataFrame | None = None, loaded: Loaded | None = None, sound: bool = True) -> Scan:
    """A folder of TypeScript and JavaScript files, and of what loaded plugins read, as a snapshot. A file that cannot be
    read is skipped, the rest stays. `names` are the built-in effect plugins in order. With `sound` the snapshot is held
    against the rules of integrity before it is handed out; vocabulary that no plugin declares is an error where the
    configuration is strict."""
    config, loaded = config or Config(), loaded or Loaded()
    extensions = tuple(e for e, l in tree.LANGUAGES.items() if l in OWN) + tuple(e.lower() for p in loaded.lang for e in p.extensions)
    dropped = tuple(g for p in loaded.lang for g in getattr(p, "file_drop_patterns", ()))
    ignore = (*(tree.gitignore(spark, f"{root.rstrip('/')}/.gitignore") if config.gitignore else ()), *config.ignore, *dropped)
    found = tree.discover(tree.read_tree(spark, root), extensions, ignore, config.max_file_bytes)
    texts = tree.text_of(found.files).select("path", nfc(F.col("text")).alias("text"))
    extracted = cut(extract(texts, loaded).join(texts.select("path", F.col("text").alias("content")), "path"))
    failed = extracted.where("error is not null").select("path", F.lit("parse-failed").alias("reason"))
    skipped = found.skipped.select("path", "reason").unionByName(failed)
    good = extracted.where("error is null")
    if config.components:
        rows = [(c["id"], c.get("name", c["id"]), c.get("roots", []), None, ["ts"], None, c.get("description")) for c in config.components]
        comps = spark.createDataFrame(rows, COMPONENTS)
    else:
        comps = cut(detected(spark, root))
    symbols = cut(symbols_of(good, config, names, comps, loaded))
    if (loaded.framework or loaded.effects) and config.strict:
        own = plugins.undeclared(symbols.where(~F.coalesce(F.col("ext_kind").startswith("framework:"), F.lit(False))), loaded.registry).take(5)
        if own:
            raise plugins.BadPlugin("undeclared vocabulary: " + ", ".join(f"{r.space} {r.value}" for r in own))
    imports = plugins.checked_imports(typescript.imports(good), "extraction")
    calls = symbols.where("not dropped").select(F.col("id").alias("caller"), F.posexplode(F.arrays_zip("calls", "dynamic")).alias("ord", "c")).select(F.concat_ws("\t", "caller", "ord").alias("call"), "caller", "ord", "c.calls.target", "c.calls.line", "c.dynamic")
    answered = cut(resolve.resolve(shaped(symbols, SYMBOLS), calls, imports, hints))
    by_symbol = answered.join(calls.select("call", "ord"), "call").groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("ord", "target", "line", "resolved"))).alias("x")).select(F.col("caller").alias("id"), F.transform("x", lambda c: F.struct(c["target"].alias("target"), c["line"].alias("line"), c["resolved"].alias("resolved"))).alias("__calls"))
    symbols = symbols.join(by_symbol, "id", "left").withColumn("calls", F.coalesce("__calls", "calls")).drop("__calls")
    edges = cut(resolve.call_edges(answered))
    symbols = cut(with_fingerprint(graph.propagate(symbols, edges.select("from", "to", "confidence"))))
    n = good.count() + skipped.count()
    stats = spark.range(1).select(F.lit(n).alias("total_files"), F.lit(good.count()).alias("parsed_files"))
    tables = {"symbols": shaped(symbols, SYMBOLS), "components": comps, "dependencies": resolve.dependencies(edges), "skipped": shaped(skipped, SKIPPED), "stats": stats}
    out = Scan(tables, answered, imports, answered.where("bucket is not null"), extracted.where("error is not null").select("path", "error"), found.colliding.select("path", F.explode("spellings").alias("spelling"), F.lit("colliding-spelling").alias("reason")))
    if sound:
        check(out)
    return out


def compare(base: dict[str, DataFrame], head: dict[str, DataFrame], renames: DataFrame | None = None, line_window: int = 2) -> diff.Diff:
    side = lambda t: diff.Snapshot(t["symbols"], t.get("components"), t.get("dependencies"), t.get("skipped"))
    return diff.diff(side(base), side(head), renames, line_window)


def explain(tables: dict[str, DataFrame], what: str) -> tuple[str, list[str]]:
    """(kind, ids): single, ambiguous, not-found, or unknown where the file was not read. An id is looked up as such, a
    path by file, anything else in names. All ids that fit come back, in order; the driver holds them."""
    symbols = tables["symbols"]
    if "#" in what:
        rows = symbols.where(F.col("id") == what)
    elif "/" in what and not (at := symbols.where(F.col("source.file") == what)).isEmpty():
        rows = at
    elif not tables["skipped"].where(F.col("path") == what).isEmpty():
        return "unknown", []
    else:
        rows = symbols.where(F.contains("name", F.lit(what)))
    ids = [r.id for r in rows.select("id").orderBy("id").collect()]
    return ("not-found" if not ids else "single" if len(ids) == 1 else "ambiguous"), ids
