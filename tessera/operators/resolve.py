"""Calls to symbols: the scopes of a name, one after the other.

calls(caller, target, line, resolved, dynamic) belong to kept symbols. Names count as unique over kept symbols only; which
files exist also counts those that hold dropped ones only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import symbol_id
from ..functions.paths import dirname, join_posix

#: The order in which extensions of an import without one are tried.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
BUCKETS = ("local-scope", "dynamic", "ambiguous", "external", "no-match")


def calls_of(symbols: DataFrame) -> DataFrame:
    return symbols.where("not dropped").select(F.col("id").alias("caller"), F.posexplode("calls").alias("ord", "c")).select("caller", "ord", "c.target", "c.line", "c.resolved")


def _unique(symbols: DataFrame, keys: dict) -> DataFrame:
    """By keys: how many kept symbols, the least id, and all of them where there are several."""
    kept = symbols.where("not dropped").select(*(v.alias(k) for k, v in keys.items()), "id")
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("hit"), F.array_sort(F.collect_set("id")).alias("all"))


def import_hits(callers: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """callers(call, file, language, head, tail) -> (call, n, hit, all): what relative, static imports bind the name to."""
    files = symbols.select(F.col("language").alias("lang"), F.col("source.file").alias("path")).distinct()
    static = imports.where(~F.coalesce(F.col("dynamic"), F.lit(False)) & F.col("source").rlike(r"^\.\.?(/|$)"))
    joined = join_posix(dirname(F.col("file")), F.col("source"))
    probes = F.array(F.col("joined"), *(F.concat("joined", F.lit(f".{e}")) for e in EXTENSIONS), *(F.concat("joined", F.lit(f"/index.{e}")) for e in EXTENSIONS))
    sources = static.select("file", "source").distinct().withColumn("joined", joined).where("joined is not null")
    probed = sources.select("file", "source", F.posexplode(probes).alias("at", "path")).join(files, "path")
    found = probed.groupBy("file", "source", "lang").agg(F.min_by("path", "at").alias("path"))
    named = static.where(~F.coalesce(F.col("is_star"), F.lit(False))).select("file", "source", F.explode("symbols").alias("raw")).select("file", "source", text.alias_parts(F.col("raw")).alias("a")).select("file", "source", F.col("a.local").alias("head"), F.col("a.imported").alias("imported"))
    spaces = static.where(F.coalesce(F.col("is_star"), F.lit(False)) & F.col("namespace_binding").isNotNull()).select("file", "source", F.col("namespace_binding").alias("head"), F.lit(None).cast("string").alias("imported"))
    bound = named.unionByName(spaces).distinct().join(found, ["file", "source"])
    met = callers.join(bound, ["file", "head"]).where("language = lang")
    rest = F.array_join("tail", ".")
    name = F.when(F.col("imported").isNull(), F.when(F.size("tail") > 0, rest)).when(F.size("tail") > 0, F.concat_ws(".", "imported", rest)).otherwise(F.col("imported"))
    ids = met.select("call", symbol_id(F.col("language"), F.col("path"), name).alias("id")).where("id is not null").join(symbols.where("not dropped").select("id"), "id", "left_semi")
    return ids.groupBy("call").agg(F.count_distinct("id").alias("n"), F.min("id").alias("hit"), F.array_sort(F.collect_set("id")).alias("all"))


def resolve(symbols: DataFrame, calls: DataFrame, imports: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """calls(call, caller, target, line, ...) -> them with `resolved`, `confidence`, `bucket` (null where resolved) and
    `candidates`. `call` must be unique; a call that is resolved already is kept so, without confidence."""
    owner = symbols.select(F.col("id").alias("caller"), "language", "component", F.col("source.file").alias("file"), F.coalesce(F.transform("signature.inputs", lambda i: i["name"]), F.array().cast("array<string>")).alias("params"))
    segs = text.target_segments(F.col("target"))
    c = calls.join(owner, "caller").withColumn("segs", segs)
    c = c.withColumn("head", F.get("segs", F.lit(0))).withColumn("tail", F.slice("segs", 2, F.greatest(F.size("segs") - 1, F.lit(0))))
    for optional, kind in (("resolved", "string"), ("dynamic", "boolean")):
        if optional not in calls.columns:
            c = c.withColumn(optional, F.lit(None).cast(kind))
    shadow = F.coalesce(F.array_contains("params", F.col("head")), F.lit(False))
    unnamed = F.col("head").isNull() | F.col("head").isin("this", "super")
    c = c.withColumn("shadow", shadow).withColumn("unnamed", unnamed)
    top = _unique(symbols.where(~F.col("name").contains(".") & ~F.col("name").contains("::")), {"file": F.col("source.file"), "head": F.col("name")}).toDF("file", "head", "f_n", "f_hit", "f_all")
    c = c.join(top, ["file", "head"], "left")
    inner = symbol_id(F.col("language"), F.col("file"), F.array_join("segs", "."))
    kept = symbols.where("not dropped").select(F.col("id").alias("m_id"))
    c = c.withColumn("m_want", F.when((F.col("f_n") == 1) & (F.size("tail") > 0), inner)).join(kept, F.col("m_want") == F.col("m_id"), "left")
    c = c.withColumn("file_hit", F.when(F.col("f_n") == 1, F.when(F.size("tail") > 0, F.col("m_id")).otherwise(F.col("f_hit"))))
    if imports is not None:
        found = import_hits(c.select("call", "file", "language", "head", "tail"), symbols, imports).toDF("call", "i_n", "i_hit", "i_all")
        c = c.join(found, "call", "left")
        outside = imports.where(~F.col("source").rlike(r"^\.\.?(/|$)"))
        names = outside.select("file", F.explode(F.concat(F.transform(F.coalesce("symbols", F.array().cast("array<string>")), lambda r: text.alias_parts(r)["local"]), F.array_compact(F.array("namespace_binding")))).alias("head")).distinct().withColumn("outside", F.lit(True))
        c = c.join(names, ["file", "head"], "left")
    else:
        c = c.withColumn("i_n", F.lit(None).cast("long")).withColumn("i_hit", F.lit(None).cast("string")).withColumn("i_all", F.lit(None).cast("array<string>")).withColumn("outside", F.lit(None).cast("boolean"))
    near = _unique(symbols, {"language": F.col("language"), "comp": F.coalesce("component", F.lit("\0")), "target": F.col("name")}).toDF("language", "comp", "target", "c_n", "c_hit", "c_all")
    wide = _unique(symbols, {"language": F.col("language"), "target": F.col("name")}).toDF("language", "target", "w_n", "w_hit", "w_all")
    c = c.withColumn("comp", F.coalesce("component", F.lit("\0"))).join(near, ["language", "comp", "target"], "left").join(wide, ["language", "target"], "left")
    if hints is not None:
        told = hints.select("file", "line", F.col("target").alias("l_hit")).join(symbols.where("not dropped").select(F.col("id").alias("l_hit")), "l_hit", "left_semi").groupBy("file", "line").agg(F.min("l_hit").alias("l_hit"))
        c = c.join(told, ["file", "line"], "left")
    else:
        c = c.withColumn("l_hit", F.lit(None).cast("string"))
    dotted = F.size("tail") > 0
    one = lambda n, hit: F.when(F.col(n) == 1, F.col(hit))
    free = ~F.col("shadow") & ~F.col("unnamed")
    hits = [
        (F.when(free, F.col("file_hit")), "high"),
        (F.when(free, one("i_n", "i_hit")), "high"),
        (F.when(free & dotted, one("c_n", "c_hit")), "medium"),
        (F.when(free & dotted, one("w_n", "w_hit")), "low"),
        (F.when(~F.col("shadow"), F.col("l_hit")), "high"),
    ]
    fresh = F.coalesce(*(h for h, _ in hits))
    sure = F.coalesce(*(F.when(h.isNotNull(), conf) for h, conf in hits))
    several = lambda n, a, when: F.when(when & (F.col(n) > 1), F.col(a)).otherwise(F.array().cast("array<string>"))
    options = F.array_sort(F.array_distinct(F.flatten(F.array(several("f_n", "f_all", free), several("i_n", "i_all", free), several("c_n", "c_all", free & dotted), several("w_n", "w_all", free & dotted)))))
    c = c.withColumn("fresh", fresh).withColumn("options", options)
    bucket = (
        F.when(F.col("resolved").isNotNull() | F.col("fresh").isNotNull(), None)
        .when(F.col("shadow"), "local-scope")
        .when(F.coalesce("dynamic", F.lit(False)) | F.col("unnamed"), "dynamic")
        .when(F.size("options") > 0, "ambiguous")
        .when(F.coalesce("outside", F.lit(False)), "external")
        .otherwise("no-match")
    )
    return c.select("call", "caller", "target", "line", F.coalesce("resolved", "fresh").alias("resolved"), F.when(F.col("resolved").isNull(), sure).alias("confidence"), bucket.alias("bucket"), F.when(bucket == "ambiguous", F.col("options")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """One edge a call site that was resolved here."""
    return resolved.where("resolved is not null and confidence is not null").select(F.col("caller").alias("from"), F.col("resolved").alias("to"), "confidence", "line")


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.select("from", "to").distinct().select("from", "to", F.lit("call").alias("via"), F.lit("outbound").alias("direction"), F.lit(None).cast("string").alias("effect"))


def edges_of_document(symbols: DataFrame) -> DataFrame:
    """Call edges of a stored snapshot; each has its caller's confidence."""
    return symbols.select(F.col("id").alias("from"), "confidence", F.explode("calls").alias("c")).where("c.resolved is not null").select("from", F.col("c.resolved").alias("to"), "confidence", "c.line")


def census(resolved: DataFrame) -> DataFrame:
    """One row: total, resolved, and calls by bucket."""
    return resolved.agg(F.count("*").alias("total"), F.count("resolved").alias("resolved"), *(F.count_if(F.col("bucket") == b).alias(b.replace("-", "_")) for b in BUCKETS))


def callers(dependencies_: DataFrame, symbol: str) -> DataFrame:
    return dependencies_.where((F.col("via") == "call") & (F.col("to") == symbol)).select("from").distinct().orderBy("from")
