"""Components out of a workspace: which folders its managers name, and what their manifests and files say of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import matches_any
from ..functions.text import kebab
from ..operators.aggregates import language_shares, merged_candidates, resolved_ids
from .config import BadConfig, frameworks, public_api
from .files import language

#: Folders that no language is counted in, levels below a component that count, levels of folders looked at.
UNCOUNTED = ("node_modules", ".git", "dist", "build", "coverage", ".next", "__pycache__", "target")
COUNTED_LEVELS, FOLDER_LEVELS = 3, 10
FALLBACK = "ts"
MANIFEST = "name: string, frameworks: array<string>, public_api: array<string>"


def inside(pattern: str) -> str:
    """A manager's pattern as one for folders below the root."""
    mark, body = ("!", pattern[1:]) if pattern.startswith("!") else ("", pattern)
    body = body.removeprefix("./").rstrip("/")
    if body.startswith(("../", "/")) or body == "..":
        raise BadConfig(f"workspace-root-outside: {pattern}")
    return mark + body


def candidates(paths: DataFrame, tools: list[dict]) -> DataFrame:
    """paths(path) of all files, what managers() gives -> (root, tool, manifest, ord): the folders that each tool names,
    with their package.json; for nx, the folders with a project.json, which is their manifest. Hidden folders and
    node_modules are left out, and folders without any file are not seen."""
    own = paths.where(~F.col("path").rlike(r"(^|/)(node_modules|\.git)/"))
    steps = F.split("path", "/")
    depth = F.least(F.size(steps) - 1, F.lit(FOLDER_LEVELS))
    folders = own.where(F.size(steps) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("root")).distinct().where(~F.col("root").rlike(r"(^|/)\."))
    manifest = own.select(F.col("path").alias("manifest"))
    out = folders.select("root", F.lit("").alias("tool"), F.lit("").alias("manifest"), F.lit("").alias("ord")).limit(0)
    for tool in tools:
        if tool["tool"] == "nx":
            at = manifest.where(F.col("manifest").rlike("(^|/)project.json$") & ~F.col("manifest").rlike("(^|/)dist/"))
            at = at.select(F.when(F.contains("manifest", F.lit("/")), F.regexp_replace("manifest", "/[^/]*$", "")).otherwise(".").alias("root"), "manifest")
        else:
            named = folders.where(matches_any(F.col("root"), [inside(p) for p in tool["patterns"]]))
            at = named.join(manifest, F.concat("root", F.lit("/package.json")) == F.col("manifest"), "left")
        out = out.unionByName(at.select("root", F.lit(tool["tool"]).alias("tool"), "manifest", F.lit(tool["tool"]).alias("ord")))
    return out


def described(text: Column) -> Column:
    """A manifest's struct<MANIFEST>; null where it is none."""

    def read(t: str | None) -> dict | None:
        try:
            package = json.loads(t or "")
        except ValueError:
            return None
        if not isinstance(package, dict):
            return None
        name = package.get("name")
        return {"name": name if isinstance(name, str) else None, "frameworks": frameworks(package), "public_api": public_api(package)}

    @F.arrow_udf(f"struct<{MANIFEST}>")
    def manifest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        strings = pa.list_(pa.string())
        for batch in texts:
            yield pa.array([read(t) for t in batch.to_pylist()], pa.struct([("name", pa.string()), ("frameworks", strings), ("public_api", strings)]))

    return manifest(text)


def languages(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(component, language) of roots(root): a file counts for each root that lies at most COUNTED_LEVELS above it, unless
    a hidden or UNCOUNTED folder lies between."""
    steps = F.split("path", "/")
    up = F.explode(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(COUNTED_LEVELS)))).alias("up")
    each = paths.select("path", steps.alias("steps"), language(F.col("path")).alias("language")).where("language is not null").select("steps", "language", up)
    between = F.slice(F.col("steps"), F.size("steps") - F.col("up") + 1, F.col("up"))
    fine = ~F.exists(between, lambda s: s.startswith(".") | s.isin(*UNCOUNTED))
    root = F.array_join(F.slice(F.col("steps"), F.lit(1), F.size("steps") - F.col("up")), "/")
    counted = each.where(fine).select(F.when(root == "", ".").otherwise(root).alias("root"), "language").join(roots.select("root"), "root")
    return language_shares(counted.withColumnRenamed("root", "component")).select("component", "language")


def detect(paths: DataFrame, manifests: DataFrame, tools: list[dict], folder: str) -> DataFrame:
    """paths(path) of all files, manifests(path, text) and what managers() gives for a workspace named `folder` ->
    components (id, name, roots, public_api, languages, frameworks, description), one for each folder that a manager names;
    where none does, the whole workspace is one. An id is the package's name without its scope, or the folder's."""
    spark, paths = paths.sparkSession, paths.select("path")
    named = merged_candidates(candidates(paths, tools)).select("root", "manifest")
    if named.isEmpty():
        named = spark.range(1).select(F.lit(".").alias("root"), F.lit("package.json").alias("manifest"))
    texts = manifests.select(F.col("path").alias("manifest"), described(F.col("text")).alias("m"))
    leaf = F.when(F.col("root") == ".", F.lit(folder)).otherwise(F.element_at(F.split("root", "/"), -1))
    name = F.nullif(F.col("m.name"), F.lit(""))
    bare = F.nullif(F.when(name.startswith("@"), F.get(F.split(name, "/"), F.lit(1))).otherwise(name), F.lit(""))
    base = named.join(texts, "manifest", "left").select("root", "m", F.coalesce(name, leaf).alias("name"), kebab(F.coalesce(bare, leaf)).alias("id"))
    if (row := base.where("id = ''").select("root", "name").first()) is not None:
        raise BadConfig(f"invalid-component-id: {row.name!r} at {row.root!r} leaves no id")
    spoken = languages(paths, named).groupBy(F.col("component").alias("root")).agg(F.array_sort(F.collect_list("language")).alias("languages"))
    filled = lambda c: F.when(F.size(c) > 0, c)
    out = base.drop("id").join(resolved_ids(base.select("root", "id")), "root").join(spoken, "root", "left")
    return out.select("id", "name", F.array("root").alias("roots"), filled(F.col("m.public_api")).alias("public_api"), F.coalesce("languages", F.array(F.lit(FALLBACK))).alias("languages"), filled(F.col("m.frameworks")).alias("frameworks"), F.lit(None).cast("string").alias("description")).orderBy("id")
