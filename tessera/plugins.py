"""Plugins of third parties: what they must offer, their manifests, and how a configuration's references become plugins.

A plugin is a Python object with a `manifest` (a dict, or JSON with comments) and, by its type,

- effects: `classify(target, imports, argument_count)` -> Column of struct<id, confidence, derived_by> or null, all three
  given as Columns; optionally `drop_callees`, prefixes of calls that say nothing.
- framework: `classify_symbol(symbol)` -> Column of struct<ext_kind, derived_by, confidence> or null, where symbol maps the
  names in SYMBOL_FIELDS to Columns; optionally `decorator_boundaries`, names of decorators that are boundaries.
- lang: `extensions`, optionally `language` (else the name behind `lang-`), and `extract(files)` from DataFrame(path, text) to (path, symbols, imports, error) as
  `sources.typescript.extract` gives them; optionally `file_drop_patterns`, globs of files that are not read.

Columns keep a plugin inside Catalyst's plan; one that needs Python wraps it in an Arrow or Pandas UDF of its own."""

from __future__ import annotations

import importlib
import importlib.util
import json
import re
import sys
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.config import BadConfig, Config, Registry, hint_manifest, strip_comments

BUCKETS = ("lang", "framework", "effects")
SYMBOL_FIELDS = ("id", "kind", "name", "file", "decorators", "derived_by", "imports", "content", "signature", "calls")
NAME = r"[a-z][a-z0-9-]*"
VERSION = r"\d+\.\d+\.\d+(?:[-+].+)?"
NEED = {"lang": ("extract", "extensions"), "framework": ("classify_symbol",), "effects": ("classify",)}
#: Where a bare name is looked for.
PACKAGE = "tessera_"


class BadPlugin(BadConfig):
    pass


class BadInput(ValueError):
    pass


def manifest(given: dict | str, where: str) -> dict:
    """A manifest that is checked: name, version, type and provides, all vocabulary lists of strings."""
    if isinstance(given, str):
        try:
            given = json.loads(strip_comments(given))
        except (json.JSONDecodeError, BadConfig) as e:
            raise BadPlugin(f"{where}: manifest-parse-failed: {e}") from e
    wrong = lambda what: BadPlugin(f"{where}: manifest-invalid: {what}")
    if not isinstance(given, dict):
        raise wrong("not an object")
    for key, shape in (("name", NAME), ("version", VERSION)):
        if not isinstance(given.get(key), str) or not re.fullmatch(shape, given[key]):
            raise wrong(key)
    if given.get("type") not in BUCKETS:
        raise wrong("type")
    if not isinstance(given.get("provides"), dict):
        raise wrong("provides")
    for space, values in given["provides"].items():
        if not isinstance(values, list) or not all(isinstance(v, str) and v for v in values):
            raise wrong(f"provides.{space}")
    return given


@dataclass
class Loaded:
    """Plugins in the configuration's order; of effects and of frameworks the first answer counts."""

    lang: list = field(default_factory=list)
    framework: list = field(default_factory=list)
    effects: list = field(default_factory=list)
    registry: Registry = field(default_factory=Registry)


def specifier(ref: str, root: str | Path) -> str | Path:
    """`./` and `../` are files below the workspace, names with a dot or a slash are modules as they stand, others are
    packages of this project's prefix."""
    if ref.startswith(("./", "../")):
        return (Path(root) / ref).resolve()
    return ref.replace("/", ".") if "." in ref or "/" in ref else PACKAGE + ref.replace("-", "_")


def module_of(ref: str, root: str | Path):
    at = specifier(ref, root)
    try:
        if isinstance(at, str):
            return importlib.import_module(at)
        name = "tessera_plugin_" + re.sub(r"\W", "_", str(at))
        spec = importlib.util.spec_from_file_location(name, at)
        if spec is None or spec.loader is None:
            raise ImportError(f"{at} is no Python file")
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        spec.loader.exec_module(module)
        return module
    except Exception as e:  # a plugin may fail in any way while it is imported
        raise BadPlugin(f"{ref}: {type(e).__name__}: {e}") from e


def picked(module, ref: str):
    """The module's `default`, else `plugin`, else its first attribute that is no class and has a manifest."""
    names = ("default", "plugin", *(n for n in vars(module) if not n.startswith("_")))
    for value in (vars(module)[n] for n in names if n in vars(module)):
        if not isinstance(value, type) and isinstance(getattr(value, "manifest", None), (dict, str)):
            return value
    raise BadPlugin(f"{ref}: nothing in the module has a manifest")


def load(config: Config, root: str | Path = ".", given: tuple = ()) -> Loaded:
    """The plugins that a configuration names, behind those that are given as objects. Vocabulary that clashes, a plugin
    under the wrong heading and one that lacks what its type needs are errors."""
    out = Loaded()
    if (hints := hint_manifest(config.framework_hints)) is not None:
        out.registry.register(hints)
    refs = [(ref, bucket) for bucket, names in zip(BUCKETS, (config.languages, config.frameworks, config.effects), strict=True) for ref in names]
    for ref, bucket, plugin in (*((getattr(p, "__name__", repr(p)), None, p) for p in given), *((ref, bucket, picked(module_of(ref, root), ref)) for ref, bucket in refs)):
        said = manifest(plugin.manifest, ref)
        if bucket not in (None, said["type"]):
            raise BadPlugin(f"{ref}: a plugin of type {said['type']} among {bucket}")
        if lacking := [n for n in NEED[said["type"]] if not hasattr(plugin, n)]:
            raise BadPlugin(f"{ref}: has no {', '.join(lacking)}")
        out.registry.register(said)
        getattr(out, said["type"]).append(plugin)
    return out


def name_of(plugin) -> str:
    return manifest(plugin.manifest, repr(plugin))["name"]


def language_of(plugin) -> str:
    return getattr(plugin, "language", None) or name_of(plugin).removeprefix("lang-")


def first_effect(plugins: list, target: Column, imports: Column, arguments: Column) -> Column | None:
    """struct<plugin, effect> of the first plugin that answers; None without plugins."""
    hit = lambda p: (p, p.classify(target, imports, arguments))
    answers = [F.when(got.isNotNull(), F.struct(F.lit(name_of(p)).alias("plugin"), F.struct(*(got[c].alias(c) for c in ("id", "confidence", "derived_by"))).alias("effect"))) for p, got in map(hit, plugins)]
    return F.coalesce(*answers) if answers else None


def undeclared(symbols: DataFrame, registry: Registry, known: tuple[str, ...] = ()) -> DataFrame:
    """(space, value): effects of the x- kind and kinds of the symbols that no manifest declares, by id or by prefix, and
    that are not `known`."""
    effects = symbols.select(F.explode("effects").alias("e")).select(F.lit("effects").alias("space"), F.col("e.id").alias("value")).where(F.col("value").startswith("x-"))
    kinds = symbols.where("ext_kind is not null").select(F.lit("extKinds").alias("space"), F.col("ext_kind").alias("value"))
    found = effects.unionByName(kinds).distinct()
    fine = F.col("value").isin(*known) if known else F.lit(False)
    for space, value in registry.ids:
        fine = fine | ((F.col("space") == space) & (F.col("value") == value))
    for space, prefix in registry.prefixes:
        fine = fine | ((F.col("space") == space) & ((F.col("value") == prefix) | F.col("value").startswith(prefix + ":")))
    return found.where(~fine)


def checked_imports(imports: DataFrame, plugin: str) -> DataFrame:
    """imports(file, source, symbols, line, ...) as given; evaluating a row whose source, or half of whose binding, is empty
    is an error that names the plugin, file and line."""
    from .functions.text import alias_parts

    where = F.concat(F.lit(f"{plugin} ("), F.col("file"), F.lit(", line "), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit("): "))
    half = F.exists(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: (F.coalesce(alias_parts(s)["imported"], F.lit("")) == "") | (F.coalesce(alias_parts(s)["local"], F.lit("")) == ""))
    no_source = F.coalesce("source", F.lit("")) == ""
    message = F.when(no_source, F.concat(where, F.lit("the import has no source"))).when(half, F.concat(where, F.lit("a binding of the import has an empty half")))
    return imports.withColumn("source", F.when(message.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("source")))
