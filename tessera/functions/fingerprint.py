"""Fingerprints: the first 12 hexadecimal digits of SHA-256 over canonical JSON, keys in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import short_name

ZERO = "000000000000"


def short_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 12)


def canonical(struct: Column) -> Column:
    """Compact JSON of a struct whose fields are in order; nulls are written."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def syntax(normalized: Column) -> Column:
    return F.when(F.trim(normalized) == "", F.raise_error(F.lit("a fingerprint needs text"))).otherwise(short_hash(normalized))


def logic(rules: Column, effects: Column) -> Column:
    """Rules and effect targets in order; no lines, ids or plugins."""
    doc = F.struct(
        F.transform(effects, lambda e: F.struct(e["target"].alias("target"))).alias("effects"),
        F.transform(rules, lambda r: F.struct(r["condition"].alias("condition"), r["expr"].alias("expr"), r["loop_kind"].alias("loopKind"), r["type"].alias("type"), r["what"].alias("what"))).alias("rules"),
    )
    return short_hash(canonical(doc))


def api(kind: Column, ext_kind: Column, name: Column, visibility: Column, decorators: Column, signature: Column) -> Column:
    """What callers see: no parameter names, thrown types sorted, decorators by name and line."""
    ordered = F.array_sort(F.transform(decorators, lambda d: F.struct(d["name"].alias("n"), d["line"].alias("l"), d["raw"].alias("r"), d["boundary"].alias("b"))))
    marks = F.transform(ordered, lambda d: F.struct(d["b"].alias("boundary"), d["n"].alias("name"), d["r"].alias("raw")))
    s = signature
    call = F.when(
        s.isNotNull(),
        F.struct(
            s["async"].alias("async"),
            s["generator"].alias("generator"),
            F.transform(s["inputs"], lambda i: i["type"]).alias("inputs"),
            s["outputs"].alias("outputs"),
            F.array_sort(s["throws"]).alias("throws"),
            s["type_parameters"].alias("typeParameters"),
        ),
    )
    doc = F.struct(marks.alias("decorators"), ext_kind.alias("extKind"), kind.alias("kind"), short_name(name).alias("shortName"), call.alias("signature"), visibility.alias("visibility"))
    return short_hash(canonical(doc))


def of_symbol(dropped: Column, api_: Column, logic_: Column, syntax_: Column) -> Column:
    zero = F.lit(ZERO)
    return F.when(dropped, F.struct(zero.alias("api"), zero.alias("logic"), zero.alias("syntax"))).otherwise(F.struct(api_.alias("api"), logic_.alias("logic"), syntax_.alias("syntax")))
