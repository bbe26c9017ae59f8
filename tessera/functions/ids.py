"""Identifiers: grammar, parts and composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import violation

LANGUAGE = r"^[a-z][a-z0-9]*$"
RESERVED_LANGUAGE = "slice"
SEGMENT = r"(?:[A-Za-z_$\p{L}][\w$\p{L}\p{N}]*|#[A-Za-z_$\p{L}][\w$\p{L}\p{N}]*|<default>)"
QNAME = rf"^{SEGMENT}(?:(?:\.|::){SEGMENT})*$"
COMPONENT = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
SYMBOL_LIKE = r"^[a-z][a-z0-9]*:[^#]+#.+$"
EXT_KIND = r"^[a-z][a-z0-9-]*(?::[a-z0-9][a-z0-9-]*)+$"


def parts(v: Column) -> Column:
    """struct<language, file, name> of language:file#name, cut at the first : and the first # behind it."""
    get = lambda i: F.regexp_extract(v, r"(?s)^([^:]*):([^#]*)#(.*)$", i)
    return F.struct(get(1).alias("language"), get(2).alias("file"), get(3).alias("name"))


def is_language(v: Column) -> Column:
    return v.rlike(LANGUAGE) & (v != RESERVED_LANGUAGE)


def is_component(v: Column) -> Column:
    return v.rlike(COMPONENT)


def is_qname(v: Column) -> Column:
    return v.rlike(QNAME)


def looks_like_symbol(v: Column) -> Column:
    return v.rlike(SYMBOL_LIKE)


def is_symbol_id(v: Column) -> Column:
    p = parts(v)
    return F.coalesce(v.rlike(r"(?s)^[^:]*:[^#]*#.+$") & is_language(p["language"]) & violation(p["file"], True).isNull() & is_qname(p["name"]), F.lit(False))


def file_of(v: Column) -> Column:
    """The file of an id, or null."""
    return F.when(v.rlike(r"^[^:]+:[^#]+#"), F.regexp_extract(v, r"^[^:]+:([^#]+)#", 1))


def symbol_id(language: Column, file: Column, name: Column) -> Column:
    return F.concat(language, F.lit(":"), file, F.lit("#"), name)


def try_symbol_id(language: Column, file: Column, name: Column) -> Column:
    """Null where the parts make no valid id."""
    v = symbol_id(language, file, name)
    return F.when(is_symbol_id(v), v)


def with_file(v: Column, old: Column, new: Column) -> Column:
    """The id with another file, null where its file is not `old` or the result is no id."""
    p = parts(v)
    moved = symbol_id(p["language"], new, p["name"])
    return F.when((p["file"] == old) & (violation(new, True).isNull()), moved)


def member(owner: Column, name: Column, static: Column) -> Column:
    return F.concat(owner, F.when(static, "::").otherwise("."), name)


def nested(outer: Column, name: Column) -> Column:
    return F.when(outer.isNull() | (outer == ""), name).otherwise(F.concat_ws(".", outer, name))


def top_level(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("<default>"))
