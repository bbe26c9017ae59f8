"""The data model: tables of one snapshot. A snapshot's document is a set of these DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMPLE = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType}


def struct(ddl: str) -> T.StructType:
    """`name type, ...` with array<> and struct<name:type,...>; needs no session, unlike Spark's own parser."""

    def split(body: str, at: str) -> list[str]:
        parts, depth, last = [], 0, 0
        for i, c in enumerate(body):
            depth += (c == "<") - (c == ">")
            if c == at and not depth:
                parts.append(body[last:i])
                last = i + 1
        return [*parts, body[last:]]

    def kind(text: str) -> T.DataType:
        text = text.strip()
        if text.startswith("array<"):
            return T.ArrayType(kind(text[6:-1]))
        if text.startswith("struct<"):
            return T.StructType([T.StructField(n.strip(), kind(k)) for n, k in (f.split(":", 1) for f in split(text[7:-1], ","))])
        return SIMPLE[text]()

    return T.StructType([T.StructField(n.strip("`"), kind(k)) for n, k in (f.strip().split(" ", 1) for f in split(ddl, ","))])


SYMBOLS = struct(
    "snapshot string, id string, kind string, ext_kind string, name string, language string, component string, visibility string, "
    "decorators array<struct<name:string,raw:string,arguments:array<string>,boundary:boolean,line:int>>, "
    "signature struct<inputs:array<struct<name:string,type:string>>,outputs:array<string>,throws:array<string>,inferred_throws:array<string>,async:boolean,generator:boolean,type_parameters:array<string>>, "
    "rules array<struct<type:string,line:int,condition:string,what:string,expr:string,loop_kind:string>>, "
    "effects array<struct<id:string,target:string,line:int,plugin:string,confidence:string,derived_by:string,propagated:boolean,derived_from:array<string>>>, "
    "calls array<struct<target:string,line:int,resolved:string>>, "
    "source struct<file:string,start_line:int,end_line:int,start_column:int,end_column:int>, "
    "fingerprint struct<api:string,logic:string,syntax:string>, confidence string, derived_by array<string>, dropped boolean, drop_reason string"
)
COMPONENTS = struct("id string, name string, roots array<string>, public_api array<string>, languages array<string>, frameworks array<string>, description string")
DEPENDENCIES = struct("`from` string, `to` string, via string, direction string, effect string")
SKIPPED = struct("path string, reason string")
RENAMES = struct("old_path string, new_path string")
IMPORTS = struct("file string, source string, symbols array<string>, is_star boolean, line int, dynamic boolean, namespace_binding string")
HINTS = struct("file string, line int, target string")

#: Fixed values of the model's enumerations.
KINDS = ("function", "method", "class", "interface", "type", "const", "module", "namespace", "variable", "enum", "constructor", "call")
VISIBILITY = ("public", "private", "protected", "internal", "package")
CONFIDENCE = ("low", "medium", "high")
STATUS = ("added", "removed", "changed", "moved", "moved+changed", "dropped-toggled", "unknown")


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; those it lacks are null."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def rank(confidence):
    return F.when(confidence == "high", 2).when(confidence == "medium", 1).otherwise(0)


def label(rank_):
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), (rank_ + 1).cast("int"))
