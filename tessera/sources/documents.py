"""Snapshots in files: JSON documents of one snapshot, and Parquet tables for many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import serialize
from ..functions.paths import basename  # noqa: F401
from ..schema import COMPONENTS, DEPENDENCIES, SKIPPED, SYMBOLS, struct

#: Names in the document against names in the tables, where they differ.
CAMEL = {"ext_kind": "extKind", "derived_by": "derivedBy", "derived_from": "derivedFrom", "drop_reason": "dropReason", "loop_kind": "loopKind", "inferred_throws": "inferredThrows", "type_parameters": "typeParameters", "start_line": "startLine", "end_line": "endLine", "start_column": "startColumn", "end_column": "endColumn", "public_api": "publicApi"}
#: Fields that are left out of a document where they say nothing.
OPTIONAL = {"dropReason", "inferredThrows", "propagated", "derivedFrom", "resolved", "snapshot", "component_"}
SNAKE = {v: k for k, v in CAMEL.items()}


def _camel(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(CAMEL.get(f.name, f.name), _camel(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_camel(kind.elementType))
    return kind


DOCUMENT = T.StructType(
    [
        T.StructField("$schema", T.StringType()),
        T.StructField("symbols", T.ArrayType(_camel(T.StructType([f for f in SYMBOLS.fields if f.name != "snapshot"])))),
        T.StructField("components", T.ArrayType(_camel(COMPONENTS))),
        T.StructField("dependencies", T.ArrayType(DEPENDENCIES)),
        T.StructField("stats", struct("totalFiles int, parsedFiles int, skippedFiles array<struct<path:string,reason:string>>")),
    ]
)


class BadDocument(ValueError):
    pass


def read(spark: SparkSession, path: str, schema: str | None = None) -> dict[str, DataFrame]:
    """A JSON document as tables: symbols, components, dependencies, skipped, stats."""
    doc = spark.read.schema(T.StructType([*DOCUMENT.fields, T.StructField("_bad", T.StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    head = doc.select("$schema", F.col("_bad").isNotNull().alias("bad"), F.col("symbols").isNull().alias("none")).take(2)
    if len(head) != 1 or head[0].bad or head[0].none:
        raise BadDocument(f"{path} is no document of a snapshot")
    if schema is not None and head[0]["$schema"] != schema:
        raise BadDocument(f"{path} has the schema {head[0]['$schema']!r}, not {schema!r}")
    table = lambda c, kind: doc.select(F.explode(c).alias("x")).select(F.col("x").cast(kind).alias("x")).select("x.*")
    own = T.StructType([f for f in SYMBOLS.fields if f.name != "snapshot"])
    return {
        "symbols": table("symbols", own).withColumn("snapshot", F.lit(None).cast("string")).select(*SYMBOLS.names),
        "components": table("components", COMPONENTS),
        "dependencies": table("dependencies", DEPENDENCIES),
        "skipped": table("stats.skippedFiles", SKIPPED),
        "stats": doc.select(F.col("stats.totalFiles").alias("total_files"), F.col("stats.parsedFiles").alias("parsed_files")),
    }


def _plain(value):
    if isinstance(value, dict):
        out = {CAMEL.get(k, k): _plain(v) for k, v in value.items()}
        return {k: v for k, v in out.items() if not (v is None and k in OPTIONAL)}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def write_canonical(tables: dict[str, DataFrame], path: str, schema: str, pretty: bool = False) -> str:
    """The one form of a snapshot, for people and version control. It is one document and so is put together on the
    driver; for large snapshots use write_tables()."""
    rows = lambda df, *order: [_plain(r.asDict(True)) for r in df.orderBy(*order).toLocalIterator()]
    stats = tables["stats"].first()
    doc = {
        "$schema": schema,
        "symbols": [{k: v for k, v in r.items() if k != "snapshot"} for r in rows(tables["symbols"], "id")],
        "components": rows(tables["components"], "id"),
        "dependencies": rows(tables["dependencies"], "from", "to", "via"),
        "stats": {"totalFiles": stats.total_files, "parsedFiles": stats.parsed_files, "skippedFiles": rows(tables["skipped"], "path")},
    }
    text = serialize(doc, pretty)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def write_canonical_diff(found, path: str, schema: str, base_ref: str = "base", head_ref: str = "head", pretty: bool = False) -> str:
    """The one form of a difference (operators.diff.Diff): references, summary, changes with their symbols and deltas,
    components, dependencies, slices, files that neither side read. Like write_canonical() it is put together on the
    driver; for large differences write the tables of Diff as Parquet."""
    from ..operators.delta import symbol_deltas

    plain = lambda r: _plain({k: v for k, v in r.asDict(True).items()})
    rows = lambda df, *order: [plain(r) for r in df.orderBy(*order).toLocalIterator()]
    bare = lambda s: F.struct(*(s[f].alias(f) for f in SYMBOLS.names if f != "snapshot"))
    parts = ("rules", "effects", "calls", "decorators", "inputs")
    delta = F.struct("flags", F.col("signature_delta").alias("signature"), *(F.col(f"{p}_delta").alias(p) for p in parts))
    pair = [F.col("head_id").alias("id"), "status", "rationale", bare(F.col("base")).alias("before"), bare(F.col("head")).alias("after")]
    with_delta = found.full.where("status in ('changed', 'moved+changed')")
    changes = rows(symbol_deltas(with_delta).select(*pair, delta.alias("delta")), "status", "id") + rows(found.full.where("status in ('moved', 'dropped-toggled')").select(*pair), "status", "id")
    for side, status, absent in ((found.sides[0], "removed", "head"), (found.sides[1], "added", "base")):
        s = side.symbols.select("id", bare(F.struct(*side.symbols.columns)).alias("symbol"))
        left = found.left.where(~F.col("dropped") & ((F.col("status") == status) | (F.col("absent_from") == absent)))
        changes += rows(left.join(s, "id").select("id", "status", F.col("absent_from").alias("absentFrom"), "reason", "symbol"), "status", "id")
    doc = {
        "$schema": schema, "base": {"ref": base_ref}, "head": {"ref": head_ref}, "summary": plain(found.summary.first()),
        "symbols": sorted(changes, key=lambda c: (c["status"], c["id"])),
        "components": rows(found.components, "id") if found.components is not None else [],
        "dependencies": rows(found.dependencies, "from", "to", "via", "status"), "slices": rows(found.slices, "id"), "notCompared": rows(found.not_compared, "path"),
    }
    text = serialize(doc, pretty)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet, a folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("symbols", "components", "dependencies", "skipped", "stats")}


def renames(lines: DataFrame) -> DataFrame:
    """lines(value) of a name-status listing: its renames. Fields are split at tabs, so paths may hold blanks."""
    parts = F.split("value", "\t")
    return lines.where(F.col("value").rlike(r"^R\d*\t")).select(F.get(parts, F.lit(1)).alias("old_path"), F.get(parts, F.lit(2)).alias("new_path")).where("new_path is not null")
