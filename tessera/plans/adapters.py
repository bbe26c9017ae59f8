"""The driver's tables as snapshots, calls and files, in DataFrames and in the same words as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import short_hash
from ..operators.diff import Snapshot
from ..schema import SYMBOLS, shaped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_symbols(docs: DataFrame, head: bool) -> DataFrame:
    """A document is a function of a file. The head side edits German texts, moves the files of src3, renames the
    documents of src5 and drops texts under 60 characters instead of 40."""
    folder = F.when(F.col("source") == "src3", F.concat(F.lit("moved/"), "source")).otherwise(F.col("source")) if head else F.col("source")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" edited"))).otherwise(F.col("text")) if head else F.col("text")
    leaf = F.when(F.col("source") == "src5", F.concat(F.lit("x"), "doc_id")).otherwise(F.concat(F.lit("d"), "doc_id")) if head else F.concat(F.lit("d"), "doc_id")
    d = docs.select(F.concat(folder, F.lit("/"), "lang", F.lit(".ts")).alias("file"), F.concat("lang", F.lit("."), leaf).alias("name"), text.alias("text"), "lang", "source", (F.col("n_chars") < (60 if head else 40)).alias("dropped"))
    prints = F.struct(short_hash(F.concat("lang", F.lit("|"), "source")).alias("api"), short_hash(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("logic"), short_hash(F.col("text")).alias("syntax"))
    out = d.select(
        F.concat(F.lit("ts:"), "file", F.lit("#"), "name").alias("id"), "name", F.lit("function").alias("kind"), F.lit("ts").alias("language"), F.lit("public").alias("visibility"), F.lit("high").alias("confidence"),
        "dropped", F.when(F.col("dropped"), "empty body").alias("drop_reason"), F.struct(F.col("file").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")).alias("source"), prints.alias("fingerprint"),
    )
    source = F.struct(F.col("source.file").alias("file"), F.col("source.start_line").alias("start_line"), F.col("source.end_line").alias("end_line"), F.lit(None).cast("int").alias("start_column"), F.lit(None).cast("int").alias("end_column"))
    return shaped(out.withColumn("source", source), SYMBOLS)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Base lacks the documents that are labelled toxic, head those of low quality: they are the added and removed ones.
    What the other side does not have because it did not read the file stands in its skip list: src1 in head."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = []
    for head, bad in ((False, "toxic = 1"), (True, "quality = 0")):
        mine = docs.join(labels.where(bad).select("doc_id"), "doc_id", "left_anti")
        files = docs.where("source = 'src1'" if head else "source = 'src2'").select(F.concat("source", F.lit("/"), "lang", F.lit(".ts")).alias("path")).distinct()
        out.append(Snapshot(document_symbols(mine, head), skipped=files.withColumn("reason", F.lit("over-size" if head else "unreadable"))))
    return out[0], out[1]


def _side(head: bool) -> str:
    folder = "CASE WHEN source = 'src3' THEN 'moved/' || source ELSE source END" if head else "source"
    text = "CASE WHEN lang = 'de' THEN text || ' edited' ELSE text END" if head else "text"
    leaf = "CASE WHEN source = 'src5' THEN 'x' || doc_id ELSE 'd' || doc_id END" if head else "'d' || doc_id"
    bad = "quality = 0" if head else "toxic = 1"
    return f"""SELECT 'ts:' || file || '#' || name AS id, name, file, dropped, left(sha256(lang || '|' || source), 12) AS api, left(sha256(regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g')), 12) AS logic, left(sha256(t), 12) AS syntax
  FROM (SELECT {folder} || '/' || lang || '.ts' AS file, lang || '.' || {leaf} AS name, {text} AS t, lang, source, n_chars < {60 if head else 40} AS dropped FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE {bad}) USING (doc_id))"""


SNAPSHOTS = f"base AS ({_side(False)}),\nhead AS ({_side(True)}),\nbskip AS (SELECT DISTINCT source || '/' || lang || '.ts' AS path, 'unreadable' AS reason FROM documents WHERE source = 'src2'),\nhskip AS (SELECT DISTINCT source || '/' || lang || '.ts' AS path, 'over-size' AS reason FROM documents WHERE source = 'src1')"
RENAMES = "renames AS (SELECT DISTINCT source || '/' || lang || '.ts' AS old_path, 'moved/' || source || '/' || lang || '.ts' AS new_path FROM documents WHERE source = 'src3')"


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.concat("source", F.lit("/"), "lang", F.lit(".ts"))
    return table(spark, sf_dir, "documents").where("source = 'src3'").select(old.alias("old_path"), F.concat(F.lit("moved/"), old).alias("new_path")).distinct()
