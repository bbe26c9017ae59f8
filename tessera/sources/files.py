"""Source files as rows: discovery, what is left out and why, routing to a language."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import extension, gitignore_patterns, matches_any
from ..functions.text import nfc

#: What is never read.
IGNORED = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.output/**", "**/coverage/**",
    "**/__snapshots__/**", "**/*.snap", "**/*.d.ts", "**/*.d.mts", "**/*.d.cts", "**/*.generated.*", "**/*.gen.*", "**/*.g.ts", "**/*.min.js", "**/*.bundle.js",
    "**/__pycache__/**", "**/*.pyc", "**/.venv/**", "**/venv/**", "**/site-packages/**", "**/vendor/**", "**/Cargo.lock", "**/go.sum",
)
#: Extension to language.
LANGUAGES = {
    ".ts": "ts", ".mts": "ts", ".cts": "ts", ".tsx": "tsx", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx", ".py": "py", ".go": "go", ".rs": "rs", ".java": "java", ".kt": "kt", ".kts": "kt",
    ".scala": "scala", ".rb": "rb", ".php": "php", ".cs": "cs", ".swift": "swift", ".ex": "ex", ".exs": "ex",
}
LARGEST = 2 * 1024 * 1024


@dataclass
class Found:
    """files(path, spelling, length, content), skipped(path, reason, detail), colliding(path, spellings)."""

    files: DataFrame
    skipped: DataFrame
    colliding: DataFrame


def read_tree(spark: SparkSession, root: str, names: str | None = None) -> DataFrame:
    """(path below root, length, content), of files whose names fit a glob, if one is given. Content is only read where a
    query uses it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", names) if names else reader).load(root)
    base = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    rel = F.regexp_replace(base, F.lit("^" + _quoted(root.rstrip("/")) + "/"), F.lit(""))
    return files.select(rel.alias("spelling"), "length", "content")


def _quoted(root: str) -> str:
    import re

    return re.escape("/" + re.sub(r"^[a-z]+:/+", "", root).lstrip("/"))


def gitignore(spark: SparkSession, path: str) -> list[str]:
    """Patterns of the root's .gitignore; none where there is no such file."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return gitignore_patterns("\n".join(r.value for r in spark.read.text(path).collect()))


def hidden(p: Column) -> Column:
    return p.rlike(r"(^|/)\.")


def discover(tree: DataFrame, extensions: tuple[str, ...] = tuple(LANGUAGES), ignore: tuple[str, ...] = (), largest: int = LARGEST) -> Found:
    """tree(spelling, length, content) -> what is to be read. Two spellings of one normal path withdraw each other; files
    over `largest` bytes are skipped. The filter stands before the content, which ignored files never load."""
    out = tree.withColumn("path", nfc(F.col("spelling")))
    known = extension(F.col("path")).isin(*extensions)
    out = out.where(~hidden(F.col("path")) & known & ~matches_any(F.col("path"), [*IGNORED, *ignore]))
    many = F.count("*").over(Window.partitionBy("path"))
    out = out.withColumn("__n", many)
    colliding = out.where("__n > 1").groupBy("path").agg(F.array_sort(F.collect_list("spelling")).alias("spellings"))
    single = out.where("__n = 1").drop("__n")
    large = F.col("length") > largest
    skipped = single.where(large).select("path", F.lit("over-size").alias("reason"), F.concat(F.col("length").cast("string"), F.lit(" > "), F.lit(str(largest))).alias("detail"))
    return Found(single.where(~large), skipped, colliding)


def language(path: Column) -> Column:
    """By extension; null where no language claims it."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, extension(path))


def text_of(files: DataFrame) -> DataFrame:
    """content as text; a file that is gone since it was listed has none and is skipped by readers."""
    return files.withColumn("text", F.decode("content", "UTF-8"))


class Ambiguous(ValueError):
    pass


class Router:
    """Extensions to language plugins; two plugins on one extension are an error."""

    def __init__(self, plugins: dict[str, tuple[str, ...]]):
        self.by: dict[str, str] = {}
        for name, extensions in plugins.items():
            for e in extensions:
                e = e.lower()
                if self.by.setdefault(e, name) != name:
                    raise Ambiguous(f"{e} belongs to {self.by[e]} and {name}")

    def route(self, path: str) -> str | None:
        return self.by.get(PurePosixPath(path).suffix.lower())

    def column(self, path: Column) -> Column:
        if not self.by:
            return F.lit(None).cast("string")
        return F.element_at(F.create_map(*[F.lit(x) for kv in self.by.items() for x in kv]), extension(path))
