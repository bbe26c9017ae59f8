"""What the operators need from a session: the shared folder, cutting lineage, and code for the JVM."""

from __future__ import annotations

import atexit
import ctypes
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

JAVA = Path(__file__).with_name("grouping_sort.java")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this process where that is unset and all runs on one machine,
    as in tests."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with its lineage cut, kept in the shared folder, in at most `most` files."""
    shared_dir(df.sparkSession)
    return (df.coalesce(most) if most else df).checkpoint(eager=True)


def pieces(df: DataFrame, size: int = 4 << 20) -> int:
    """How many partitions of `size` bytes the files below df ask for, as Catalyst's statistics have it, at least one for
    each core; very many where nothing is known. Small results in many files cost more than they hold: every file is
    created, given its rights and renamed apart."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    known = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
    return int(min(1 << 30, max(df.sparkSession.sparkContext.defaultParallelism, known // size + 1)))


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but `used` under names that nothing else has, and what gives their names back, in order."""
    inner = {c: c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(inner), lambda found: found.select(*inner.values()).withColumnsRenamed({v: k for k, v in inner.items()})


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What make() gives, kept by this worker until it holds something else."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def give_back(name: str | None = None) -> None:
    """Workers outlive their tasks: free memory goes back to the system, and what is held under another name than this."""
    for other in [n for n in _HELD if n != name]:
        del _HELD[other]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable, name: str | None = None) -> Callable:
    """run(batches) that gives memory back when its task begins and ends, but for what it holds under `name`."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(name)
        try:
            yield from run(batches)
        finally:
            give_back(name)

    return wrapped


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """By Hadoop's file system, so any store that the session knows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def register_grouping_sort(spark: SparkSession, name: str = "tessera_repeats") -> str:
    """Compile grouping_sort.java with the Java compiler that Spark itself ships for its generated code, put the
    class in a jar in the shared folder, and register it as a SQL function of the session."""
    if spark.catalog.functionExists(name):
        return name
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
    compiler.cook(JAVA.read_text(encoding="utf-8"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as jar:
        for entry in compiler.getBytecodes().entrySet():
            jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    path = f"{shared_dir(spark)}/grouping-sort-{uuid.uuid4().hex}.jar"
    write_bytes(spark, path, packed.getvalue())
    spark.sql(f"ADD JAR '{path}'")
    function = compiler.getClassLoader().loadClass("tessera.llm.GroupingSort").newInstance()
    spark._jsparkSession.udf().register(name, function, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return name
