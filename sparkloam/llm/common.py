"""What the operators share: table access, the shared folder, cutting lineage."""

from __future__ import annotations

import ctypes
import os
import pkgutil
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the words used here, as the inside of a character class.
WS = r"\x20\x09-\x0D"


#: Rows that pass between the JVM and Python at a time. Rows hold whole texts here, and with
#: Spark's own 10,000 a batch of them and its copies would fill an executor's memory.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, which gives its memory back at its end: a worker outlives it, and while the next
    step fills the JVM, what it still holds counts against the executor's limit, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset and all runs in one process, as in tests, a folder of this process is
    set; on a cluster that is an error, since a folder of one machine is of no use to others.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found := tempfile.mkdtemp(prefix="sparkloam-"))
    return found


#: Frees the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _plain_files(spark: SparkSession) -> dict[str, str]:
    """For writing to file:// paths without checksum files and without processes: Hadoop's local
    file systems start one for the mode of each file and folder that they make, and until such a
    process runs its own program it has all memory of the JVM as its own, too, and may be counted
    with it. Spark's own compiler makes the class of PlainFiles.java, which executors get as a
    jar; where the driver's class loader takes no jars, Hadoop's own class is used."""
    sc, jvm = spark.sparkContext, spark._jvm
    if not hasattr(sc, "_sparkloam_files"):
        sc._sparkloam_files = "org.apache.hadoop.fs.RawLocalFileSystem"
        loader = spark._jsparkSession.sessionState().newHadoopConf().getClassLoader()
        if is_instance_of(sc._gateway, loader, "org.apache.spark.util.MutableURLClassLoader"):
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(loader)
            compiler.cook(pkgutil.get_data(__package__, "PlainFiles.java").decode())
            code = compiler.getBytecodes()
            jar = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sparkloam-")), f"files-{uuid.uuid4().hex}.jar")
            with zipfile.ZipFile(jar, "w") as out:
                for made in code:
                    out.writestr(made.replace(".", "/") + ".class", bytes(code[made]))
            loader.addURL(jvm.java.io.File(jar).toURI().toURL())
            sc._jsc.addJar(jar)
            sc._sparkloam_files = "sparkloam.PlainFiles"
    return {"fs.file.impl": sc._sparkloam_files, "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Later steps then depend on files that outlive any executor and not on shuffles, whose
    files are freed when the table is written. discard() deletes the table.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**_plain_files(spark)).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of stored() that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def held_out(column: str, buckets: int, bucket: int):
    """Whether crc32 of the id as text leaves this remainder; null ids count as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets == bucket


def row_key(id_column, text_column):
    """A key of a row's content: repeated rows share it, so a join on it with one
    row a key gives each of them its result."""
    return F.xxhash64(id_column, text_column)
