"""Shared pieces of the text operators: storage in the shared folder, tokens, row chunks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and text normalisations here, as a regex class body.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Shuffle files of a query are removed when it ends; while it runs they serve its retries.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of this many bytes, not of 10,000 rows whatever they hold: JVM and worker both hold a task's batch.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, a new temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_loomstat_dir", None)
    if own is None:
        own = spark._loomstat_dir = "file://" + tempfile.mkdtemp(prefix="loomstat-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _sparing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query, and batches for Python are small."""
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(BATCH_BYTES, int(re.sub("[bB]$", "", before[BATCH])))))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: By operator, what a worker keeps from task to task.
KEPT: dict[str, dict] = {}


def give_back(own: str | None = None) -> None:
    """Called in a worker when a task begins: what other operators than `own` kept is dropped, and what is freed goes back to the
    system. Left alone, glibc keeps arrays of up to 32 MB once one of that size was freed, and Arrow's own allocator what it had, as long as the worker lives, also while it waits and the JVM works."""
    import pyarrow as pa

    for name in KEPT.keys() - {own}:
        KEPT[name].clear()
    pool = pa.system_memory_pool()
    if pa.default_memory_pool().backend_name != pool.backend_name:
        pa.set_memory_pool(pool)
    try:
        libc = ctypes.CDLL(None)
        for parameter in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            libc.mallopt(parameter, 1 << 20)
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written in the shared folder: cuts the lineage and survives lost executors. See discard()."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _sparing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomstat_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more. Tables that a returned DataFrame reads stay."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._loomstat_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exact(df: DataFrame, column: str, none: str) -> DataFrame:
    """The column with 0 for null, and whether it was null in the column `none`: integers beside nulls would reach pandas as doubles."""
    return df.withColumn(none, F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column), F.lit(0)))


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or one made from it, that no column of the frames has in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the text's words: maximal runs without white space (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
