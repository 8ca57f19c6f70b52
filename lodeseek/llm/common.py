"""What the corpus operators share: the shared work folder, written tables that cut lineage, input guards."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; our own only where it is unset and driver and
    executors are one process (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodeseek-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/lodeseek/{spark.sparkContext.applicationId}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def new_table(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lodeseek_path = path
    return out


def drop_table(df_or_path, spark: SparkSession) -> None:
    """Deletes a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df_or_path, "lodeseek_path", df_or_path)
    if isinstance(path, str):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps of an iteration."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of one Arrow batch between an executor and its Python workers.
BATCH_BYTES = "2m"


def bounded_batches(spark: SparkSession) -> None:
    """Makes Arrow batches of at most BATCH_BYTES, or one longer text, the session's rule, unless it has one of its own.

    Spark's default of 64 MB takes several hundred MB an executor for long texts.  The bound is the same for all
    operators, so that a plan that runs later runs with it as well."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


def trim() -> None:
    """Hands a Python process's freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(batches: Iterator) -> Iterator:
    """The batches of a task; when it ends, its worker is trimmed.  Else it would keep the most that any operator took,
    beside what the next one takes."""
    yield from batches
    trim()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col, modulus: int):
    """crc32 of an id as text, modulo: the held-out folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)
