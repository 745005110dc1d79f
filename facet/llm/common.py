"""What the operators of this subpackage share: reading tables, staging results, session settings."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where that is unset and Spark runs in this one
    process, a temporary folder. Raises ValueError where it is unset on a cluster, whose executors would not find such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_dir, "local"):
        shared_dir.local = tempfile.mkdtemp(prefix="facet-")
    return f"file://{shared_dir.local}"


class Stage:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread and no recomputation.

    write() stores a DataFrame as Parquet and returns it as read back; drop() deletes what is no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_staged", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 2_000_000) -> bool:
    """From now on the session's rows go to Python in batches of about so many bytes, unless it has a bound of its own; whether that changed anything. By Spark's defaults, 10,000 rows and 64 MB, all texts of a task may be
    one batch, held whole in Python and, while it grows, up to twice beside the JVM's heap."""
    if spark.conf.get(BATCHES, None) is not None:
        return False
    spark.conf.set(BATCHES, str(size))
    return True


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches() for what is planned and run within."""
    bound = bound_batches(spark)
    try:
        yield
    finally:
        if bound:
            spark.conf.unset(BATCHES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def one_thread() -> None:
    """Python workers share an executor's cores with its other tasks; libraries must not start a thread per core."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    keep_heap()
    release_unused()


def keep_heap() -> None:
    """Arrays up to 64 MB come from the heap instead of pages mapped and cleared anew for each of them."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def release_unused() -> None:
    """Gives back what earlier tasks of this worker have freed: workers live on between tasks, and allocators keep their peak."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, so that further columns of a table never clash with working ones."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
