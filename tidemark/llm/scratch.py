"""Tables and files between the jobs of one operator, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder is made if the
master is local (tests on one machine); on a cluster that is an error. A table written here cuts the lineage: an executor that is
lost later costs its own tasks and nothing before them.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}
#: Seconds between two collections of the driver's garbage, and when the last one was.
PAUSE = 5.0
_last = [0.0]
#: Most bytes that Spark hands to a Python worker at a time while a table is written.
BATCH = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _unset[app]


@contextmanager
def small_batches(spark: SparkSession):
    """Rows with long texts come to Python workers a few MB at a time, not 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is not None:
        spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(name, before)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def lean(run: Callable) -> Callable:
    """run, a function of Arrow batches in a worker that lives on, giving back what memory it does not need: Arrow's
    buffers come from the system's pool, blocks from a MB up go back when they are freed, the rest at the end."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        pa.set_memory_pool(pa.system_memory_pool())
        if libc:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with what was freed
        try:
            yield from run(batches)
        finally:
            if libc:
                libc.malloc_trim(0)

    return held


class Scratch:
    """The tables of one run, each under its name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        self.made: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and to be read again."""
        self.made.add(name)
        with small_batches(self.spark):
            df.write.parquet(self.path(name))
        self.release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, name: str, df: DataFrame, buckets: int, *keys: str) -> DataFrame:
        """As table, in buckets of keys: what groups or joins by them later need not shuffle it."""
        called = f"tidemark_{name}_{uuid.uuid4().hex}"
        with small_batches(self.spark):
            df.write.format("parquet").bucketBy(buckets, *keys).option("path", self.path(name)).saveAsTable(called)
        self.tables[name] = called
        self.made.add(name)
        self.release()
        return self.spark.table(called)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.made.discard(name)
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(self.made - {*names}))

    def release(self) -> None:
        """Shuffle files of ended jobs go when the driver forgets their plans; see to it now and then."""
        if time.monotonic() - _last[0] >= PAUSE:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            # What the driver's own arrays left behind goes back, too.
            pa.default_memory_pool().release_unused()
            if libc := _libc():
                libc.malloc_trim(0)
            _last[0] = time.monotonic()


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
