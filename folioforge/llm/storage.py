"""Tables that jobs write between stages, in the folder every executor shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.executors import ship


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Unset, it is an error on a cluster; a local session gets a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """A folder of its own under the shared root for the intermediate tables of one job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", heavy: bool = False) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here, so a lost executor costs one stage at most. After a ``heavy`` step its shuffle files go at once."""
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        release(self.spark, 0.0 if heavy else PAUSE)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_dealt(self, df: DataFrame, name: str, parts: int, key: str) -> DataFrame:
        """As a heavy ``save``, for a frame dealt by ``key`` in ``parts``: joins by ``key`` find it so and don't deal it again."""
        table = f"folioforge_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").bucketBy(parts, key).sortBy(key).saveAsTable(table, format="parquet", path=f"{self.root}/{name}")
        release(self.spark, 0.0)
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"drop table {table}")  # the catalogue's entry; the files stay

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def same_row(doc_id: str, row: str) -> Column:
    """Whether frames with the aliases x and y mean the same row: an id, null included, and the hash of the text."""
    return F.col(f"x.{doc_id}").eqNullSafe(F.col("y.doc_id")) & (F.col(f"x.{row}") == F.col("y.row"))


def partitions_for(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the count every keyed exchange here asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_RELEASED = [0.0]
PAUSE = 8.0  # seconds between collections on the driver


def release(spark: SparkSession | None = None, pause: float = PAUSE) -> None:
    """Give memory that the driver no longer needs back to the system. With ``spark`` its JVM collects too, now and then,
    which also lets Spark delete the shuffle files and broadcasts of finished steps."""
    if spark is not None:
        if time.monotonic() - _RELEASED[0] < pause:
            return
        _RELEASED[0] = time.monotonic()
    gc.collect()
    _give_back()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def _give_back() -> None:
    """Freed memory that Arrow and the C library hold for later use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def pack_text(text: str | None) -> bytes:
    """A text in fewer bytes, its size before them."""
    raw = (text or "").encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(column: pa.Array) -> list[str]:
    codec = pa.Codec("zstd")
    return [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True).decode() for x in column.to_pylist()]


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors. A worker outlives its task, so each task ends by giving
    back what it has freed; otherwise idle workers keep the peak of every operator that ran in them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)
