"""What operators need of the cluster: this package on the executors, and a shared folder where lineage ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application; every operator with Python tasks calls it first."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session gets one of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="folioforge-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept as a checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder, for plans that read it often; each reader takes its own columns. ``reader``: the session that reads it, if another one."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def beside(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with the settings of ``spark`` but for ``settings``."""
    session = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if session.conf.isModifiable(k):
            session.conf.set(k, v)
    for k, v in settings.items():
        session.conf.set(k, v)
    return session


def kept_dealt(df: DataFrame, name: str, parts: int, key: str, order: str) -> DataFrame:
    """``df`` dealt by ``key`` in ``parts`` (nothing moves if it is so already) and written once as a table in the shared folder; what reads it joins, groups and sorts by ``key`` in the same parts without dealing it again, and finds it sorted by ``key`` and ``order`` there."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key, order).saveAsTable(table, format="parquet", path=f"{shared(spark)}/{table}")
    try:
        return spark.table(table)
    finally:
        spark.sql(f"drop table {table}")  # the catalogue's entry; the files stay for those who read them
