"""Boundary formats: JSON Lines and single JSON objects, CSV grids, file inventories, sealed reads, publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One strict object per line; blank lines are skipped, anything else that does not parse fails with its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_object(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds one object; arrays and scalars fail."""
    text = spark.read.text(path, wholetext=True)
    bad = text.where(~F.col("value").rlike(r"^\s*\{"))
    if not bad.isEmpty():
        raise ValueError(f"{path} does not hold a JSON object")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """JSON Lines with sorted keys. ``order`` sorts the whole output over ``files`` range-partitioned files."""
    keys = sorted(df.columns)
    dealt = df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)
    dealt.sortWithinPartitions(*order).select(*keys).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_grid(df: DataFrame, path: str) -> None:
    """A table's text grid as CSV without a header, every field quoted."""
    df.write.mode("errorifexists").option("quoteAll", True).option("emptyValue", "").csv(path)


def read_grid(spark: SparkSession, path: str, columns: int) -> DataFrame:
    return spark.read.schema(", ".join(f"c{i} string" for i in range(columns))).option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def inventory(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), sha256 and byte_size of every file below a folder but those named in ``skip``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    path = F.regexp_replace("path", f"^.*?{prefix}/", "")
    found = files.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"))
    return found.where(~F.col("path").isin(*skip)) if skip else found


def inventory_violations(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files missing, added or changed against an inventory; none means that it is closed."""
    a, b = expected.alias("a"), found.alias("b")
    state = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "extra").when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "changed").when(F.col("a.byte_size") != F.col("b.byte_size"), "resized")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), state.alias("violation")).where("violation is not null")


def read_sealed(spark: SparkSession, root: str, manifest: DataFrame, schema: StructType | str, name: str) -> DataFrame:
    """A JSON Lines file of ``root`` after its digest agrees with the manifest."""
    bad = inventory_violations(manifest.where(F.col("path") == name), inventory(spark, root).where(F.col("path") == name))
    if not bad.isEmpty():
        raise ValueError(f"{name} differs from its seal: {bad.first().violation}")
    return read_jsonl(spark, f"{root}/{name}", schema)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, path: str, digest: str) -> str:
    """Publish a table once: staged write, rename, completion record last. The same digest again is reused; another fails."""
    spark = df.sparkSession
    fs, target, make = _fs(spark, path)
    seal = f"{path}/_completion"
    if fs.exists(make(seal)):
        held = spark.read.text(seal).first().value
        if held != digest:
            raise ValueError(f"{path} holds {held}, not {digest}")
        return "reused"
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(f"{staged}/data")
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(f"{staged}/_completion")
    if fs.exists(target):
        fs.delete(make(staged), True)
        raise ValueError(f"{path} exists without a completion record")
    fs.mkdirs(target.getParent())
    if not fs.rename(make(staged), target):
        raise ValueError(f"{path} could not be put in place")
    return "published"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A published table; without its completion record it does not exist."""
    fs, _, make = _fs(spark, path)
    if not fs.exists(make(f"{path}/_completion")):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/data")


def replace_product(df: DataFrame, path: str, key: str, value: str) -> None:
    """Replace one product of a partitioned table, keeping the others."""
    df.withColumn(key, F.lit(value)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
