"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Texts are addressed by SHA-256 (a blob); every row is a path at one of its versions, and several may hold one blob. The
ledger is a Parquet table with one row per blob and rule version: that blob's findings, none included. A scan takes the
blobs whose (blob, rule version) pair the ledger lacks, scans each once, appends them in one commit, and joins the
findings of all blobs back to every path; a scan that fails before the commit leaves the ledger as it was. One scan
writes at a time. Raising ``RULE_VERSION`` makes every blob unseen again and keeps the old rows.

Blobs that hold more than 1 / ``HOT_SHARE`` of all paths (so fewer than that many) are joined in ``SALTS`` parts.

Spans: the text is split at the matches of a rule, so the lengths of the pieces give code-point offsets; matches of a
rule are leftmost and do not overlap, and then those that fail the rule's length are dropped.

Edge cases: a null text is the empty blob; rows with a null path id and repeated rows get their own result rows; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kind, pattern, group whose length counts, least length; in the order that breaks ties of starts.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of hex digits is one match, so the least length may stand in the pattern
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
BASE_KINDS = 3
RULE_VERSION = 1
HOT_SHARE, SALTS = 1000, 128
LEDGER = "blob string, rule_version int, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"


def _matches(text: Column) -> Column:
    """One element per piece of text that a rule's match follows: rule number, piece length, match."""

    def follow(k: int):
        return lambda p, m: F.struct(F.lit(k).alias("rule"), F.length(p).alias("before"), m.alias("match"))

    per_rule = []
    for k, (_, pattern, _, _) in enumerate(RULES):
        pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, follow(k))
        per_rule.append(F.when(text.rlike(pattern), pairs).otherwise(F.array().cast("array<struct<rule:int,before:int,match:string>>")))
    return F.flatten(F.array(*per_rule))


def scan_blobs(blobs: DataFrame, version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text), one each."""
    cells = blobs.select("blob", F.posexplode_outer(_matches(F.col("text"))).alias("i", "m")).select("blob", "i", "m.*")
    so_far = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.col("before") + F.length("match")).over(so_far)
    kept = F.lit(False)
    for k, (_, pattern, group, least) in enumerate(RULES):
        kept = kept | ((F.col("rule") == k) & (F.length(F.regexp_extract("match", pattern, group) if group else F.col("match")) >= least))
    cells = cells.withColumn("end", end).withColumn("ok", F.coalesce(kept, F.lit(False)))
    span = F.struct((F.col("end") - F.length("match")).alias("start"), "rule", "end")
    grouped = cells.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("found"))
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of_kind(k: int) -> Column:
        return F.filter("found", lambda x: x["rule"] == k)

    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{RULES[k][0]}") for k in range(BASE_KINDS)]
    base = listed(F.filter("found", lambda x: x["rule"] < BASE_KINDS)).alias("base")
    return grouped.select("blob", F.lit(version).alias("rule_version"), *counts, base, listed(F.col("found")).alias("spans"))


def unseen(blobs: DataFrame, ledger: DataFrame | None, version: int = RULE_VERSION) -> DataFrame:
    """Of ``blobs`` (blob, text), one row per blob that the ledger lacks under this rule version."""
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"])


def _addressed(paths: DataFrame, path_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return paths.select(F.col(path_id).alias("path_id"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))


def _back(addressed: DataFrame, known: DataFrame, path_id: str) -> DataFrame:
    """Findings of each path's blob."""
    total = addressed.count()
    hot = addressed.groupBy("blob").agg(F.count("*").alias("times")).where(F.col("times") * HOT_SHARE > total).select("blob", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("path_id"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = addressed.select("path_id", "blob").join(F.broadcast(hot), "blob", "left").select("path_id", "blob", salt.alias("salt"))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    known = known.join(F.broadcast(hot), "blob", "left").select(known["*"], salts.alias("salt"))
    return rows.join(known, ["blob", "salt"]).drop("salt").withColumnRenamed("path_id", path_id)


def scan_increment(paths: DataFrame, ledger: DataFrame | None = None, path_id: str = "doc_id", text: str = "text", version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the rows to append to the ledger."""
    addressed = _addressed(paths, path_id, text)
    fresh = scan_blobs(unseen(addressed.select("blob", "text"), ledger, version), version)
    known = fresh if ledger is None else ledger.where(F.col("rule_version") == version).unionByName(fresh)
    return _back(addressed, known, path_id), fresh


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; one that does not exist yet is empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if held else spark.createDataFrame([], LEDGER)


def scan(paths: DataFrame, ledger: str, path_id: str = "doc_id", text: str = "text", version: int = RULE_VERSION) -> DataFrame:
    """Findings of every path, after the blobs that the ledger at ``ledger`` lacks have been scanned and appended to it."""
    spark = paths.sparkSession
    addressed = _addressed(paths, path_id, text)
    fresh = scan_blobs(unseen(addressed.select("blob", "text"), read_ledger(spark, ledger), version), version)
    fresh.write.mode("append").parquet(ledger)
    return _back(addressed, read_ledger(spark, ledger).where(F.col("rule_version") == version), path_id)
