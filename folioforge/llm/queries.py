"""The operators on the tables of a data folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: expected severity, where grade 1 is toxic and grade 2 toxic and of poor quality."""
    from folioforge.llm.toxicity import severity

    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced, and the replacements of each kind. The key is
    the session's ``spark.folioforge.pseudonyms.key``; without one a key that protects nothing."""
    from folioforge.llm.pseudonyms import pseudonymize

    key = spark.conf.get("spark.folioforge.pseudonyms.key", "a key for tests only")
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words inside benchmark windows, the verdict, and the longest verbatim match with its place."""
    from folioforge.llm.decontamination import contamination

    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at"]
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(*columns)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken."""
    from folioforge.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: rule counts, base verdict, and whether its histograms fit a language."""
    from folioforge.llm.quality import judge

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(table(spark, sf_dir, "documents")).select(*columns)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: predicted language and score, learned from the documents that are not held out."""
    from folioforge.llm.language import identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that repeats, exactly or nearly: its component's first line and whether it is the one that stays."""
    from folioforge.llm.line_dedup import line_components

    return line_components(table(spark, sf_dir, "documents"), min_chars=1)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: word-frequency baseline and the self-attention model's log-probability."""
    from folioforge.llm.lm_scoring import score

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its shingle set and the least id of its component."""
    from folioforge.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: secrets found in its blob, which is scanned once whatever the number of its paths. The ledger is the
    table at ``spark.folioforge.secrets.ledger``, so a later run scans only what is new; without one it begins empty."""
    from folioforge.llm.secrets import scan
    from folioforge.llm.storage import Scratch

    ledger = spark.conf.get("spark.folioforge.secrets.ledger", "") or f"{Scratch(spark, 'secrets').root}/ledger"
    found = scan(table(spark, sf_dir, "documents"), ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of two tokenizers, the groups that both cut, and how often their links occur in the corpus."""
    from folioforge.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    from folioforge.llm.lexical import rank

    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its sketch, that of its edited text, and how alike both and the next document's are."""
    from folioforge.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_severity, op2_pseudonyms, op3_decontamination, op4_source_mixing, op5_quality_divergence,
        op6_language, op7_line_dedup, op8_lm_score, op9_ngram_jaccard, op10_secret_ledger, op11_cross_tokenizer, op12_lexical_search, op13_fingerprints,
    )
}
