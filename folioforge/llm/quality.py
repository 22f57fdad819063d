"""Quality rules by distribution divergence, in DataFrame functions only.

One pass over the texts gives each document its rule counts and two histograms: character classes, and the common
words of the reference languages with one bin for all other words. The histograms of all documents that pass the base
rules, summed by language, are the references. A document is kept if for some language the Jensen-Shannon distances of
both histograms are within bounds. Guards for length: a bound is ``max_char`` + ``char_slack`` / sqrt(characters), or
``max_word`` + ``word_slack`` / sqrt(words), as a short text strays by chance; a histogram of fewer than ``min_chars``
characters or ``min_words`` words is not judged and passes.

Edge cases: a null or empty text has no words and fails the base rules; a null language joins no reference but is
judged; repeated rows get a row each; an empty table gives no rows; without any reference only the base rules decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.storage import Scratch

# Frequent function words of the reference languages.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "on", "this",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "en",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "nicht",
    "el", "los", "las", "y", "se", "por", "con",
)
# Character classes; what none of them holds is a class of its own (beyond ASCII).
CHAR_CLASSES = ("[AEIOUaeiou]", "[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]", "[0-9]", r"[\x20\x09-\x0D]", r"""[.,;:!?'"()\x2D]""", r"[#*$%&|<>@\[\]\\^_`{}~+=/\x00-\x08\x0E-\x1F\x7F]")
SPACES = r"[\x20\x09-\x0D]+"
POSITION_BITS = 24
MAX_LANGUAGES = 256


def _features(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    start = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), body.alias("t"))
    words = F.filter(F.split("t", SPACES), lambda x: x != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    sizes = [F.length(F.regexp_replace("t", f"{c[:1]}^{c[1:]}+", "")).cast("bigint") for c in CHAR_CLASSES]
    step = start.select(
        "doc_id", "lang", words.alias("w"), F.length("t").cast("bigint").alias("n_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"), lines.alias("lines"), F.array(*sizes).alias("classes"),
    )
    low = 1 << POSITION_BITS
    # a window's key: 40 bits of its hash above its position, so that a plain sort of longs puts equal windows together
    n = F.size("w")
    keys = F.expr(f"transform(sequence(0, size(w) - 3), i -> (shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {POSITION_BITS}) | cast(i as bigint)))")
    both = [*COMMON_WORDS, *(w[0].upper() + w[1:] for w in COMMON_WORDS)]
    step = step.select(
        "doc_id", "lang", "w", n.cast("bigint").alias("n_words"), "n_chars", "n_symbols", "classes",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>")).alias("q"),
        F.filter("w", lambda x: x.isin(both)).alias("common"),
    )
    same = " AND ".join(f"w[cast({{0}} & {low - 1} as int) + {j}] = w[cast(x & {low - 1} as int) + {j}]" for j in range(3))

    def equal(other: str) -> str:
        return f"(shiftright({other}, {POSITION_BITS}) = shiftright(x, {POSITION_BITS}) AND {same.format(other)})"

    seen = F.expr(f"sort_array(filter(transform(q, (x, j) -> IF((j > 0 AND {equal('q[j - 1]')}) OR (j < size(q) - 1 AND {equal('q[j + 1]')}), x & {low - 1}, -1L)), p -> p >= 0))")
    folded = F.transform("common", F.lower)
    step = step.select("doc_id", "lang", "n_words", "n_chars", "n_symbols", "classes", "n_dup_lines", seen.alias("p"), folded.alias("common"))
    covered = F.expr("aggregate(transform(p, (x, k) -> IF(k = 0, 3L, least(3L, x - p[k - 1]))), 0L, (a, x) -> a + x)")
    words = [(F.size("common") - F.size(F.array_remove("common", w))).cast("bigint") for w in COMMON_WORDS]
    rest = (F.col("n_words") - F.size("common")).cast("bigint")
    whole = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return step.select(
        "doc_id", "lang", "n_words", (F.col("n_chars") - F.get("classes", F.lit(3))).alias("word_chars"), "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
        F.concat("classes", F.array(F.col("n_chars") - whole)).alias("char_bins"), F.array(*words, rest).alias("word_bins"), "n_chars",
    )


def js_distance(bins: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between counts and a distribution."""
    total = F.greatest(F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1)).cast("double")

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(x: Column, q: Column) -> Column:
        p = x / total
        return F.lit(0.5) * (part(p, (p + q) / 2) + part(q, (p + q) / 2))

    terms = F.zip_with(bins, F.array(*[F.lit(float(v)) for v in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    min_words: int = 50, min_chars: int = 250, max_repeat_percent: int = 50,
    max_char: float = 0.17, char_slack: float = 1.2, max_word: float = 0.14, word_slack: float = 1.4,
) -> DataFrame:
    """Counts, base verdict, distances to the nearest language, and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = scratch.save(_features(docs, doc_id, text, lang).withColumn("base_failed", base), "features")
    sound = rows.where("not base_failed and lang is not null")
    n_char, n_word = len(CHAR_CLASSES) + 1, len(COMMON_WORDS) + 1
    sums = [F.sum(F.get("char_bins", F.lit(i))).alias(f"c{i}") for i in range(n_char)] + [F.sum(F.get("word_bins", F.lit(i))).alias(f"w{i}") for i in range(n_word)]
    references = sound.groupBy("lang").agg(*sums).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(references) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} reference languages")
    # each distance is an expression of its own that the verdict reads once, and only until a language fits
    near = []
    for r in references:
        chars, words = [r[f"c{i}"] for i in range(n_char)], [r[f"w{i}"] for i in range(n_word)]
        if sum(chars) and sum(words):
            near.append((js_distance(F.col("char_bins"), [x / sum(chars) for x in chars]), js_distance(F.col("word_bins"), [x / sum(words) for x in words]), r["lang"]))
    if not near:
        none = F.lit(None).cast("double")
        return rows.select("*", none.alias("js_char"), none.alias("js_word"), F.lit(None).cast("string").alias("nearest"), (~F.col("base_failed")).alias("kept"))
    char_bound = max_char + char_slack / F.sqrt(F.greatest("n_chars", F.lit(1)))
    word_bound = max_word + word_slack / F.sqrt(F.greatest("n_words", F.lit(1)))

    def within(char: Column, word: Column) -> Column:
        return ((F.col("n_chars") < min_chars) | (char <= char_bound)) & ((F.col("n_words") < min_words) | (word <= word_bound))

    passed = reduce(lambda a, b: a | b, [within(c, w) for c, w, _ in near])
    first = F.array_min(F.array(*[F.struct((c + w).alias("sum"), c.alias("char"), w.alias("word"), F.lit(k).alias("lang")) for c, w, k in near]))
    judged = rows.withColumns({"kept": ~F.col("base_failed") & passed, "near": first})
    return judged.withColumns({"js_char": F.col("near.char"), "js_word": F.col("near.word"), "nearest": F.col("near.lang")}).drop("near")
