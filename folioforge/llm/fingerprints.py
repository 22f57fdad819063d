"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A paragraph is a line of a text, cut after its first ``HEAD`` words and then after every ``BODY`` words, white space at
the ends removed; a text without words is one paragraph if it is not empty. A text's fingerprint is a sketch of the set
of its paragraphs' 64-bit digests: ``CELLS`` cells in three tables; a digest goes to one cell of each table, and a cell
has the number of its digests, their XOR and the XOR of their checks. So equal texts have equal fingerprints, and the
difference of two fingerprints, cell by cell, is a sketch of the digests that only one of the two texts has. A cell of
the difference that holds a single digest (its check fits) gives it away; taking it out of its other cells uncovers more,
round by round. If all cells end up empty, every differing digest is known, and with the set sizes the Jaccard likeness.

Where peeling gets stuck the two texts are sketched anew and larger: digests are dealt to enough tables of ``CELLS`` cells
that each gets about ``LOAD``, and each table is subtracted and peeled by itself, so the work of a text of any length is
proportional to its paragraphs. Tables that get stuck are dealt again, to four with another salt each, until none is left.

Neighbours: rows are ordered by id and a hash of the text, nulls first; bounds of equal ranges (one row for each shuffle
partition, the only rows that reach the driver) deal the rows out, each range gets a copy of the first row of the next, and
a window gives every row its successor; the last row's is the first.

Edge cases: null is the empty text; two texts without paragraphs are alike (1); rows with equal ids are ordered by text,
equal rows follow each other; a single row is its own successor; an empty table gives no rows; further columns are
ignored. Ids may be of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.storage import Scratch, partitions_for

HEAD, BODY = 4, 32  # words
CELLS = 48
LOAD = 20  # digests that differ, for a table of CELLS
ROUNDS = 10
WORD = r"[^\s]++[^\S\n]*+"
PARAGRAPH = rf"(?m)^[^\S\n]*+(?>(?:{WORD}){{1,{HEAD}}})|(?>(?:{WORD}){{1,{BODY}}})"
CELL = "struct<n:int,k:bigint,c:bigint>"


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(F.regexp_replace(p, r"^[^\S\n]++|[^\S\n]++$", "")))
    whole = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    return F.when(text.rlike(r"\S"), F.array_distinct(found)).otherwise(whole)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), c.alias("c"))


def _entry(d: Column, *more: Column) -> Column:
    """A digest with its check and, as bits, its cell in each of the three tables."""
    third = CELLS // 3

    def fields(h: Column) -> Column:
        at = [F.lit(t * third) + F.shiftright(h, 8 * t).bitwiseAND(F.lit(third - 1)).cast("int") for t in range(3)]
        bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), x) for x in at]
        return F.struct(*more, d.alias("k"), F.shiftrightunsigned(h, 32).alias("c"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("at"))

    return _let(F.xxhash64(d), fields)


def _goes_to(entry: Column, i: Column) -> Column:
    return F.getbit(entry["at"], i) == 1


def sketch(digests: Column) -> Column:
    """Cells of a set of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))

    def cells(entries: Column) -> Column:
        def one(i: Column) -> Column:
            return F.aggregate(entries, empty, lambda s, e: F.when(_goes_to(e, i), _cell(s["n"] + 1, s["k"].bitwiseXOR(e["k"]), s["c"].bitwiseXOR(e["c"]))).otherwise(s))

        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), one)

    return _let(F.transform(digests, lambda d: _entry(d)), cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column) -> Column:
    """``only_a`` and ``only_b``, the digests found on either side, and whether these are all (``done``)."""
    none = F.array().cast("array<struct<n:int,k:bigint,c:bigint,at:bigint>>")
    start = F.struct(cells.alias("cells"), none.alias("found"))

    def single(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (x["c"] == F.shiftrightunsigned(F.xxhash64(x["k"]), 32))

    def step(state: Column, _: Column) -> Column:
        pure = F.transform(F.array_distinct(F.transform(F.filter(state["cells"], single), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k")))), lambda x: _entry(x["k"], x["n"].alias("n")))

        def without(found: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                return F.aggregate(found, x, lambda s, p: F.when(_goes_to(p, i), _cell(s["n"] - p["n"], s["k"].bitwiseXOR(p["k"]), s["c"].bitwiseXOR(p["c"]))).otherwise(s))

            less = F.struct(F.transform(state["cells"], one).alias("cells"), F.concat(state["found"], found).alias("found"))
            return F.when(F.size(found) == 0, state).otherwise(less)

        return _let(pure, without)

    def result(state: Column) -> Column:
        def side(sign: int) -> Column:
            return F.transform(F.filter(state["found"], lambda p: p["n"] == sign), lambda p: p["k"])

        done = F.forall(state["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))
        return F.struct(side(1).alias("only_a"), side(-1).alias("only_b"), done.alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, result)


def written(cells: Column) -> Column:
    """A sketch as text: number, digest and check of each cell in hex, nothing for an empty one."""
    return F.array_join(F.transform(cells, lambda x: F.when(x["n"] == 0, F.lit("")).otherwise(F.concat_ws(":", F.hex(x["n"].cast("bigint")), F.hex(x["k"]), F.hex(x["c"])))), ",")


def _likeness(size_a: Column, only_a: Column, only_b: Column) -> Column:
    union = size_a + only_b
    return F.when(union == 0, F.lit(1.0)).otherwise((size_a - only_a) / union).cast("double")


def with_successor(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (id, tie, text) dealt by ranges, with the columns of the next row in ``next``, and ``bucket``."""
    light = docs.select("id", "tie").repartitionByRange(partitions, "id", "tie").withColumn("part", F.spark_partition_id())
    firsts = [r[1] for r in light.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first")).orderBy("part").collect()]
    if not firsts:
        return docs.withColumn("bucket", F.lit(0)).withColumn("next", F.struct("text"))
    kind = dict(docs.dtypes)["id"]
    bounds = F.array(*[F.struct(F.lit(x["id"]).cast(kind).alias("id"), F.lit(x["tie"]).alias("tie")) for x in firsts])
    key, steps = F.struct("id", "tie"), range(max(1, len(firsts).bit_length()) - 1, -1, -1)

    def search(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to < len(firsts)) & (F.try_element_at(bounds, to + 1) <= key), to).otherwise(at)

    bucket = F.aggregate(F.array(*[F.lit(1 << s) for s in steps]), F.lit(0), search)
    rows = docs.withColumn("bucket", bucket).withColumn("copied", F.lit(False))
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(*firsts[(b + 1) % len(firsts)], b) for b in range(len(firsts))], f"first_id {kind}, first_tie bigint, into int")
    copies = docs.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))).dropDuplicates(["into"])
    copies = copies.select("id", "tie", "text", F.col("into").alias("bucket"), F.lit(True).alias("copied"))
    dealt = rows.unionByName(copies).repartition(partitions, "bucket").withColumn("items", paragraphs(F.col("text"))).withColumn("cells", sketch(F.col("items")))
    after = F.lead(F.struct("text", "items", "cells")).over(Window.partitionBy("bucket").orderBy("copied", "id", "tie"))
    return dealt.withColumn("next", after).where(~F.col("copied"))


def _dealt(pairs: DataFrame, level: int, tables: Column) -> DataFrame:
    """Digests of both sides of each pair, by the table they go to."""
    def marked(side: str) -> Column:
        return F.transform(side, lambda d: F.struct(F.lit(side).alias("side"), d.alias("d")))

    sides = F.explode(F.concat(marked("a"), marked("b"))).alias("x")
    rows = pairs.select("row", "kind", "table", tables.alias("tables"), sides).select("row", "kind", (F.col("table") * F.col("tables") + F.pmod(F.xxhash64("x.d", F.lit(level)), F.col("tables"))).alias("table"), "x.*")
    held = [F.collect_list(F.when(F.col("side") == s, F.col("d"))).alias(s) for s in ("a", "b")]
    return rows.repartition(partitions_for(pairs.sparkSession), "row", "kind", "table").groupBy("row", "kind", "table").agg(*held)


def retried(pairs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Of pairs (row, kind, a, b: digests) that one sketch could not tell apart: how many digests only one side has."""
    pairs = pairs.withColumn("table", F.lit(0).cast("bigint"))
    tables, level, done = F.ceil((F.size("a") + F.size("b")) / LOAD), 0, None
    while not pairs.isEmpty():
        level += 1
        told = peel(subtract(sketch(F.col("a")), sketch(F.col("b"))))
        rows = _dealt(pairs, level, tables).withColumn("found", told).select(
            "row", "kind", "table", F.col("found.done").alias("done"), F.size("found.only_a").alias("only_a"), F.size("found.only_b").alias("only_b"),
            *[F.when(~F.col("found.done"), F.col(side)).alias(side) for side in ("a", "b")],
        )
        tried = scratch.save(rows, f"tables-{level}")
        told = tried.where("done").select("row", "kind", "only_a", "only_b")
        done = told if done is None else done.unionByName(told)
        pairs, tables = tried.where("not done").select("row", "kind", "table", "a", "b"), F.lit(4)
    return done if done is None else done.groupBy("row", "kind").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    The edited text has its last half replaced by as much of the next row's beginning."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = with_successor(docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("tie"), body.alias("text")), partitions_for(spark))
    if "cells" not in rows.columns:
        rows = rows.withColumn("items", paragraphs(F.col("text"))).withColumn("cells", sketch(F.col("items"))).withColumn("next", F.struct("text", "items", "cells"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("id", n.cast("bigint").alias("n_chars"), "items", "cells", edited.alias("edited"), F.col("next.items").alias("next_items"), F.col("next.cells").alias("next_cells"))
    rows = rows.withColumn("edited_items", paragraphs(F.col("edited"))).withColumn("edited_cells", sketch(F.col("edited_items")))
    told = {kind: peel(subtract(F.col("cells"), F.col(f"{kind}_cells"))) for kind in ("edited", "next")}
    rows = rows.select("*", *[x.alias(f"{kind}_told") for kind, x in told.items()])
    base = scratch.save(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            written(F.col("cells")).alias("fingerprint"), written(F.col("edited_cells")).alias("edited_fingerprint"), F.size("items").alias("size"),
            *[F.when(F.col(f"{k}_told.done"), F.struct(F.size(f"{k}_told.only_a").alias("only_a"), F.size(f"{k}_told.only_b").alias("only_b"))).alias(f"{k}_told") for k in told],
            F.when(~(F.col("edited_told.done") & F.col("next_told.done")), F.col("items")).alias("items"),
            *[F.when(~F.col(f"{k}_told.done"), F.col(f"{k}_items")).alias(f"{k}_items") for k in told],
        ),
        "base",
    )
    stuck = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_items").alias("b")) for k in told])).alias("x")
    again = retried(base.where("items is not null").select("row", "items", stuck).where("x.b is not null").select("row", "x.kind", F.col("items").alias("a"), "x.b"), scratch)
    if again is not None:
        wide = again.groupBy("row").agg(*[F.max(F.when(F.col("kind") == k, F.struct("only_a", "only_b"))).alias(f"{k}_again") for k in told])
        base = base.join(wide, "row", "left")
    near = []
    for k in told:
        only = [F.coalesce(F.col(f"{k}_told.{x}"), *([F.col(f"{k}_again.{x}")] if again is not None else [])) for x in ("only_a", "only_b")]
        near.append(_likeness(F.col("size"), *only).alias(f"near_{k}"))
    return base.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
