"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that offer them). Each pattern is a node with its
words as capacity, once per repetition level; arcs lead to the quotas of its sources; a level costs more than the one
before (convex), so nothing is repeated while unused text is left for the same quota. The flow of least cost among
the largest flows says how many words of each pattern to take, once, twice or three times over. Documents are then
taken in the order of a seeded hash: all of a pattern for its full levels, and those up to a threshold for the rest.
The threshold comes from two histograms of the hash (``bins`` each), so no pattern is ever gathered or sorted. The cell
that holds it is split by hash and input partition, and the partition in which it lies by the place of its rows, so
that any number of equal rows is split as well.

The driver holds patterns and sources, not documents; more than ``max_patterns`` patterns raise an error. The
documents are read once: sizes, patterns and hashes are written to the shared folder and read from there.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows that
share an id are told apart by their texts; of equal rows as many enter as are needed; null ids hash like a value; an empty
table gives no rows; when all sizes are 0 nothing is taken.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.storage import Scratch

MAX_REPEATS = 3
LEVEL_COSTS = (0, 10, 30)


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; none above ``cap`` times its size, the excess reshared by weight among the others."""
    total, capped = float(sum(sizes)), set()
    out = [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left, weight = total - sum(cap * sizes[i] for i in capped), sum(weights[i] for i in free)
        out = [cap * float(sizes[i]) if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        over = [i for i in free if out[i] > cap * sizes[i]]
        if not over:
            return out
        capped.update(over)
        if len(capped) == len(sizes):
            return [cap * float(s) for s in sizes]


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int]) -> list[int]:
    """Words taken of each pattern: successive shortest paths over source node - pattern levels - quotas - sink."""
    n, m = len(capacity), len(quota)
    sink = n + m + 1
    arcs: list[list[list]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        arcs[a].append([b, cap, cost, len(arcs[b])])
        arcs[b].append([a, 0, -cost, len(arcs[a]) - 1])

    for p in range(n):
        for cost in LEVEL_COSTS:
            arc(0, 1 + p, capacity[p], cost)
        for s in members[p]:
            arc(1 + p, 1 + n + s, MAX_REPEATS * capacity[p], 0)
    for s in range(m):
        arc(1 + n + s, sink, quota[s], 0)
    potential = [0] * (sink + 1)
    while True:
        dist, back = [None] * (sink + 1), [None] * (sink + 1)
        dist[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k, (b, cap, cost, _) in enumerate(arcs[a]):
                if cap > 0 and (dist[b] is None or d + cost + potential[a] - potential[b] < dist[b]):
                    dist[b] = d + cost + potential[a] - potential[b]
                    back[b] = (a, k)
                    heapq.heappush(queue, (dist[b], b))
        if dist[sink] is None:
            break
        far = max(d for d in dist if d is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, dist, strict=True)]
        b, step = sink, None
        while b:
            a, k = back[b]
            step = arcs[a][k][1] if step is None else min(step, arcs[a][k][1])
            b = a
        b = sink
        while b:
            a, k = back[b]
            arcs[a][k][1] -= step
            arcs[b][arcs[a][k][3]][1] += step
            b = a
    taken = [0] * n
    for b, cap, _, _ in ((x[0], x[1], x[2], x[3]) for x in arcs[0]):
        taken[b - 1] -= cap
    return [MAX_REPEATS * capacity[p] + taken[p] for p in range(n)]


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _threshold(rows: DataFrame, rest: DataFrame, column: str, bins: int, keep: list[str]) -> DataFrame:
    """Per pattern of ``rest`` (pattern, need, ...): the bin of ``column`` in which the words taken in hash order pass ``need``, and what is still needed in it."""
    sums = rows.join(F.broadcast(rest), keep).groupBy(*keep, column).agg(F.sum("size").alias("s"), F.first("need").alias("need"))
    upto = F.sum("s").over(Window.partitionBy(*keep).orderBy(column))
    crossed = sums.withColumn("upto", upto).where("upto > need").groupBy(*keep).agg(F.min_by(F.struct(column, "s", (F.col("need") - F.col("upto") + F.col("s")).alias("left")), "upto").alias("x"))
    return crossed.select(*keep, F.col(f"x.{column}").alias(column), F.col("x.left").alias("need"), "x.s")


def _part() -> Column:
    """Input partition of a row, by its place."""
    return F.shiftright("place", 33)


def _split(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Where each pattern's last cell (p, u, v, need, s) is cut: hash, input partition and place of the last row taken, to the nearest row.

    A cell is summed by hash and partition, so what a window orders is small even if the cell is a third of all rows; only
    the rows of one input partition are ordered by place.
    """
    cell = rows.join(F.broadcast(cells.select("p", "u", "v", "need")), ["p", "u", "v"]).select("p", "u", "v", "need", "h", _part().alias("part"), "place", "size")
    sums = cell.groupBy("p", "u", "v", "need", "h", "part").agg(F.sum("size").alias("s"), F.greatest(F.max("size"), F.lit(1)).alias("one"))
    upto = F.sum("s").over(Window.partitionBy("p").orderBy("h", "part"))
    first = F.min_by(F.struct("u", "v", "h", "part", F.floor((F.col("need") - F.col("upto") + F.col("s")) / F.col("one") + 0.5).cast("bigint").alias("k")), "upto").alias("x")
    last = sums.withColumn("upto", upto).where("upto > need").groupBy("p").agg(first).select("p", "x.*")
    there = cell.select("p", "h", "part", "place").join(F.broadcast(last.select("p", "h", "part", "k")), ["p", "h", "part"])
    nth = there.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("place"))).where("n = k").select("p", F.col("place").alias("cut_place"))
    return last.join(nth, "p", "left").select("p", *[F.col(c).alias(f"cut_{c}") for c in ("u", "v", "h", "part")], F.coalesce("cut_place", F.lit(-1).cast("bigint")).alias("cut_place"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sources: str = "source", weights: tuple[float, ...] = (1, 2, 3),
    seed: int = 20, bins: int = 4096, max_patterns: int = 100_000,
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted).

    ``sources``: a string, or an array of strings for documents that several sources offer; source_size and target are
    then those of the first member. Sources weigh ``weights`` in turn, in the order of their code points, null last.
    """
    spark, column = docs.sparkSession, F.col(sources)
    listed = docs.schema[sources].dataType.typeName() == "array"
    scratch = Scratch(spark, "mix")
    pattern = F.array_sort(F.array_distinct(F.coalesce(column, F.array(F.lit(None).cast("string"))))) if listed else F.array(column.cast("string"))
    hashed = F.xxhash64(F.col(doc_id), F.lit(seed), F.col(text))
    low = F.pmod(F.shiftright(hashed, 24), F.lit(bins)).cast("int")
    rows = docs.select(F.col(doc_id).alias("id"), pattern.alias("pattern"), word_count(F.col(text)).alias("size"), F.pmod(F.shiftright(hashed, 40), F.lit(bins)).cast("int").alias("u"), low.alias("v"), hashed.alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.save(rows, "sizes")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((list(r["pattern"]), int(r["size"])) for r in sums), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    offered = [0] * len(names)
    for p, size in patterns:
        for s in p:
            offered[at[s]] += size
    total = sum(size for _, size in patterns)
    target = targets(offered, [weights[i % len(weights)] for i in range(len(names))]) if total else [0.0] * len(names)
    taken = min_cost_flow([s for _, s in patterns], [[at[s] for s in p] for p, _ in patterns], [round(t) for t in target])
    plan = [(p, offered[at[p[0]]], target[at[p[0]]], t // s if s else 0, t % s if s else 0) for (p, s), t in zip(patterns, taken, strict=True)]
    plan_df = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, source_size bigint, target double, copies bigint, need bigint"))

    # arrays that hold null do not equal themselves in a join of arrays in every engine, so patterns are compared as JSON
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("p", F.to_json("pattern"))

    rows, plan_df = keyed(rows), keyed(plan_df).drop("pattern")
    rest = plan_df.where("need > 0").select("p", "need")
    first = _threshold(rows, rest, "u", bins, ["p"])
    second = _threshold(rows, first.withColumnRenamed("u", "cut_u").select("p", F.col("cut_u").alias("u"), "need"), "v", bins, ["p", "u"])
    cuts = F.broadcast(_split(rows, second))
    out = rows.join(F.broadcast(plan_df), "p", "left").join(cuts, "p", "left")
    at_cut, keys = F.struct("cut_u", "cut_v", "cut_h", "cut_part", "cut_place"), F.struct("u", "v", "h", _part().alias("part"), "place")
    more = (F.col("need") > 0) & (keys <= at_cut)
    times = F.col("copies") + F.when(more, 1).otherwise(0)
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("size") * times).alias("taken"))
