"""Operators whose result depends on a sequential choice: grouped by page or document, each group in one pandas call.

Groups are a page's boxes, a document's tables or a region's rows, so a call's memory follows the largest page or
document, not the corpus. Where groups are many and small they are sorted in their tasks and read in batches.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.executors import ship


def _grouped(df: DataFrame, *keys: str):
    """Groups of ``df`` for a function of this package."""
    ship(df.sparkSession)
    return df.groupBy(*keys)


def _cogrouped(left: DataFrame, right: DataFrame, *keys: str):
    """Groups of both frames; the right one's columns are renewed, so frames derived from one another do not share any."""
    ship(left.sparkSession)
    return left.groupBy(*keys).cogroup(right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy(*keys))


def distinct_boxes(boxes: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Boxes (page, box_id, part_no, l, b, r, t) that no larger kept box of their page nearly equals. Pages are sorted in their
    tasks and read in batches; of the kept boxes those too large to be nearly equal to what follows are let go."""
    area = F.expr("(r - l) * (t - b)")
    rows = boxes.select(F.col("page").cast("bigint").alias("page"), F.col("box_id").cast("bigint").alias("box_id"), F.col("part_no").cast("int").alias("part_no"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in "lbrt"])
    rows = rows.repartition("page").sortWithinPartitions("page", area.desc_nulls_last(), "box_id", "part_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept, begin = (), [], 0  # no page yet; one without a number is a page like others
        for batch in batches:
            found = []
            for k, (page, _, _, l, b, r, t) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if page != here:
                    here, kept, begin = page, [], 0
                if None in (l, b, r, t):  # a box without a place equals none
                    found.append(k)
                    continue
                size = (r - l) * (t - b)
                while threshold > 0 and begin < len(kept) and kept[begin][4] * threshold * 0.999 > size:
                    begin += 1
                for y in itertools.islice(kept, begin, None):
                    w, h = min(r, y[2]) - max(l, y[0]), min(t, y[3]) - max(b, y[1])
                    if w > 0 and h > 0 and w * h / (size + y[4] - w * h) >= threshold:
                        break
                else:
                    kept.append((l, b, r, t, size))
                    found.append(k)
                if begin > 1000:
                    del kept[:begin]
                    begin = 0
            yield batch.select(["page", "box_id", "part_no"]).take(pa.array(found, pa.int64()))

    ship(boxes.sparkSession)
    return rows.mapInArrow(run, "page bigint, box_id bigint, part_no int")


def match_regions(regions: DataFrame, tables: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each region (page, id, l, b, r, t) of a page, in visual order, takes the remaining table of greatest overlap, if it is enough. A page's boxes meet in one row, and rows are worked off in batches."""
    box = F.struct("id", "l", "b", "r", "t")
    left = regions.groupBy("page").agg(F.collect_list(box).alias("regions"))
    right = tables.groupBy("page").agg(F.collect_list(box).alias("tables"))

    def overlap(a: dict, b: dict) -> float:
        w, h = min(a["r"], b["r"]) - max(a["l"], b["l"]), min(a["t"], b["t"]) - max(a["b"], b["b"])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a["r"] - a["l"]) * (a["t"] - a["b"]) + (b["r"] - b["l"]) * (b["t"] - b["b"]) - w * h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, boxes, free in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in sorted(boxes, key=lambda x: (-x["t"], x["l"], -x["b"], x["id"])):
                    ranked = min(((-overlap(x, y), y["id"], k) for k, y in enumerate(free)), default=None)
                    if ranked and -ranked[0] >= threshold:
                        out.append((page, x["id"], ranked[1], -ranked[0]))
                        free.pop(ranked[2])
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["page", "region_id", "table_id", "iou"])

    ship(regions.sparkSession)
    return left.join(right, "page").select("page", "regions", "tables").mapInArrow(run, "page bigint, region_id bigint, table_id bigint, iou double")


def select_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, seq, kind, s, e) by start, longer first, kind: taken if they start at or after the last taken end."""

    def run(item: pd.DataFrame) -> pd.DataFrame:
        item = item.assign(size=item.s - item.e).sort_values(["s", "size", "kind"])
        end, keep = -1, []
        for x in item.itertuples(index=False):
            ok = x.s >= end
            keep.append(ok)
            end = x.e if ok else end
        return item[keep].drop(columns="size")

    return _grouped(spans, "doc_id", "seq").applyInPandas(run, spans.schema)


def table_families(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Families of a document's tables: edges (doc_id, a, b, rank) in order of evidence join families unless both hold a table of one page.

    Returns doc_id, table_id, family_no (numbered by first member) and member_no.
    """

    def run(links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page", "page_table_index", "table_id"])
        parent = {t: t for t in rows.table_id}
        pages = {t: {p} for t, p in zip(rows.table_id, rows.page, strict=True)}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in links.sort_values(["rank", "a", "b"]).itertuples(index=False):
            if x.a in parent and x.b in parent:
                a, b = find(x.a), find(x.b)
                if a != b and not pages[a] & pages[b]:
                    parent[b] = a
                    pages[a] |= pages.pop(b)
        numbers: dict = {}
        out, members = [], {}
        for t in rows.table_id:
            k = numbers.setdefault(find(t), len(numbers) + 1)
            members[k] = members.get(k, 0) + 1
            out.append((rows.doc_id.iloc[0], t, k, members[k]))
        return pd.DataFrame(out, columns=["doc_id", "table_id", "family_no", "member_no"])

    return _cogrouped(edges, tables, "doc_id").applyInPandas(run, "doc_id bigint, table_id bigint, family_no bigint, member_no bigint")


OTSL = {"fcel", "ecel", "ched", "rhed", "srow"}  # fixed values: tokens that begin a cell


@functools.lru_cache(maxsize=10_000)
def _spans(grid: tuple[tuple[str, ...], ...]) -> tuple[str | None, tuple]:
    """Cells (row, column, row span, column span, kind) of a grid, or why it has none."""
    reason, cells = _cells(grid)
    return reason, tuple((i, j, max(p[0] for p in places) - i + 1, max(p[1] for p in places) - j + 1, grid[i][j]) for (i, j), places in sorted(cells.items()))


def _cells(grid: tuple[tuple[str, ...], ...]) -> tuple[str | None, dict]:
    if not grid or not all(grid) or len({len(row) for row in grid}) != 1:
        return "rows of different lengths or none", {}
    owner: dict[tuple[int, int], tuple[int, int]] = {}
    for i, row in enumerate(grid):
        for j, token in enumerate(row):
            left, above = owner.get((i, j - 1)), owner.get((i - 1, j))
            if token in OTSL:
                owner[i, j] = (i, j)
            elif token not in ("lcel", "ucel", "xcel"):
                return "unknown token", {}
            else:
                found = left if token == "lcel" else above if token == "ucel" else left if left == above else None
                if found is None:
                    return "a continuation of nothing", {}
                owner[i, j] = found
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for place, origin in owner.items():
        cells.setdefault(origin, []).append(place)
    for (i, j), places in cells.items():
        height, width = max(p[0] for p in places) - i + 1, max(p[1] for p in places) - j + 1
        if height * width != len(places) or min(p[1] for p in places) < j:
            return "a cell that is no rectangle", {}
    return None, cells


def grid_topology(tokens: DataFrame) -> DataFrame:
    """Cells of OTSL token rows (table_id, r, tokens array<string>): each span's origin, extent and kind.

    lcel joins the cell to its left, ucel the one above, xcel both, which must be one cell. A table with another token, rows
    of different lengths, rows without tokens, a continuation of nothing, or a cell that is no rectangle is rejected: it has
    one row without a cell, with the reason. Places count from 0. Tables are sorted in their tasks and read in batches.
    """
    names = ["table_id", "r", "c", "row_span", "column_span", "kind", "rejected"]

    def rows_of(table: int, grid: list[tuple[str, ...]]) -> list[tuple]:
        few = sum(map(len, grid)) <= 64  # small grids repeat
        reason, found = (_spans if few else _spans.__wrapped__)(tuple(grid))
        return [(table, *x, None) for x in found] or [(table, None, None, None, None, None, reason)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, grid, out = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for new, table, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (new, table) != here:
                    if here:
                        out += rows_of(here[1], grid)
                    here, grid = (new, table), []
                grid.append(tuple(tokens or ()))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        if here:
            out += rows_of(here[1], grid)
        if out:
            yield batch_of(out)

    rows = tokens.repartition("table_id").sortWithinPartitions("table_id", F.col("r").asc_nulls_last())
    ship(tokens.sparkSession)
    return rows.select(F.col("table_id").isNull().alias("none"), "table_id", "tokens").mapInArrow(run, "table_id bigint, r int, c int, row_span int, column_span int, kind string, rejected string")
