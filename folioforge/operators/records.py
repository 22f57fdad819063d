"""Order of a parsed document's records: pre-order of its body, then the furniture that is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.executors import ship

EVENTS = "doc_id bigint, event_no bigint, kind string, pointer string, layer string, part_no bigint, reason string"
ROOT = "#/body"


class Broken(Exception):
    """A document whose records cannot be put in order: reason and pointer."""


def _place(pointer: str) -> tuple[str, int]:
    parts = (pointer or "").split("/")
    if len(parts) != 3 or parts[0] != "#" or not parts[2].isdigit():
        raise Broken("not a pointer", pointer)
    return parts[1], int(parts[2])


class Walk:
    """One document: ``nodes`` by pointer (layer, clean tables, covered, unplaced), children and captions by owner, in order."""

    def __init__(self, nodes: dict[str, tuple], children: dict[str, list[str]], captions: dict[str, list[str]]):
        self.nodes, self.children = nodes, children
        self.captions = {p: sorted(set(c), key=_place) for p, c in captions.items()}  # the order of several captions is that of their pointers
        self.events: list[tuple[str, str, str, int | None]] = []
        self.said: set[str] = set()
        self.hidden: set[str] = set()

    def node(self, pointer: str) -> tuple:
        _place(pointer)
        if pointer not in self.nodes:
            raise Broken("unknown pointer", pointer)
        return self.nodes[pointer]

    def layer(self, pointer: str) -> str:
        layer = self.node(pointer)[0] or "body"
        if layer not in ("body", "furniture"):
            raise Broken("unknown layer", pointer)
        return layer

    def claim(self, pointer: str) -> None:
        if pointer in self.said:
            raise Broken("met twice", pointer)
        self.said.add(pointer)

    def text(self, pointer: str, layer: str) -> None:
        if self.node(pointer)[3]:  # a text without a valid place is left out
            self.hidden.add(pointer)
            return
        if pointer in self.hidden:
            raise Broken("emitted after it was suppressed", pointer)
        self.claim(pointer)
        self.events.append(("text", pointer, layer, None))

    def hide_below(self, owner: str, kept: set[str]) -> None:
        """Texts below what stands for them (but captions) are suppressed."""
        waiting, seen = list(self.children.get(owner, ())), {owner}
        while waiting:
            pointer = waiting.pop()
            if pointer in kept:
                continue
            if pointer in seen:
                raise Broken("cycle", pointer)
            self.node(pointer)
            if _place(pointer)[0] != "texts":
                seen.add(pointer)
                waiting += self.children.get(pointer, ())
            elif pointer in self.said:
                raise Broken("suppressed after it was emitted", pointer)
            else:
                self.hidden.add(pointer)

    def owner(self, pointer: str, events: list[tuple[str, int | None]]) -> None:
        """A table or picture: its events, then its captions; texts below it are suppressed."""
        self.claim(pointer)
        captions = self.captions.get(pointer, [])
        self.events += [(kind, pointer, self.layer(pointer), part) for kind, part in events]
        for c in captions:
            self.text(c, self.layer(c))
        self.hide_below(pointer, set(captions))

    def run(self) -> list[tuple[str, str, str, int | None]]:
        """Events in order. Groups and tables without clean tables are entered; the stack also holds what ends them."""
        stack: list[tuple[str, str]] = [("enter", p) for p in reversed(self.children.get(ROOT, []))]
        entered: set[str] = set()
        while stack:
            what, pointer = stack.pop()
            if what == "leave":
                entered.remove(pointer)
                if _place(pointer)[0] == "tables":
                    for c in self.captions.get(pointer, []):
                        if c not in self.said:
                            self.text(c, self.layer(c))
                continue
            kind = _place(pointer)[0]
            _, tables, covered, _ = self.node(pointer)
            if kind == "texts":
                if self.layer(pointer) == "body":
                    self.text(pointer, "body")
            elif kind == "pictures":
                self.owner(pointer, [("figure", None)])
            elif kind == "tables" and (covered or tables):
                self.owner(pointer, [] if covered else [("table", k + 1) for k in range(tables)])
            elif kind in ("groups", "tables"):
                if pointer in entered:
                    raise Broken("cycle", pointer)
                if kind == "tables":
                    self.events.append(("table_without_rows", pointer, self.layer(pointer), None))
                entered.add(pointer)
                stack.append(("leave", pointer))
                stack += [("enter", p) for p in reversed(self.children.get(pointer, []))]
            else:
                raise Broken("unknown collection", pointer)
        for pointer in sorted((p for p in self.nodes if p.startswith("#/texts/") and self.nodes[p][0] == "furniture"), key=_place):
            if pointer not in self.hidden and pointer not in self.said:
                self.text(pointer, "furniture")
        return self.events + [("suppressed", p, self.layer(p), None) for p in sorted(self.hidden, key=_place)]


EVENTS_PER_BATCH = 20_000


def _events(doc: int, nodes: dict[str, tuple], children: dict[str, list[str]], captions: dict[str, list[str]]) -> list[tuple]:
    try:
        return [(doc, k, *x, None) for k, x in enumerate(Walk(nodes, children, captions).run(), 1)]
    except Broken as e:
        return [(doc, 1, "violation", e.args[1], None, None, e.args[0])]


def traverse(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Records of documents in order. Documents are dealt in ``parts`` (those of the session if not given), sorted in their tasks
    and read in batches; what is kept is one document.

    ``nodes``: doc_id, pointer, layer (null: body), tables (clean tables made of it), covered (another table stands for it),
    unplaced (a text without a valid place). ``edges``: doc_id, parent (``#/body`` at the top), position, child, caption.
    Kinds: text, table (one a clean table, numbered in ``part_no``), figure, table_without_rows (whose content is entered),
    and, last and by pointer, suppressed. A document with a cycle, a record met twice, or a pointer to nothing has a single
    row of kind violation. Rows without a document are left out.
    """
    ship(nodes.sparkSession)
    doc, none = F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None)
    rows = nodes.select(doc, F.lit(False).alias("edge"), F.col("pointer").alias("at"), F.col("tables").cast("bigint").alias("n"), F.col("layer").alias("to"), F.col("covered").cast("boolean").alias("flag"), F.col("unplaced").cast("boolean").alias("unplaced"))
    rows = rows.unionByName(edges.select(doc, F.lit(True).alias("edge"), F.col("parent").alias("at"), F.col("position").cast("bigint").alias("n"), F.col("child").alias("to"), F.col("caption").cast("boolean").alias("flag"), none.cast("boolean").alias("unplaced")))
    rows = rows.where("doc_id is not null").repartition(*([parts] if parts else []), "doc_id").sortWithinPartitions("doc_id", "edge", F.asc_nulls_last("n"), F.asc_nulls_last("to"))
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in EVENTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known, children, captions, out = None, {}, {}, {}, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, edge, at, n, to, flag, unplaced in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id != here:
                    if here is not None:
                        out += _events(here, known, children, captions)
                    here, known, children, captions = doc_id, {}, {}, {}
                if edge:
                    (captions if flag else children).setdefault(at, []).append(to)
                else:
                    known[at] = (to, n or 0, bool(flag), bool(unplaced))
                if len(out) > EVENTS_PER_BATCH:
                    yield batch_of(out)
                    out = []
        if here is not None:
            out += _events(here, known, children, captions)
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, EVENTS)
