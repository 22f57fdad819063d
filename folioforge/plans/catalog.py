"""Operators as named relational definitions over named input relations.

An operator is a SELECT over its inputs, written once and compiled by Catalyst as part of whatever plan it is put in:
``apply(spark, name, **frames)`` binds DataFrames to the inputs and returns a lazy DataFrame. ``query`` binds the inputs
to the fixture relations derived from the tables of a data folder, and ``oracle`` is the same definition in the
spelling of the checking engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans.dialect import DUCKDB, SPARK, Spark

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Definition:
    name: str
    inputs: tuple[str, ...]
    sql: Callable[[Spark], str]
    doc: str


VIEWS: dict[str, Definition] = {}
OPERATORS: dict[str, Definition] = {}


def view(name: str, *inputs: str):
    """A relation that others may take as input."""

    def add(sql: Callable[[Spark], str]) -> Callable[[Spark], str]:
        VIEWS[name] = Definition(name, inputs, sql, sql.__doc__ or "")
        return sql

    return add


def operator(name: str, *inputs: str):
    """A definition that is a query of its own; its inputs are tables, views or other operators."""

    def add(sql: Callable[[Spark], str]) -> Callable[[Spark], str]:
        if name in OPERATORS:
            raise ValueError(f"{name} is defined twice")
        OPERATORS[name] = Definition(name, inputs, sql, sql.__doc__ or "")
        return sql

    return add


def _find(name: str) -> Definition | None:
    return VIEWS.get(name) or OPERATORS.get(name)


def _needed(inputs: tuple[str, ...], seen: list[str], given: frozenset[str] = frozenset(TABLES)) -> list[str]:
    for name in inputs:
        if name in seen or name in given:
            continue
        seen = _needed(_find(name).inputs, seen, given)
        if name not in seen:
            seen.append(name)
    return seen


def statement(name: str, dialect: Spark, bound: dict[str, str] | None = None) -> str:
    """The operator with all relations that it is derived from, over the base tables. ``bound``: relations under other names."""
    operator_, bound = OPERATORS.get(name) or VIEWS[name], bound or {}
    parts = [(n, f"select * from {x}") for n, x in bound.items()]
    parts += [(n, _find(n).sql(dialect)) for n in _needed(operator_.inputs, [], frozenset(bound) | frozenset(TABLES))]
    body = operator_.sql(dialect).strip()
    recursive = body.lower().startswith("with recursive") or any(sql.lower().startswith("with recursive") for _, sql in parts)
    head = ", ".join(f"{n} as ({sql})" for n, sql in parts)
    if body.lower().startswith("with recursive "):
        own = body[len("with recursive ") :]
        return f"with recursive {head + ', ' if head else ''}{own}"
    return f"with {'recursive ' if recursive else ''}{head} {body}" if head else body


ROWS_PER_PART = 250_000  # rows of a table in one part where it is dealt, so that a task's memory stays the same in larger tables


def parts_for(df: DataFrame) -> int:
    """Parts that a table is dealt in; unlike the session's they are not put together again, and grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_PART))


def apply(spark: SparkSession, name: str, parts: int | None = None, **frames: DataFrame) -> DataFrame:
    """The operator (or view) over the given frames, one for each of its inputs (other inputs are derived if they can be). ``parts``: see ``Spark.dealt``.

    The frames are bound under names that nobody else has and that are gone when the plan has been analysed, so the
    caller's own views are neither used nor changed.
    """
    import folioforge.plans.queries  # noqa: F401  (every module with definitions is loaded)

    bound = {n: f"folioforge_{uuid.uuid4().hex}" for n in frames}
    try:
        for n, df in frames.items():
            df.createOrReplaceTempView(bound[n])
        return spark.sql(statement(name, Spark(parts) if parts else SPARK, bound))
    finally:
        for x in bound.values():
            spark.catalog.dropTempView(x)


def over_folder(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None, **frames: DataFrame) -> DataFrame:
    """The operator (or view) over the tables of a data folder. ``frames``: relations that are given and not derived."""
    used = sorted(_tables(OPERATORS.get(name) or VIEWS[name], frozenset(frames)))
    return apply(spark, name, parts, **frames, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_folder(spark, sf_dir, name)

    run.__name__, run.__doc__ = name, OPERATORS[name].doc
    return run


def needs(name: str, relation: str) -> bool:
    """Whether an operator is derived from a relation."""
    return relation in _needed(OPERATORS[name].inputs, [])


def _tables(definition: Definition, given: frozenset[str] = frozenset()) -> set[str]:
    out: set[str] = set()
    for name in definition.inputs:
        if name not in given:
            out |= {name} if name in TABLES else _tables(_find(name), given)
    return out


def oracle(name: str) -> str:
    return statement(name, DUCKDB)


def relations(names: tuple[str, ...], body: str, *recursive: str) -> str:
    """``body`` in the checking engine's SQL over the relations ``names`` and definitions of its own."""
    parts = [f"{n} as ({_find(n).sql(DUCKDB)})" for n in _needed(names, [])]
    return f"with recursive {', '.join([*parts, *recursive])} {body}"
