"""Text functions that Spark SQL lacks: Unicode normal forms, full case folding, canonical JSON digests."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.executors import ship


def _udf(run, kind: str):
    """A pandas function of this package whose module the executors have."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.pandas_udf(run, kind)


def _normalizer(form: str, fold: bool):
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = " ".join(unicodedata.normalize(form, x).replace(" ", " ").split())
            return x.casefold() if fold else x

        return s.map(one)

    return _udf(run, "string")


def normalized(column: Column, form: str = "NFC", fold: bool = False) -> Column:
    """Normal form, no-break spaces as spaces, white space collapsed, optionally case-folded. Null stays null."""
    return _normalizer(form, fold)(column)


def table_text(column: Column) -> Column:
    """Compatibility form of a cell's text with white space collapsed."""
    return normalized(column, "NFKC")


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("canonical JSON has no such number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    return digits if not exponent else f"{digits}e{'-' if exponent[0] == '-' else '+'}{exponent.lstrip('+-').lstrip('0')}"


def canonical_json(value) -> str:
    """RFC 8785 text: keys by UTF-16 code units, shortest numbers, minimal escapes."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def canonical_digest(json_column: Column, prefix: str = "") -> Column:
    """``prefix`` and the SHA-256 of the canonical form of a JSON text; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else prefix + hashlib.sha256(canonical_json(json.loads(x)).encode()).hexdigest())

    return _udf(run, "string")(json_column)


def first_path_of_key(json_column: Column, key: str) -> Column:
    """Path of the first occurrence of a forbidden key in a JSON text, in document order; null if there is none."""

    def find(value, path: str):
        pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in pairs:
            here = f"{path}/{k}"
            if k == key and isinstance(value, dict):
                return here
            if (below := find(v, here)) is not None:
                return below
        return None

    return _udf(lambda s: s.map(lambda x: None if x is None else find(json.loads(x), "")), "string")(json_column)


def json_differences(left: Column, right: Column, masked: tuple[str, ...] = ()) -> Column:
    """Sorted paths at which two JSON texts differ, leaving out fields named in ``masked``."""

    def walk(a, b, path: str, out: list[str]) -> None:
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted(a.keys() | b.keys()):
                if k not in masked:
                    walk(a.get(k, ...), b.get(k, ...), f"{path}/{k}", out)
        elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                walk(x, y, f"{path}/{i}", out)
        elif type(a) is not type(b) or a != b:
            out.append(path or "/")

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            out: list[str] = []
            walk(json.loads(x or "null"), json.loads(y or "null"), "", out)
            found.append(out)
        return pd.Series(found)

    return _udf(run, "array<string>")(left, right)


def multiset_digest(df: DataFrame, *columns: str) -> DataFrame:
    """Order-independent digest of rows: count, sum modulo 2**256 and XOR of their SHA-256, as hex. All partial sums combine map-side."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns or df.columns])), 256)
    word = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    parts = df.select(*[w.alias(f"w{i}") for i, w in enumerate(word)])
    sums = parts.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"s{i}") for i in range(8)], *[F.coalesce(F.expr(f"bit_xor(w{i})"), F.lit(0)).alias(f"x{i}") for i in range(8)])
    out, carry = [], F.lit(0).cast("bigint")
    for i in reversed(range(8)):
        total = F.col(f"s{i}") + carry
        out.insert(0, F.lpad(F.lower(F.hex(F.pmod(total, F.lit(1 << 32)))), 8, "0"))
        carry = F.shiftright(total, 32)
    return sums.select("rows", F.concat(*out).alias("sum_hex"), F.concat(*[F.lpad(F.lower(F.hex(f"x{i}")), 8, "0") for i in range(8)]).alias("xor_hex"))
